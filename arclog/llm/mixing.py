"""Mixing sources to target weights by hierarchical budgets.

Sources form a tree: domain, language, source. A budget of tokens goes down the tree. At each
node it is dealt to the children by their weights; no child gets more than its subtree can
give (its tokens times the epochs allowed), and what one cannot take goes to its siblings in
proportion to their weights. Only when a whole subtree is exhausted does the shortage reach
the ancestors' siblings, since a subtree's capacity is what its parent sees.

A leaf's budget buys whole epochs and a prefix of one more. Each epoch orders the leaf's
documents by a hash of seed, epoch and id; the prefix ends inside one document at most,
which is cut after so many words. Rows with one hash are ordered by their number of words and
then by a number of the row, so of rows that repeat an id too only one is cut. The cut is found
without sorting a leaf: tokens are summed by leaf and leading hash digits, in the one bucket
that holds the cut by hash and words, in the one group there by the partition that a row
stands in, and only in one of these are rows ordered. What is left for each leaf is a row to
compare with, so documents are chosen where they are read.

Everything is DataFrame functions. Budgets are whole tokens and add up exactly.

Defined cases: null and empty names are one node; a token is a word; a text without words is
never chosen; weights of 0 exclude a subtree; a document without id is ordered by its text;
rows that repeat an id, or a text without id, follow each other, so budgets hold with them
too. An empty table gives no rows. Extra columns are ignored by ``chosen_epochs`` and kept by
``mixed``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arclog.llm.common import checkpointed, shared_folder, words_of

LEVELS = ("domain", "lang", "source")
#: Leading hex digits of the hash: a leaf is summed in 16**DIGITS buckets.
DIGITS = 3
#: Leaves up to which the plan is sent to every task; beyond it is joined by its keys.
BROADCAST_LEAVES = 50_000

DOMAINS = ("web", "books", "forum")


def domain_of(source: Column) -> Column:
    """The domain of a source where a table names none: dealt by a hash of its name."""
    digit = F.conv(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int")
    return F.get(F.array(*[F.lit(d) for d in DOMAINS]), digit % len(DOMAINS))


def _weight(weights: Mapping[tuple[str, ...], int], level: int) -> Column:
    """The weight of a node: that of its path, else of its name under ``*``, else 1."""
    own = {path: w for path, w in weights.items() if len(path) == level + 1}
    if not own:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for path, w in own.items() for x in ("\x1f".join(path), w)])
    path = F.concat_ws("\x1f", *LEVELS[: level + 1])
    anywhere = F.concat_ws("\x1f", *[F.lit("*")] * level, F.col(LEVELS[level]))
    return F.coalesce(F.try_element_at(table, path), F.try_element_at(table, anywhere), F.lit(1)).cast("long")


def deal(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` with ``budget``: their share of ``total`` by ``weight`` up to ``capacity``.

    ``total`` is the parent's budget, at most the children's capacities. Sorted by capacity
    for each unit of weight, the children that are exhausted come first; the others share
    what those leave by cumulative rounding, so shares add up to the total.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    over = Window.partitionBy(*(parent or [F.lit(0)])).orderBy((F.col("capacity").cast("double") / F.col("weight")).asc(), F.col(name).asc())
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    after = over.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*(parent or [F.lit(0)]))
    ranked = children.select(
        "*", F.row_number().over(over).alias("_rank"),
        F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("long").alias("_taken"),
        F.sum("weight").over(after).alias("_heavy"), F.coalesce(F.sum("weight").over(before), F.lit(0)).cast("long").alias("_light"))
    exhausted = wide("capacity") * wide("_heavy") <= wide("weight") * (F.col("total") - F.col("_taken")).cast("decimal(19,0)")
    first = ranked.withColumn("_first", F.min(F.when(~exhausted, F.col("_rank"))).over(whole))
    at = F.col("_rank") == F.col("_first")
    shared = first.select(
        "*",
        F.max(F.when(at, F.col("total") - F.col("_taken"))).over(whole).alias("_rest"),
        F.max(F.when(at, F.col("_heavy"))).over(whole).alias("_weights"),
        F.max(F.when(at, F.col("_light"))).over(whole).alias("_base"))
    upto = lambda c: F.expr(f"(cast(_rest as decimal(19,0)) * cast({c} - _base as decimal(19,0))) div cast(_weights as decimal(19,0))")
    share = upto("_light + weight") - upto("_light")
    open_ = F.coalesce(F.col("_rank") >= F.col("_first"), F.lit(False))
    return shared.withColumn("budget", F.when(open_, F.least(share, F.col("capacity"))).otherwise(F.col("capacity"))).drop(
        "_rank", "_taken", "_heavy", "_light", "_first", "_rest", "_weights", "_base", "total")


def budgets(leaves: DataFrame, weights: Mapping[tuple[str, ...], int], ratio: tuple[int, int], epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) for every leaf. ``leaves``: LEVELS and tokens."""
    weighted = leaves
    for level in range(len(LEVELS)):
        weighted = weighted.withColumn(f"w{level}", _weight(weights, level))
    least = F.least(*[F.col(f"w{level}") for level in range(len(LEVELS))])
    weighted = weighted.withColumn("capacity", F.when(least > 0, F.col("tokens") * epochs).otherwise(F.lit(0)).cast("long"))
    every = Window.partitionBy(F.lit(0))
    total = F.least(F.expr(f"(cast(_all as decimal(20,0)) * {ratio[0]}) div {ratio[1]}"), F.sum("capacity").over(every)).cast("long")
    dealt: DataFrame | None = None
    for level, name in enumerate(LEVELS):
        keys, parent = list(LEVELS[: level + 1]), list(LEVELS[:level])
        extra = [F.sum("tokens").alias("tokens")]
        nodes = weighted.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.greatest(F.max(f"w{level}"), F.lit(1)).alias("weight"), *extra)
        above = nodes.withColumn("_all", F.sum("tokens").over(every)).withColumn("total", total).drop("_all") if dealt is None else nodes.join(dealt.select(*parent, F.col("budget").alias("total")), parent)
        dealt = deal(above, parent, name)
    return dealt.select(*LEVELS, "tokens", "budget")


def _named(docs: DataFrame, domain: Column, id_col: str, text_col: str) -> list[Column]:
    """The columns that planning needs: names, tokens, what the hash is made of, and a number of
    the row, whose upper bits are those of its partition."""
    text = F.col(f"`{text_col}`")
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [F.coalesce(domain, F.lit("")).alias("domain"), name("lang").alias("lang"), name("source").alias("source"), key.alias("_key"), F.size(words_of(text)).cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("_row")]


def _hash(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("full") + 1).cast("string"), F.col("_key")).cast("binary"))


def _joined(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(plan) if small else plan, list(LEVELS))


def planned(rows: DataFrame, weights: Mapping[tuple[str, ...], int], ratio: tuple[int, int], epochs: int, seed: int) -> tuple[DataFrame, bool]:
    """The plan: for every leaf ``full`` epochs, then rows before ``cut`` (hash, words, row
    number), of the row at the cut ``cut_tokens`` words; and whether it is small enough to send
    to each task."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    shares = checkpointed(budgets(leaves, weights, ratio, epochs).where("tokens > 0 AND budget > 0").select(
        *LEVELS, "tokens", "budget", F.expr("budget div tokens").alias("full"), F.expr("budget % tokens").alias("rest")))
    small = shares.count() <= BROADCAST_LEAVES
    hashed = _joined(rows.where("n_tokens > 0"), shares.where("rest > 0"), small).withColumn("h", _hash(seed)).withColumn("bucket", F.substring("h", 1, DIGITS))
    sums = hashed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    over = Window.partitionBy(*LEVELS).orderBy("bucket")
    ends = sums.withColumn("upto", F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    border = ends.where("upto - n < rest AND rest <= upto").select(*LEVELS, "bucket", (F.col("upto") - F.col("n")).alias("base"))
    here = [*LEVELS, "h", "n_tokens"]
    inside = hashed.join(F.broadcast(border) if small else border, [*LEVELS, "bucket"])
    groups = inside.groupBy(*here).agg(F.sum("n_tokens").alias("n"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    order = Window.partitionBy(*LEVELS).orderBy("h", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    # the cut row is the one with ``place`` rows of its group before it
    at_cut = groups.withColumn("upto", F.col("base") + F.sum("n").over(order)).where("upto - n < rest AND rest <= upto").select(
        *here, F.expr("(rest - upto + n - 1) div n_tokens").alias("place"), F.expr("(rest - upto + n - 1) % n_tokens + 1").alias("cut_tokens"))
    alike = inside.withColumn("part", F.shiftright("_row", 33)).join(F.broadcast(at_cut) if small else at_cut, here)
    parts = alike.groupBy(*here, "part").agg(F.count(F.lit(1)).alias("n"), F.first("place").alias("place"))
    before = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    part = parts.withColumn("upto", F.sum("n").over(before)).where("upto - n <= place AND place < upto").select(
        *LEVELS, "part", (F.col("place") - F.col("upto") + F.col("n") + 1).alias("nth"))
    rank = F.row_number().over(Window.partitionBy(*LEVELS, "part").orderBy("_row"))
    cuts = alike.join(F.broadcast(part) if small else part, [*LEVELS, "part"]).withColumn("rank", rank).where("rank = nth").select(
        *LEVELS, F.struct("h", "n_tokens", "_row").alias("cut"), "cut_tokens")
    plan = shares.join(cuts, list(LEVELS), "left").select(*LEVELS, "budget", "full", "cut", "cut_tokens")
    return checkpointed(plan), small


def _part(seed: int) -> Column:
    """Words that the last, partial epoch takes of a row."""
    own = F.struct(_hash(seed).alias("h"), F.col("n_tokens").alias("n_tokens"), F.col("_row").alias("_row"))
    taken = F.when(own < F.col("cut"), F.col("n_tokens")).when(own == F.col("cut"), F.col("cut_tokens")).otherwise(F.lit(0))
    return F.coalesce(taken, F.lit(0)).cast("long")


def chosen_epochs(docs: DataFrame, weights: Mapping[tuple[str, ...], int], ratio: tuple[int, int] = (1, 2), epochs: int = 4, seed: int = 17,
                  domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and epoch that takes it: doc_id, names, epoch, n_tokens,
    take_tokens and leaf_budget. ``ratio``: the budget as a share of all tokens."""
    domain = domain_of(F.col("source")) if domain is None else domain
    rows = checkpointed(docs.select(F.col(f"`{id_col}`").alias("doc_id"), *_named(docs, domain, id_col, text_col)))
    plan, small = planned(rows, weights, ratio, epochs, seed)
    found = _joined(rows.where("n_tokens > 0"), plan, small).withColumn("_part", _part(seed))
    times = F.col("full") + F.when(F.col("_part") > 0, 1).otherwise(0)
    each = found.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return each.select(
        F.col("doc_id").alias(id_col), *LEVELS, "epoch", "n_tokens",
        F.when(F.col("epoch") <= F.col("full"), F.col("n_tokens")).otherwise(F.col("_part")).alias("take_tokens"),
        F.col("budget").alias("leaf_budget"))


def prefix(text: Column, words: Column) -> Column:
    """A text up to the end of its ``words``-th word, as it stands."""
    parts = F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), words.cast("int")), "")


def mixed(docs: DataFrame, weights: Mapping[tuple[str, ...], int], ratio: tuple[int, int] = (1, 2), epochs: int = 4, seed: int = 17,
          domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chosen rows of ``docs``, once for each epoch that takes them, texts at a cut shortened.
    The rows are written once to the shared folder, where their numbers do not change; texts are
    never shuffled while the plan is small enough to send to each task."""
    domain = domain_of(F.col("source")) if domain is None else domain
    spark, path = docs.sparkSession, shared_folder(docs.sparkSession, "mixing")
    docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *_named(docs, domain, id_col, text_col)).write.parquet(path)
    wide = spark.read.parquet(path)
    plan, small = planned(wide.drop("_doc"), weights, ratio, epochs, seed)
    found = _joined(wide.where("n_tokens > 0"), plan, small).withColumn("_part", _part(seed))
    times = F.col("full") + F.when(F.col("_part") > 0, 1).otherwise(0)
    each = found.where(times > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    short = (F.col("_epoch") > F.col("full")) & (F.col("_part") < F.col("n_tokens"))
    own = F.col("_doc")[text_col]
    text = F.when(short, prefix(own, F.col("_part"))).otherwise(own)
    return each.select(*[text.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])
