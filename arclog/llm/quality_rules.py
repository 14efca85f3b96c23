"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure
bit per rule; a policy is a versioned set of rules, so verdicts of any policy version and
ablations of single rules need the bits only, never the texts again.

Defined cases: a null or blank text has no words and fails ``few_words``; a null id stays a
row of its own; repeated rows are judged one by one; extra columns of the input are ignored
by ``ledger`` and kept by ``with_ledger``. All measuring happens inside one row, so neither
a hot source nor a group of copies meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclog.llm.common import SPACE_CHARS, SPACE_RUN, let

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are hashed; the sorted array holds the hash's upper bits with the position in the
    lower ones, so equal windows become neighbours and one sort finds all of them. Full
    hashes are compared before two neighbours count as equal.
    """

    def covered(n: Column) -> Column:
        def with_hashes(g: Column) -> Column:
            size = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n)))
            return let(size, lambda m: with_size(g, m))

        def with_size(g: Column, m: Column) -> Column:
            low = m - F.lit(1)
            packed = F.sort_array(F.transform(g, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
            return let(packed, lambda s: with_sorted(g, low, s))

        def with_sorted(g: Column, low: Column, s: Column) -> Column:
            def same(x: Column, k: Column, step: int) -> Column:
                other = F.get(s, k + F.lit(step))
                near = x.bitwiseXOR(other).bitwiseAND(F.bitwise_not(low)) == 0
                return near & (F.get(g, x.bitwiseAND(low).cast("int")) == F.get(g, other.bitwiseAND(low).cast("int")))

            def repeated(x: Column, k: Column) -> Column:
                return same(x, k, -1) | same(x, k, 1) | same(x, k, -2) | same(x, k, 2)

            at = F.sort_array(F.transform(F.filter(s, repeated), lambda x: x.bitwiseAND(low)))
            return let(at, lambda r: F.aggregate(
                F.transform(r, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(r, k + F.lit(1)) - x, F.lit(3).cast("long")))),
                F.lit(0).cast("long"), lambda total, x: total + x))

        hashes = F.transform(
            F.sequence(F.lit(0), n - F.lit(3)),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + F.lit(1)), F.get(words, i + F.lit(2))),
        )
        return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(hashes, with_hashes))

    return let(F.size(words), covered)


def measures(text: Column) -> Column:
    """The measurements of a whole text as one struct, from which every rule is decided."""

    def of(t: Column) -> Column:
        trimmed = F.btrim(t, F.lit(SPACE_CHARS))
        words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
        lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")

        def with_words(w: Column) -> Column:
            return let(lines, lambda v: with_lines(w, v))

        def with_lines(w: Column, v: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"),
                _repeated_words(w).alias("n_repeat_words"),
                F.size(v).cast("long").alias("n_lines"),
                F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("n_upper"),
            )

        return let(words, with_words)

    return let(F.coalesce(text, F.lit("")), of)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` of the measurements holds; its place in RULES is its bit and
    never changes."""

    name: str
    fails: Callable[[Column], Column]


#: Append only: the ledger stores these positions.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_windows", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50),
    Rule("symbols", lambda m: m["n_symbols"] * 100 > m["n_words"] * 10),
    Rule("duplicate_lines", lambda m: m["n_dup_lines"] * 100 > m["n_lines"] * 40),
    Rule("long_words", lambda m: m["word_chars"] > m["n_words"] * 12),
    Rule("short_words", lambda m: m["word_chars"] < m["n_words"] * 2),
    Rule("upper_case", lambda m: m["n_upper"] * 2 > m["word_chars"]),
)


def mask(*names: str) -> int:
    at = {rule.name: i for i, rule in enumerate(RULES)}
    return sum(1 << at[name] for name in names)


BASE = mask("few_words", "repeated_windows")

#: Versions of the policy: the rules that reject.
POLICIES = {
    "base": BASE,
    "v1": BASE | mask("symbols", "duplicate_lines"),
    "v2": mask(*(rule.name for rule in RULES)),
}


def failure_bits(m: Column) -> Column:
    """One bit per failed rule, from the struct of measurements."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits + F.when(rule.fails(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return bits


def with_ledger(docs: DataFrame, text_col: str = "text", column: str = "_ledger") -> DataFrame:
    """``docs`` with one more struct column: the measurements and ``failed``, the rules' bits.

    It is one expression, in which the measurements are bound once: a filter on ``failed``
    that Catalyst moves below the projection measures a text once and not for every rule.
    """
    entry = let(measures(F.col(f"`{text_col}`")), lambda m: F.struct(*[m[x].alias(x) for x in MEASURES], failure_bits(m).alias("failed")))
    return docs.withColumn(column, entry)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the measurements and ``failed``."""
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    return with_ledger(slim, "_text").select(F.col(f"`{id_col}`"), "_ledger.*")


def passes(failed: Column, policy: str = "v2") -> Column:
    """Whether a ledger row passes a policy version: no rule of it has failed."""
    return failed.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: rows that fail it, rows it alone rejects, rows kept without it.

    Rows are first counted by their bits, so what is shuffled is at most one row for each
    bit pattern and task, whatever the size of the ledger.
    """
    chosen = POLICIES[policy]
    patterns = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("rows"))
    rules = F.array(*[
        F.struct(F.lit(rule.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
        for i, rule in enumerate(RULES) if chosen >> i & 1
    ])
    hit = F.col("failed").bitwiseAND(F.lit(chosen).cast("long"))
    each = patterns.select("failed", "rows", F.inline(rules))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_only_this"),
        total(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )
