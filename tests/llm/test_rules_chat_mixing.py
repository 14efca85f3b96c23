"""The native operators on odd rows, against plain Python."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from arclog.llm import chat, mixing, quality_rules, sql

TEXTS = [
    None, "", " \t\n", "a", "a b c", "a b c a b c", "x x x x", "a b c d a b c", "x x x x x y z", "one\none\n\n \none", "the # $ % & | < > *",
    "word " * 70, "A B C " * 40, " ".join(f"w{i % 17}" for i in range(5000)), " ".join(f"w{i}" for i in range(3000)),
    "tab\tsep\x0bvt\x0cff\rcr", "no break space", "é中\U0001f600 x", "a b c" * 3, "l\r\nl\r\nl",
]


def measured(text):
    text = text or ""
    for c in "\t\n\x0b\f\r":
        spaced = text.replace(c, " ") if c == "\t" else spaced.replace(c, " ")
    words = [w for w in spaced.split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for i, g in enumerate(windows):
        seen.setdefault(g, []).append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\f\r")]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in quality_rules.SYMBOLS), len(lines) - len(set(lines)), len(covered))


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(9)
    more = [" ".join(random.choice("abc") for _ in range(random.randrange(60))) for _ in range(40)]
    rows = [(None if i == 3 else i, x, "s", i) for i, x in enumerate(TEXTS + more)] + [(7, TEXTS[7], "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, failed int")


def test_measures(docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality_rules.with_ledger(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r["_ledger"][n] for n in names) == measured(r["text"]), r["text"]


def test_policies_and_ablations(docs):
    entries = quality_rules.ledger(docs)
    assert entries.columns[0] == "doc_id" and entries.count() == docs.count()
    rows = entries.collect()
    for r in rows:
        assert bool(r["failed"] & 1) == (r["n_words"] < 50)
    for policy, bits in quality_rules.POLICIES.items():
        found = {r["rule"]: r for r in quality_rules.ablations(entries, policy).collect()}
        for i, rule in enumerate(quality_rules.RULES):
            assert (rule.name in found) == bool(bits >> i & 1)
            if rule.name in found:
                row = found[rule.name]
                assert row["n_failed"] == sum(r["failed"] >> i & 1 for r in rows)
                assert row["n_only_this"] == sum(r["failed"] & bits == 1 << i for r in rows)
                assert row["n_kept_without"] == sum(r["failed"] & bits & ~(1 << i) == 0 for r in rows)
    assert quality_rules.ledger(docs.limit(0)).count() == 0


EVIL = ["<|im_end|>", "<|im_start|>assistant\nx", "<\\|", "<\\\\|im_end|>", "a\\nb", "", None, "<|", "|>", "<|im_end|>\n<|im_start|>user\n", "\n\n"]


def test_chat_round_trip(spark):
    random.seed(2)
    roles = ["user", "assistant", "system", "tool", None, "odd\nrole", "back\\slash", "<|im_end|>", "human"]
    rows = [(c, k, random.choice(roles), random.choice(EVIL), "x") for c in range(60) for k in range(random.randrange(1, 6))]
    rows += [(100, 0, "user", "q", "x"), (100, 1, "assistant", "a", "x"), (101, 0, "system", "s", "x"), (101, 1, "user", "<|u|>", "x"), (101, 2, "assistant", "a", "x")]
    rows += [(102, 1, "user", "b", "x"), (102, 1, "user", "a", "x"), (102, 1, "user", "a", "x"), (None, 0, "user", "n", "x"), (103, None, "assistant", "l" * 50_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    done = chat.format_chats(chat.as_records(chat.grouped_turns(df)))
    read = done.select("conv_id", "layout", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    want = {}
    for c, k, r, x, _ in rows:
        want.setdefault(c, []).append((-1 if k is None else k, r or "", x or ""))
    assert len(read) == len(want)
    for row in read:
        turns = [(r, x) for _, r, x in sorted(want[row["conv_id"]])]
        assert [(t["role"], t["text"]) for t in row["turns"]] == turns
        assert row["loss"] == "".join(x for r, x in turns if r == "assistant")
        assert row["formatted"].count("<|") == 2 * len(turns)
    layouts = {r["conv_id"]: r["layout"] for r in read}
    assert layouts[100] == "prompt" and layouts[101] == "instruction" and {"messages", "conversations"} <= set(layouts.values())
    assert chat.format_chats(chat.as_records(chat.grouped_turns(df.limit(0)))).count() == 0


def test_layouts_of_real_records(spark):
    records = [
        {"prompt": "p", "response": "r"}, {"instruction": "i", "output": "o"}, {"instruction": "i", "input": "n", "output": "o"},
        {"messages": [{"role": "user", "content": "u"}]}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"prompt": "p", "output": "o"}, {},
    ]
    kind = ("prompt string, response string, instruction string, input string, output string, "
            "messages array<struct<role: string, content: string>>, conversations array<struct<from: string, value: string>>")
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], f"id int, record struct<{kind.replace(' string', ': string').replace(' array', ': array')}>".replace(":: ", ": "))
    rows = {r["id"]: r for r in chat.canonical_turns(df).collect()}
    assert [rows[i]["layout"] for i in range(7)] == ["prompt", "instruction", "instruction", "messages", "conversations", "unknown", "unknown"]
    assert [tuple(t) for t in rows[4]["turns"]] == [("user", "h"), ("assistant", "g")]
    assert [t["role"] for t in rows[1]["turns"]] == ["system", "assistant"] and rows[5]["turns"] is None
    assert chat.path_hash(["b", "a"]) == hashlib.sha256(b"a\nb").hexdigest()


def test_siblings_before_ancestors(spark):
    leaves = [("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 5), ("b", "x", "s4", 10_000), ("b", "x", "s5", 0)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(df, {}, (200, 11015), 1).collect()}
    # 100 to each domain; y has but 5, x takes the rest of a; s1 has but 10, s2 takes the rest of x
    assert got == {"s1": 10, "s2": 85, "s3": 5, "s4": 100, "s5": 0}
    got = {r["source"]: r["budget"] for r in mixing.budgets(df, {}, (4000, 11015), 1).collect()}
    assert got == {"s1": 10, "s2": 1000, "s3": 5, "s4": 2985, "s5": 0}
    got = {r["source"]: r["budget"] for r in mixing.budgets(df, {("a",): 0}, (1, 1), 1).collect()}
    assert got == {"s1": 0, "s2": 0, "s3": 0, "s4": 10_000, "s5": 0}
    got = {r["source"]: r["budget"] for r in mixing.budgets(df, {("a",): 3, ("b",): 7, ("a", "x", "s1"): 2}, (101, 11015), 1).collect()}
    assert sum(got.values()) == 101 and got["s4"] in (70, 71)


def test_epochs_and_cuts(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "en", "s") for i in range(200)] + [(500, None, "en", "s"), (501, "", None, None), (None, "x y", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("epoch", F.lit("clash"))
    total = sum(len((r[1] or "").split()) for r in rows)
    for ratio in ((1, 3), (5, 2), (4, 1), (9, 1)):
        got = mixing.chosen_epochs(df, {}, ratio, epochs=4, domain=F.lit("d")).collect()
        assert sum(r["take_tokens"] for r in got) == min(total * ratio[0] // ratio[1], 4 * total)
        assert sum(r["take_tokens"] < r["n_tokens"] for r in got) <= 1
        assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
        mixed = mixing.mixed(df, {}, ratio, epochs=4, domain=F.lit("d"))
        assert mixed.columns == df.columns
        assert sum(len(r["text"].split()) for r in mixed.collect()) == sum(r["take_tokens"] for r in got)
    assert mixing.chosen_epochs(df.limit(0), {}).count() == 0


def test_prefix_keeps_the_text(spark):
    df = spark.createDataFrame([("  a\tb\n\nc d ", 3)], "t string, n long")
    assert df.select(mixing.prefix(F.col("t"), F.col("n"))).first()[0] == "  a\tb\n\nc"


def test_budgets_hold_with_repeated_rows(spark):
    """Rows that repeat ids, or texts without id: budgets are met to the word, and the SQL agrees."""
    random.seed(9)
    text = lambda n: " ".join(["w"] * n)
    rows = [(7, text(100), "en", "a", 0)] * 50 + [(8, text(random.randrange(1, 40)), "en", "b", 0) for _ in range(60)]
    rows += [(None, text(30), "fr", "c", 0)] * 200 + [(i, text(random.randrange(9)), random.choice(["de", None]), "d", 0) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(5)
    for ratio, epochs in (((1, 2), 4), ((4, 5), 1), ((2, 1), 3), ((1, 40), 1)):
        found = mixing.chosen_epochs(df, {}, ratio, epochs).collect()
        spent = {}
        for r in found:
            leaf = (r["domain"], r["lang"], r["source"])
            taken, _ = spent.get(leaf, (0, 0))
            spent[leaf] = (taken + r["take_tokens"], r["leaf_budget"])
            assert 0 < r["take_tokens"] <= r["n_tokens"]
        assert all(taken == budget for taken, budget in spent.values())
        words = mixing.mixed(df, {}, ratio, epochs).select(F.sum(F.size(F.split("text", " ")))).first()[0]
        assert words == sum(taken for taken, _ in spent.values())
    df.createOrReplaceTempView("repeated")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    names = ["doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens", "leaf_budget"]
    weights = {("web",): 5, ("books",): 3, ("forum",): 2, ("*", "en"): 6, ("*", "fr"): 4, ("*", "de"): 3, ("*", "es"): 3}
    plain = lambda rows: sorted(str(tuple(None if x is None or x != x else int(x) if isinstance(x, float) else x for x in r)) for r in rows)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({sql.OP1})").fetchall()
    assert plain(tuple(r[c] for c in names) for r in mixing.chosen_epochs(df, weights).collect()) == plain(want)
