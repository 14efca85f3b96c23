"""Chat formatting by schema fingerprints.

Records come in many layouts: prompt and response, instruction with input, lists of messages.
The set of nested field paths that hold a value is hashed for each record; the hash selects a
declarative mapping, which turns the record into canonical turns (role, text). A record whose
hash no mapping names keeps its row with null turns and layout ``unknown``.

The template marks turns with control strings. Inside texts ``<|`` never survives: every
``<``, backslashes, ``|`` gets one more backslash, and reading takes it away again.

Defined cases: null texts and roles are empty; turns of the same number are ordered by role
and text, and repeated rows stay repeated turns; rows of a null conversation id form one
conversation with a null id; null turn numbers come first. Extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arclog.llm.common import let

START, END = "<|im_start|>", "<|im_end|>"

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
TURNS = f"array<{TURN.simpleString()}>"


@dataclass(frozen=True)
class Fields:
    """Turns from single fields: (role, path), in order; absent optional paths give no turn."""

    turns: tuple[tuple[str, str], ...]
    optional: tuple[str, ...] = ()

    def path_sets(self) -> list[frozenset[str]]:
        every = [path for _, path in self.turns]
        away = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [frozenset(every) - frozenset(some) for some in away]

    def turns_of(self, record: str) -> Column:
        parts = [
            F.when(F.col(f"{record}.{path}").isNotNull(), F.struct(F.lit(role).alias("role"), F.col(f"{record}.{path}").alias("text")))
            for role, path in self.turns
        ]
        return F.filter(F.array(*parts), lambda turn: turn.isNotNull())


@dataclass(frozen=True)
class Messages:
    """Turns from a list of structs, with other names for roles."""

    path: str
    role: str
    text: str
    aliases: tuple[tuple[str, str], ...] = field(default=())

    def path_sets(self) -> list[frozenset[str]]:
        return [frozenset({f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"})]

    def turns_of(self, record: str) -> Column:
        def canonical(message: Column) -> Column:
            role = message[self.role]
            for given, meant in self.aliases:
                role = F.when(message[self.role] == given, F.lit(meant)).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(message[self.text], F.lit("")).alias("text"))

        return F.transform(F.col(f"{record}.{self.path}"), canonical)


#: The mappings, by layout name. Add a layout here; nothing else changes.
LAYOUTS: dict[str, Fields | Messages] = {
    "prompt": Fields((("user", "prompt"), ("assistant", "response"))),
    "instruction": Fields((("system", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    "messages": Messages("messages", "role", "content"),
    "conversations": Messages("conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
}


def path_hash(paths) -> str:
    """The fingerprint of a set of field paths, equal to what ``fingerprint`` gives a record."""
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _any_holds(messages: Column, name: str) -> Column:
    return F.coalesce(F.exists(messages, lambda x: x[name].isNotNull()), F.lit(False))


def field_paths(kind: T.DataType, value: Column, prefix: str = "") -> list[tuple[str, Column]]:
    """Every nested leaf path of a type with a column that is true where a record holds a value."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in field_paths(f.dataType, value[f.name], f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return [(f"{prefix}[].{f.name}", _any_holds(value, f.name)) for f in kind.elementType.fields]
    return [(prefix, value.isNotNull())]


def fingerprint(kind: T.StructType, record: Column) -> Column:
    """sha256 of the sorted nested field paths that hold a value in a record."""
    paths = sorted(field_paths(kind, record), key=lambda x: x[0])
    return F.sha2(F.concat_ws("\n", *[F.when(present, F.lit(path)) for path, present in paths]).cast("binary"), 256)


def canonical_turns(records: DataFrame, record: str = "record", layouts: dict[str, Fields | Messages] | None = None) -> DataFrame:
    """``records`` with columns ``layout`` and ``turns`` in place of the struct column ``record``."""
    layouts = LAYOUTS if layouts is None else layouts
    kind = records.schema[record].dataType
    there = {path.split("[]")[0] for path, _ in field_paths(kind, F.col(record))}
    known = {path_hash(paths): name for name, layout in layouts.items() for paths in layout.path_sets()}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    marked = records.withColumn("_paths", fingerprint(kind, F.col(record))).withColumn(
        "layout", F.coalesce(F.try_element_at(names, F.col("_paths")), F.lit("unknown")))
    turns = F.lit(None).cast(TURNS)
    for name, layout in layouts.items():
        needed = {path.split("[]")[0] for paths in layout.path_sets() for path in paths}
        if needed <= there:
            turns = F.when(F.col("layout") == name, layout.turns_of(record).cast(TURNS)).otherwise(turns)
    return marked.withColumn("turns", turns).drop("_paths", record)


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line: backslashes and line ends are written as \\\\ and \\n."""
    return escape_text(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(unescape_text(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(lines, F.lit("\\\\"), F.lit("\\"))


def formatted(records: DataFrame, trained: str = "assistant") -> DataFrame:
    """Canonical ``turns`` as ``segments``: (text, loss) pieces whose concatenation is the
    formatted conversation; ``loss`` marks just the texts of the role that is trained."""

    def of(turn: Column) -> Column:
        role = F.coalesce(turn["role"], F.lit(""))
        text = escape_text(F.coalesce(turn["text"], F.lit("")))
        return F.array(
            F.struct(F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(text.alias("text"), (role == trained).alias("loss")),
            F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    segments = F.flatten(F.transform(F.col("turns"), of))
    return records.withColumn("segments", segments).drop("turns").withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(text: Column) -> Column:
    """The turns of a formatted conversation, read back from its text alone."""

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(len(START) + 1), F.length(part))
        return let(body, lambda b: let(F.position(F.lit("\n"), b), lambda at: F.struct(
            unescape_role(F.substring(b, F.lit(1), at - F.lit(1))).alias("role"),
            unescape_text(F.substring(b, at + F.lit(1), F.length(b))).alias("text"),
        )))

    parts = F.split(text, r"<\|im_end\|>\n")
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - F.lit(1)), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape_text(s["text"])), "")


def grouped_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns) from one row per turn; a conversation is one output row, however long."""
    slim = rows.select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record) with records in several layouts, as sources deliver them: two turns as
    prompt and response, three with a system text as instruction, others as one of two lists."""
    roles = F.transform("turns", lambda t: t["role"])
    at = lambda i: F.get("turns", F.lit(i))["text"]
    layout = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), "prompt")
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), "instruction")
        .when((F.size("turns") > 0) & (F.col("conv_id") % 2 == 1) & F.forall("turns", lambda t: t["role"].isin("system", "user", "assistant")), "conversations")
        .otherwise("messages")
    )
    kept = conversations.withColumn("_layout", layout)
    when = lambda name, value: F.when(F.col("_layout") == name, value)

    def other(t: Column) -> Column:
        name = F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"])
        return F.struct(name.alias("from"), t["text"].alias("value"))

    return kept.select("conv_id", F.struct(
        when("prompt", at(0)).alias("prompt"),
        when("prompt", at(1)).alias("response"),
        when("instruction", at(0)).alias("instruction"),
        when("instruction", at(1)).alias("input"),
        when("instruction", at(2)).alias("output"),
        when("messages", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"),
        when("conversations", F.transform("turns", other)).alias("conversations"),
    ).alias("record"))


def format_chats(records: DataFrame, record: str = "record", trained: str = "assistant") -> DataFrame:
    """Records of any known layout as formatted conversations: ``layout``, ``segments`` and
    ``formatted`` beside the other columns."""
    return formatted(canonical_turns(records, record), trained)
