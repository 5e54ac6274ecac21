"""Chat formatting by schema fingerprints, in DataFrame functions alone.

A record is a struct that may follow any of several layouts. The nested field
paths that are present in a row are hashed; the hash selects a declarative
mapping, and the mapping turns the row into canonical turns (role, text). Turns
are written under a template whose control strings cannot occur in a text: the
characters that begin them are escaped, reversibly.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerwatch.llm.common import table

ROLE_MARK, TEXT_MARK, END_MARK = "<|role|>", "<|text|>", "<|end|>"
#: Escapes, in the order in which they are applied; undone in the opposite order.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
LOSS_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths it must have, those it may have, and the turns as SQL over `record`."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: str

    def fingerprints(self) -> list[str]:
        """Joined paths of every variant."""
        return [
            "|".join(sorted([*self.required, *extra]))
            for n in range(len(self.optional) + 1)
            for extra in combinations(self.optional, n)
        ]


def _message_list(field: str, role: str, text: str) -> Mapping:
    turns = f"transform(record.{field}, m -> struct(m.{role} AS role, m.{text} AS text))"
    return Mapping(field, (f"{field}[]",), (f"{field}[].{role}", f"{field}[].{text}"), turns)


def _fixed(name: str, user: str, assistant: str, extra: str | None = None) -> Mapping:
    """A system text if there is one, a user turn, an assistant turn."""
    asked = f"record.{user}" if extra is None else f"concat_ws('\\n\\n', record.{user}, nullif(record.{extra}, ''))"
    turns = (
        f"filter(array(struct('system' AS role, record.system AS text), struct('user' AS role, {asked} AS text), "
        f"struct('assistant' AS role, record.{assistant} AS text)), t -> t.role <> 'system' OR t.text IS NOT NULL)"
    )
    return Mapping(name, (user,), (assistant, "system", *([extra] if extra else [])), turns)


ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_SHARED = "coalesce(element_at(map({pairs}), m.from), m.from)".format(
    pairs=", ".join(f"'{a}', '{b}'" for a, b in ALIASES.items())
)
MAPPINGS = (
    _message_list("turns", "role", "text"),
    _message_list("messages", "role", "content"),
    Mapping(
        "conversations", ("conversations[]",), ("conversations[].from", "conversations[].value"),
        f"transform(record.conversations, m -> struct({_SHARED} AS role, m.value AS text))",
    ),
    _fixed("prompt", "prompt", "response"),
    _fixed("completion", "prompt", "completion"),
    _fixed("instruction", "instruction", "output", "input"),
    _fixed("question", "question", "answer"),
)


def _paths(kind: T.DataType, at: str, path: str) -> list[tuple[str, str]]:
    """(path, SQL condition that the row has it) of all nested fields; `at` is the SQL of the value."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _paths(f.dataType, f"{at}.`{f.name}`", f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        item = f"x{path.count('[]')}"
        inner = _paths(kind.elementType, item, f"{path}[]")
        return [(f"{path}[]", f"{at} IS NOT NULL")] + [
            (p, f"exists({at}, {item} -> {c})") for p, c in inner if p != f"{path}[]"
        ]
    return [(path, f"{at} IS NOT NULL")]


def schema_fingerprint(records: DataFrame) -> Column:
    """Hash of the nested field paths present in the row's `record`, whatever their order and scalar types."""
    found = [F.when(F.expr(c), F.lit(p)) for p, c in _paths(records.schema["record"].dataType, "record", "")]
    return F.xxhash64(F.array_join(F.array_sort(F.array_compact(F.array(*found))), "|"))


def _covers(kind: T.StructType, mapping: Mapping) -> str | None:
    """The mapping's SQL if the record type has its required fields; absent optional ones read as NULL."""
    there = {p for p, _ in _paths(kind, "record", "")}
    if not set(mapping.required) <= there:
        return None
    sql = mapping.turns
    for path in mapping.optional:
        if path not in there:
            holder, _, leaf = path.rpartition(".")
            sql = sql.replace(f"m.{leaf}" if holder else f"record.{leaf}", "CAST(NULL AS STRING)")
    return sql


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, layout, turns) of records (id, record): a row per row.

    A record whose fingerprint no mapping has gets a NULL layout and no turns; it
    is returned all the same. NULL roles and texts become empty.
    """
    kind = records.schema["record"].dataType
    marked = records.select("id", "record", schema_fingerprint(records).alias("fingerprint"))
    layout, turns = F.lit(None).cast("string"), F.expr(f"CAST(array() AS {TURNS})")
    for mapping in reversed(mappings):
        sql = _covers(kind, mapping)
        if sql is None:
            continue
        hashes = [F.xxhash64(F.lit(paths)) for paths in mapping.fingerprints()]
        chosen = F.array_contains(F.array(*hashes), F.col("fingerprint"))
        layout = F.when(chosen, F.lit(mapping.name)).otherwise(layout)
        turns = F.when(chosen, F.expr(f"CAST({sql} AS {TURNS})")).otherwise(turns)
    whole = F.transform(
        turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    )
    return marked.select("id", layout.alias("layout"), whole.alias("turns"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(canonical: DataFrame) -> DataFrame:
    """(id, layout, formatted, segments): the text under the template, and its parts with the loss mask.

    The segments, put together, are the formatted text; a segment is under the
    loss if it is the text of an assistant turn. No turns give an empty text.
    """

    def parts(turn: Column) -> Column:
        head = F.concat(F.lit(ROLE_MARK), escape(turn["role"]), F.lit(TEXT_MARK))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), (turn["role"] == LOSS_ROLE).alias("loss")),
            F.struct(F.lit(END_MARK).alias("text"), F.lit(False).alias("loss")),
        )

    split = canonical.select("id", "layout", F.flatten(F.transform("turns", parts)).alias("segments"))
    return split.select("id", "layout", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: DataFrame) -> DataFrame:
    """(id, turns, loss_text): turns parsed from the formatted text, and all text under the loss mask, unescaped."""
    pieces = F.split("formatted", r"<\|end\|>", -1)
    turns = F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(ROLE_MARK) + 1)), TEXT_MARK, 1)).alias("role"),
            unescape(F.substring_index(p, TEXT_MARK, -1)).alias("text"),
        ),
    )
    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select("id", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")


def turn_records(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows (conversation, turn, role, text) to one record per conversation, turns in order.

    Ties of a turn number fall in order of role and text; repeated rows are
    repeated turns. The rows of a conversation meet in one row, as the formatted
    text that is made of them must, so a conversation has to fit in memory; texts
    of any length are kept whole. Needs the columns turn, role and text; others are
    ignored. An empty table gives no records.
    """
    held = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = rows.select(F.col(id_col).alias("id"), "turn", "role", "text").groupBy("id").agg(held.alias("held"))
    turns = F.transform("held", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select("id", turns.alias("turns"))


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """All `conversations`, and one that says control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations")
    message = "array<struct<role:string,content:string>>"
    told = turn_records(rows).select("id", F.expr(f"struct(turns, CAST(NULL AS {message}) AS messages)").alias("record"))
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(1).selectExpr(
        "-7L AS id",
        f"struct(CAST(NULL AS {TURNS}) AS turns, array(struct('user' AS role, '{says}' AS content), "
        f"struct('assistant' AS role, '{says}' AS content)) AS messages) AS record",
    )
    back = read_back(format_turns(canonical_turns(told.unionByName(extra))))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The template's own length: marks per turn, and one more character per escaped one.
_ESCAPED = "length(t) + (length(t) - length(replace(replace(replace(t, '\\', ''), '<', ''), '[', '')))"
ORACLES = {
    "op8_chat_format": f"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
            CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum({_ESCAPED} + length(role) + {len(ROLE_MARK + TEXT_MARK + END_MARK)}) AS BIGINT) AS formatted_chars
        FROM r GROUP BY conv_id
    """,
}
