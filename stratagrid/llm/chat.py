"""Chat formatting by schema fingerprint. DataFrame functions only.

The nested field paths of a layout, sorted and hashed, select a declarative mapping that makes
canonical turns of it: ``conv_id, turns array<struct<role, text>>``. Typed frames are fingerprinted by
their schema; JSON records each by their own shape, so that one table may mix layouts.

The template writes a turn as ``<s>[role]text</s>``. In roles and texts ``&``, ``<``, ``[`` and ``]``
are written ``&amp;``, ``&lt;``, ``&lbr;`` and ``&rbr;``, so no control string can stand inside a turn, a role
ends at the first ``]``, and the replacements undone in the other order give back every role and text.

Defined results: a null role or text is empty; turns are ordered by turn, then role, then text,
null turns first; repeated rows are repeated turns; a null ``conv_id`` is a conversation of its own; an empty table
gives no conversations. Texts are handled whole, whatever their length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TURN = "struct<role:string,text:string>"
_NONE = f"array<{_TURN}>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Sorted nested field paths; an array adds ``[]`` to its path."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _messages(role: str, text: str, names: dict[str, str]) -> Callable[[Column], Column]:
    def turns(messages: Column) -> Column:
        def one(m: Column) -> Column:
            said = m[role]
            for a, b in names.items():
                said = F.when(m[role] == a, b).otherwise(said)
            return _turn(said, m[text])

        return F.coalesce(F.transform(messages, one), F.array().cast(_NONE))

    return turns


def _pair(prompt: Callable[[Callable[[str], Column]], Column], answer: str, system: str | None = None):
    def turns(get: Callable[[str], Column]) -> Column:
        said = F.array(_turn(F.lit("user"), prompt(get)), _turn(F.lit("assistant"), get(answer)))
        if system:
            first = F.when(F.coalesce(get(system), F.lit("")) != "", F.array(_turn(F.lit("system"), get(system)))).otherwise(F.array().cast(_NONE))
            said = F.concat(first, said)
        return said

    return turns


def _with_input(get: Callable[[str], Column]) -> Column:
    return F.when(
        F.coalesce(get("input"), F.lit("")) == "", get("instruction")
    ).otherwise(F.concat(F.coalesce(get("instruction"), F.lit("")), F.lit("\n\n"), get("input")))


_SHARED = {"human": "user", "gpt": "assistant"}

#: Declarative layouts: the field paths beside the id, the JSON type that holds them, and how turns are made.
LAYOUTS: list[tuple[list[str], str, Callable[[Callable[[str], Column]], Column]]] = [
    (
        ["messages[].content", "messages[].role"], "struct<messages:array<struct<role:string,content:string>>>",
        lambda get: _messages("role", "content", {})(get("messages"))
    ),
    (
        ["conversations[].from", "conversations[].value"], "struct<conversations:array<struct<`from`:string,value:string>>>",
        lambda get: _messages("from", "value", _SHARED)(get("conversations"))
    ),
    (["prompt", "response"], "struct<prompt:string,response:string>", _pair(lambda get: get("prompt"), "response")),
    (["completion", "prompt"], "struct<prompt:string,completion:string>", _pair(lambda get: get("prompt"), "completion")),
    (["answer", "question"], "struct<question:string,answer:string>", _pair(lambda get: get("question"), "answer")),
    (["instruction", "output"], "struct<instruction:string,output:string>", _pair(lambda get: get("instruction"), "output")),
    (["input", "instruction", "output"], "struct<instruction:string,input:string,output:string>", _pair(_with_input, "output")),
    (["prompt", "response", "system"], "struct<system:string,prompt:string,response:string>", _pair(lambda get: get("prompt"), "response", "system")),
]

#: One row for each turn: grouped by ``conv_id`` before it is mapped.
BY_TURN = ["role", "text", "turn"]


def fingerprint(paths: Column) -> Column:
    """64-bit hash of a sorted array of field paths."""
    return F.xxhash64(F.concat_ws("\n", F.array_sort(paths)))


def _fixed(paths: list[str]) -> Column:
    return fingerprint(F.array(*(F.lit(p) for p in paths)))


def _key(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _mappings() -> dict[str, tuple[set[str], Callable[[DataFrame, str], DataFrame]]]:
    def by_turn(df: DataFrame, id_col: str) -> DataFrame:
        turn = F.struct("turn", _turn(F.col("role"), F.col("text")).alias("t"))
        return df.groupBy(F.col(id_col).alias("conv_id")).agg(F.transform(F.sort_array(F.collect_list(turn)), lambda x: x["t"]).alias("turns"))

    out = {_key(set(BY_TURN)): (set(BY_TURN), by_turn)}
    for paths, _, turns in LAYOUTS:
        out[_key(set(paths))] = (set(paths), lambda df, id_col, turns=turns: df.select(F.col(id_col).alias("conv_id"), turns(F.col).alias("turns")))
    return out


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``conv_id, turns`` of a typed frame, by the fingerprint of its schema.

    Paths that no layout knows are ignored. Where the rest is no layout either, the layout with the most
    paths among them is taken; a frame that holds none is an error.
    """
    known = _mappings()
    have = set(field_paths(T.StructType([f for f in df.schema.fields if f.name != id_col]))) & set().union(*(p for p, _ in known.values()))
    chosen = known.get(_key(have)) or max((x for x in known.values() if x[0] <= have), key=lambda x: len(x[0]), default=None)
    if chosen is None:
        raise ValueError(f"no mapping for the field paths {sorted(have)}")
    return chosen[1](df, id_col)


def canonical_turns_json(df: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """``conv_id, fingerprint, layout, turns`` of JSON records, each by its own shape; unknown or broken ones get null turns.

    Paths down to the fields of a list's first element make the fingerprint; ``layout`` spells out the paths of the
    mapping that it selects.
    """
    raw = F.col(json_col)
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))

    def inside(name: str) -> Column:
        return F.transform(F.json_object_keys(F.get_json_object(raw, f"$.{name}[0]")), lambda x: F.concat(F.lit(f"{name}[]."), x))

    paths = keys
    for name in ("messages", "conversations"):
        got = inside(name)
        paths = F.when(F.array_contains(keys, name) & got.isNotNull(), F.concat(F.array_except(paths, F.array(F.lit(name))), got)).otherwise(paths)
    turns, layout = F.lit(None).cast(_NONE), F.lit(None).cast("string")
    out = df.select(
        F.col(id_col).alias("conv_id"), raw.alias("record"), fingerprint(F.array_except(paths, F.array(F.lit(id_col)))).alias("fingerprint")
    )
    for known, kind, make in LAYOUTS:
        record, hit = F.from_json(F.col("record"), kind), F.col("fingerprint") == _fixed(known)
        turns = F.when(hit, make(lambda f, r=record: r[f])).otherwise(turns)
        layout = F.when(hit, ",".join(known)).otherwise(layout)
    return out.select("conv_id", "fingerprint", layout.alias("layout"), turns.alias("turns"))


#: Characters that may not stand in a written role or text, and what stands for them; undone in the other order.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lbr;"), ("]", "&rbr;"))


def escape(c: Column) -> Column:
    for plain, written in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for plain, written in reversed(_ESCAPES):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def format_turns(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_mask``; the mask has ``start`` and ``length`` in code points of every ``learn`` text."""
    written = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == learn).alias("on"), F.concat(F.lit("<s>["), escape(t["role"]), F.lit("]")).alias("head"), escape(t["text"]).alias("body")
        )
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def step(acc: Column, w: Column) -> Column:
        start = acc["at"] + F.length(w["head"])
        span = F.array(F.struct(start.alias("start"), F.length(w["body"]).alias("length")))
        return F.struct(
            (start + F.length(w["body"]) + 4).alias("at"), F.when(w["on"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask")
        )

    return turns.select("conv_id", written.alias("w")).select(
        "conv_id", F.array_join(
            F.transform("w", lambda w: F.concat(w["head"], w["body"], F.lit("</s>"))), ""
        ).alias("formatted"), F.aggregate("w", zero, step)["mask"].alias("loss_mask")
    )


def parse_formatted(formatted: Column) -> Column:
    """Turns of a formatted string."""
    pieces = F.filter(F.split(formatted, r"</s>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, 5, 2**31 - 1), "]", 1)).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)^<s>\[[^\]]*\](.*)$", 1)).alias("text")
        )
    )
