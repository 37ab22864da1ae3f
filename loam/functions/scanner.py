"""The same tokens with their places, for highlighting; offsets are in code points."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loam.functions.text import LONGEST, LOWER, SHORTEST, UPPER

#: Every character belongs to one of these: tag, entity of white space, other entity, vanishing character, letter, other.
PARTS = regex.compile(
    r"(?P<tag><[^>]*(?:>|\Z))|(?P<space>&(?:nbsp|ensp|emsp|\#0*(?:160|8194|8195|8201));)|(?P<entity>&[^;]{0,10};)"
    r"|(?P<gone>[&\"׳״]|(?![\x00-\x7F])\p{Mn})|(?P<letters>[a-zA-Zא-ת]+)|(?P<other>[^<&\"׳״a-zA-Zא-ת\p{Mn}]+|.)",
    regex.DOTALL,
)
FOLD = str.maketrans(UPPER, LOWER)
#: A text without these has its words where its letters are.
SPECIAL = regex.compile(r"[<&\"׳״]|(?![\x00-\x7F])\p{Mn}")
WORD = re.compile("[a-zא-ת]+")


class Token(NamedTuple):
    term: str
    start: int  # of the first letter
    end: int  # of what ended the word; a white-space entity counts from its semicolon
    visible: int  # visible characters before the word


def scan(text: str | None) -> list[Token]:
    text = text or ""
    if SPECIAL.search(text) is None:
        words = WORD.finditer(text.translate(FOLD))
        return [Token(m[0], m.start(), m.end(), m.start()) for m in words if SHORTEST <= m.end() - m.start() <= LONGEST]
    found: list[Token] = []
    word, start, visible = "", -1, 0

    def flush(end: int) -> None:
        nonlocal word
        if SHORTEST <= len(word) <= LONGEST:
            found.append(Token(word.translate(FOLD), start, end, visible - len(word)))
        word = ""

    for m in PARTS.finditer(text):
        kind = m.lastgroup
        if kind == "letters":
            start = start if word else m.start()
            word += m[0]
            visible += len(m[0])
        elif kind == "tag":
            flush(m.start())
        elif kind == "space":
            flush(m.end() - 1)
            visible += 1
        elif kind == "other":
            flush(m.start())
            visible += len(m[0])
    flush(len(text))
    return found


def hits(text: str | None, slot_of: dict[str, int]) -> list[tuple[int, int, int, int]]:
    """(place among the words, slot, start, end) of the words that have a slot."""
    text = text or ""
    if SPECIAL.search(text) is not None:
        return [(i, slot, t.start, t.end) for i, t in enumerate(scan(text)) if (slot := slot_of.get(t.term)) is not None]
    found, place = [], 0
    for m in WORD.finditer(text.translate(FOLD)):
        if SHORTEST <= m.end() - m.start() <= LONGEST:
            if (slot := slot_of.get(m[0])) is not None:
                found.append((place, slot, m.start(), m.end()))
            place += 1
    return found


def positional_tokens(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, term, raw_start, raw_end, visible_start) of every token of df's texts."""
    schema = df.select(key).schema.add("pos", "integer").add("term", "string")
    for name in ("raw_start", "raw_end", "visible_start"):
        schema = schema.add(name, "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                rows = [
                    (k, i, *t)
                    for k, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                    for i, t in enumerate(scan(body))
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [part.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], schema.names)

    return df.select(key, text).mapInArrow(run, schema)
