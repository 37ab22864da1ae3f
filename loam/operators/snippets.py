"""Highlighted snippets of matching rows, as an Arrow function of the content alone."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.scanner import Token, scan
from loam.operators.proximity import UNMATCHED
from loam.plans.expand import Plan

CONTEXT, CEILING = 8, 4000
MARK = ("<mark>", "</mark>")
BARE = re.compile(r"<[^>]*(?:>|\Z)|\{[א-ת]\}")


def bare(text: str) -> str:
    return BARE.sub("", text)


def tightest(tokens: list[Token], slot_of: dict[str, int], n: int) -> tuple[int, int, int] | None:
    """(span, left, right) of the least span that covers slots 0 to n - 1, the first of several."""
    last: dict[int, int] = {}
    best = None
    for i, t in enumerate(tokens):
        if (slot := slot_of.get(t.term)) is not None:
            last[slot] = i
            if len(last) == n:
                left = min(last.values())
                span = t.end - tokens[left].start
                if best is None or span < best[0]:
                    best = (span, left, i)
    return best


def in_order(tokens: list[Token], slot_of: dict[str, int], n: int) -> bool:
    want = 0
    for t in tokens:
        want += slot_of.get(t.term) == want
    return want >= n


def shown(tokens: list[Token], left: int, right: int, length: int, context: int) -> tuple[int, int]:
    """The characters to show: some words on each side, fewer where more than CEILING visible characters would show; the
    cheaper side is trimmed, never the match."""
    a, b = max(0, left - context), min(len(tokens) - 1, right + context)
    stop = lambda i: tokens[i].visible + len(tokens[i].term)
    while a < b and stop(b) - tokens[a].visible > CEILING and (a < left or b > right):
        save_left = tokens[a + 1].visible - tokens[a].visible if a < left else UNMATCHED
        save_right = stop(b) - stop(b - 1) if b > right else UNMATCHED
        a, b = (a + 1, b) if save_left <= save_right else (a, b - 1)
    return (0 if a == 0 else tokens[a].start), (tokens[b].end if b + 1 < len(tokens) else length)


def visible_part(text: str, a: int, b: int) -> str:
    """text[a:b] without tags (one that is open at a included) and {X} marks."""
    opened, closed = text.rfind("<", 0, a), text.rfind(">", 0, a)
    if opened > closed:
        end = text.find(">", a, b)
        a = b if end < 0 else end + 1
    return bare(text[a:b])


def snippet(text: str | None, slots: list[list[str]], asked: int = 0, ordered: bool = False, context: int = CONTEXT, mark=MARK) -> dict:
    """html, score (the window's span), word_distance and is_match of a content for expanded slots; asked: slots of the
    query, dropped ones included. Without a match html is the whole content, stripped, and the numbers are UNMATCHED."""
    text = text or ""
    tokens = scan(text) if slots else []
    slot_of: dict[str, int] = {}
    for i, terms in enumerate(slots):
        for t in terms:
            slot_of.setdefault(t, i)
    best = tightest(tokens, slot_of, len(slots)) if tokens else None
    if best is None:
        return {"html": bare(text), "score": UNMATCHED, "word_distance": UNMATCHED, "is_match": False}
    span, left, right = best
    a, b = shown(tokens, left, right, len(text), context)
    out, at = ["…" if a > 0 else ""], a
    for t in tokens:
        if t.end > a and t.start < b and t.term in slot_of:
            out += [visible_part(text, at, t.start), mark[0], text[t.start : min(t.end, b)], mark[1]]
            at = t.end
    out += [visible_part(text, at, b) if at < b else "", "…" if b < len(text) else ""]
    return {
        "html": "".join(out),
        "score": span,
        "word_distance": max(0, right - left - ((asked or len(slots)) - 1)),
        "is_match": not ordered or in_order(tokens, slot_of, len(slots)),
    }


def with_snippets(rows: DataFrame, plan: Plan, content: str = "content", ordered: bool = False, context: int = CONTEXT, mark=MARK) -> DataFrame:
    """rows with html, score, word_distance and is_match of their content added."""
    added = ("html", "score", "word_distance", "is_match")
    rest = [c for c in rows.columns if c not in added]
    schema = rows.select(*rest).schema.add("html", "string").add("score", "integer").add("word_distance", "integer").add("is_match", "boolean")
    at, slots, asked = rest.index(content), plan.slots, plan.slots_asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [snippet(t, slots, asked, ordered, context, mark) for t in batch.column(at).to_pylist()]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_())
            columns = [pa.array([f[c] for f in found], k) for c, k in zip(added, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return rows.select(*rest).mapInArrow(run, schema)


def results_page(rows: DataFrame, direction: str = "rtl") -> DataFrame:
    """(page) of one row: an HTML page of a page of results (id, title, html), in order of id. It is one value, so rows
    should be a page that was cut before. Titles are escaped; snippets have no tags but their marks."""
    title = F.col("title")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        title = F.replace(title, F.lit(sign), F.lit(entity))
    item = F.concat(F.lit("<section><h2>"), F.coalesce(title, F.lit("")), F.lit("</h2><p>"), "html", F.lit("</p></section>"))
    items = F.array_sort(F.collect_list(F.struct("id", item.alias("item"))))["item"]
    head = f'<!DOCTYPE html><html dir="{direction}"><head><meta charset="utf-8"></head><body>'
    return rows.agg(F.concat(F.lit(head), F.array_join(items, ""), F.lit("</body></html>")).alias("page"))
