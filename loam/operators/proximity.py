"""The tightest window of a document that covers every slot of a query, the words between, and the slots' order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.scanner import hits
from loam.plans.expand import Plan

UNMATCHED = 2147483647


def windows(tokens: DataFrame, plan: Plan, key: str = "doc_id") -> DataFrame:
    """(key, left_pos, right_pos, span, word_distance, ordered) of each document that covers all slots.

    tokens: (key, pos, term, raw_start, raw_end). A term counts for its first slot only. The window is the one of least
    span in characters, the first of several. word_distance is the number of words in it beyond one for each slot that
    the query asked, dropped ones included. ordered: the slots occur in their order somewhere in the document.
    """
    first = plan.slot_of()
    n = len(plan.slots)
    if plan.hopeless or len(set(first.values())) < n:
        return tokens.select(
            key, *[F.lit(0).alias(c) for c in ("left_pos", "right_pos", "span", "word_distance")], F.lit(True).alias("ordered")
        ).where(F.lit(False))
    listed = tokens.sparkSession.createDataFrame(list(first.items()), "term string, slot int")
    marked = tokens.join(F.broadcast(listed) if len(first) <= 100_000 else listed, "term")
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct("raw_start", "pos")
    for i in range(n):
        marked = marked.withColumn(f"s{i}", F.last(F.when(F.col("slot") == i, here), ignorenulls=True).over(so_far))
    left = F.least(*[F.col(f"s{i}") for i in range(n)]) if n > 1 else F.col("s0")
    covered = reduce(and_, [F.col(f"s{i}").isNotNull() for i in range(n)])
    span = F.col("raw_end") - left["raw_start"]
    best = F.min(F.when(covered, F.struct(span.alias("span"), F.col("pos").alias("right_pos"), left["pos"].alias("left_pos")))).alias("best")
    order = F.array_sort(F.collect_list(F.struct("pos", "slot"))).alias("order")
    found = marked.groupBy(key).agg(best, order).where("best IS NOT NULL")
    reached = F.aggregate("order", F.lit(0), lambda s, x: F.when(x["slot"] == s, s + 1).otherwise(s))
    return found.select(
        key,
        "best.left_pos",
        "best.right_pos",
        "best.span",
        word_distance(F.col("best.right_pos") - F.col("best.left_pos"), plan.slots_asked).alias("word_distance"),
        (reached >= n).alias("ordered"),
    )


def tightest(found: list[tuple[int, int, int, int]], n: int) -> tuple[int, int, int] | None:
    """(span, left place, right place) of the least span that covers slots 0 to n - 1, the first of several."""
    last: dict[int, tuple[int, int]] = {}
    best = None
    for place, slot, start, end in found:
        last[slot] = (start, place)
        if len(last) == n:
            left = min(last.values())
            if best is None or end - left[0] < best[0]:
                best = (end - left[0], left[1], place)
    return best


def in_order(found: list[tuple[int, int, int, int]], n: int) -> bool:
    want = 0
    for _, slot, _, _ in found:
        want += slot == want
    return want >= n


def windows_of_rows(rows: DataFrame, plan: Plan, key: str = "id", content: str = "content") -> DataFrame:
    """What windows gives, from the rows' texts themselves: a row's window is found where the row lies, so nothing is
    shuffled and no token leaves the worker."""
    names = ("left_pos", "right_pos", "span", "word_distance")
    schema = rows.select(key).schema
    for name in names:
        schema = schema.add(name, "integer")
    schema = schema.add("ordered", "boolean")
    slot_of, n, asked = plan.slot_of(), len(plan.slots), plan.slots_asked
    able = not plan.hopeless and len(set(slot_of.values())) == n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if able and (best := tightest(own := hits(text, slot_of), n)) is not None:
                    span, left, right = best
                    out.append((k, left, right, span, max(0, right - left - (asked - 1)), in_order(own, n)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], schema.names)

    return rows.select(key, content).mapInArrow(run, schema)


def word_distance(steps: Column, slots: int) -> Column:
    return F.greatest(steps - (slots - 1), F.lit(0))


def near(found: DataFrame, most: int = 10, ordered: bool = False) -> DataFrame:
    """The windows of at most so many words between, in order if asked."""
    rows = found.where(F.col("word_distance") <= most)
    return rows.where("ordered") if ordered else rows
