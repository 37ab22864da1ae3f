"""Set algebra on postings (term, doc_id): which documents match an expanded query."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.plans.expand import MARKS

#: Terms up to which a slot map is a list in the filter; beyond it, a joined table.
MOST_LISTED = 200


def none(postings: DataFrame) -> DataFrame:
    return postings.select("doc_id").where(F.lit(False))


def of_terms(postings: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of some terms; the filter reaches the sorted files."""
    if len(terms) <= MOST_LISTED:
        return postings.where(F.col("term").isin(terms))
    listed = postings.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return postings.join(F.broadcast(listed) if len(terms) <= 100_000 else listed, "term", "left_semi")


def any_of(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id) of documents with one of the terms."""
    return of_terms(postings, terms).select("doc_id").distinct() if terms else none(postings)


def all_of(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id) of documents with every term."""
    return match(postings, [[t] for t in terms])


def match(postings: DataFrame, slots: list[list[str]]) -> DataFrame:
    """(doc_id) of documents that have a term of each slot: relational division in one aggregation, whatever the number
    of terms. An empty slot, or no slot, matches nothing."""
    slots = list({tuple(dict.fromkeys(s)): None for s in slots})
    if not slots or not all(slots):
        return none(postings)
    if len(slots) == 1:
        return any_of(postings, list(slots[0]))
    marks: dict[str, int] = {}
    for i, terms in enumerate(slots):
        for t in terms:
            marks[t] = marks.get(t, 0) | 1 << (i % 62)
    if len(slots) > 62:  # in two halves
        left, right = match(postings, [list(s) for s in slots[:62]]), match(postings, [list(s) for s in slots[62:]])
        return left.join(right, "doc_id", "left_semi")
    rows = of_terms(postings, list(marks))
    listed = postings.sparkSession.createDataFrame(list(marks.items()), "term string, mark long")
    held = rows.join(F.broadcast(listed) if len(marks) <= 100_000 else listed, "term")
    return held.groupBy("doc_id").agg(F.bit_or("mark").alias("m")).where(F.col("m") == (1 << len(slots)) - 1).select("doc_id")


def match_marked(postings: DataFrame, terms: DataFrame, slots: int) -> DataFrame:
    """match for terms that are a table, as expand.marked gives them: any number, joined as Spark finds best."""
    wanted = [min(MARKS, slots - k) for k in range(0, slots, MARKS)]
    held = postings.join(terms, "term").groupBy("doc_id").agg(*[F.bit_or(f"m{i}").alias(f"m{i}") for i in range(len(wanted))])
    return held.where(reduce(and_, [F.col(f"m{i}") == (1 << n) - 1 for i, n in enumerate(wanted)])).select("doc_id")


def term_counts(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df) of the terms that occur."""
    return of_terms(postings, terms).groupBy("term").agg(F.count("*").alias("df"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, side) of ids that only one side has; each side is computed once."""
    both = left.select("doc_id", F.lit(1).alias("mark")).unionByName(right.select("doc_id", F.lit(2).alias("mark")))
    held = both.groupBy("doc_id").agg(F.bit_or("mark").alias("m")).where("m < 3")
    return held.select("doc_id", F.when(F.col("m") == 1, "left").otherwise("right").alias("side"))
