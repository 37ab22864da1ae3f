"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k draw.

A document's importance is the ratio of its likelihoods under two bag-of-n-grams models over hashed buckets: one of the
target (documents labelled of good quality), one of all raw text. A draw without replacement in proportion to importance
is the k largest of log importance plus Gumbel noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import BROADCAST_ROWS, crc_mod, lean, scope, table, written
from loam.llm.ngrams import gram_hashes, pieces, text_bytes, word_hashes
from loam.llm.urls import block_words, build_filter

#: Buckets of each kind of n-gram: words and word pairs, and pairs of word shapes.
BUCKETS, SHAPES = 1 << 14, 1 << 10
SIZE = 2 * BUCKETS + SHAPES
#: N-grams for each bucket that every model has beforehand: spread evenly in the raw model, as the raw model in the target.
SMOOTHING, PRIOR = 0.5, 8.0


def word_shapes(raw: np.ndarray, ends: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A small code for each word: whether it equals the word before, whether it has capitals only (two or more), how many
    of its bytes are marks, and its length, both in four steps."""
    space = np.isin(raw, np.array([9, 10, 11, 12, 13, 32], dtype=np.uint8))
    word = ~space
    stop = word.copy()
    stop[:-1] &= space[1:]
    stop[(ends[1:] - 1)[np.diff(ends) > 0]] = word[(ends[1:] - 1)[np.diff(ends) > 0]]
    end = np.flatnonzero(stop)
    start = word.copy()
    start[1:] &= space[:-1]
    edge = ends[:-1][np.diff(ends) > 0]
    start[edge] = word[edge]
    first = np.flatnonzero(start)
    upper, lower = (np.concatenate([[0], np.cumsum((raw >= a) & (raw <= b))]) for a, b in ((65, 90), (97, 122)))
    mark = (raw < 128) & word & ~(((raw | 32) >= 97) & ((raw | 32) <= 122)) & ~((raw >= 48) & (raw <= 57))
    marks = np.concatenate([[0], np.cumsum(mark)])
    capitals = (upper[end + 1] - upper[first] > 1) & (lower[end + 1] == lower[first])
    again = np.zeros(len(words), dtype=bool)
    again[1:] = words[1:] == words[:-1]
    again[bounds[:-1][bounds[:-1] < len(words)]] = False
    n_marks = np.minimum(marks[end + 1] - marks[first], 3)
    length = np.minimum((end + 1 - first) // 4, 3)
    return (again * 32 + capitals * 16 + n_marks * 4 + length).astype(np.int64)


def buckets(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram of a batch's texts, and its row."""
    raw, ends = text_bytes(batch.column(column))
    words, bounds = word_hashes(raw, ends)
    pairs, pair_bounds = gram_hashes(words, bounds, 2)
    shapes = word_shapes(raw, ends, words, bounds)
    inner = np.ones(len(words), dtype=bool)
    inner[bounds[:-1][bounds[:-1] < len(words)]] = False
    before = np.where(inner, np.concatenate([[0], shapes[:-1]]) if len(shapes) else shapes, 63)  # 63: no word before
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(bounds))
    where = np.concatenate(
        [
            (words >> np.uint64(50)).astype(np.int64),
            BUCKETS + (pairs >> np.uint64(50)).astype(np.int64),
            2 * BUCKETS + ((before * 64 + shapes) * 2654435761 >> 12 & SHAPES - 1),
        ]
    )
    return where, np.concatenate([rows, np.repeat(np.arange(len(ends) - 1), np.diff(pair_bounds)), rows])


def count_buckets(df: DataFrame, text: str, weight: str) -> np.ndarray:
    """Counts of all n-grams (row 0) and of those of documents whose `weight` column is true (row 1). Each task sends one
    array of counts, of a fixed size; they are summed by blocks of buckets before anything goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE), dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                where, rows = buckets(part, 0)
                chosen = np.asarray(part.column(1).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
                total[0] += np.bincount(where, minlength=SIZE)
                if chosen.any():
                    total[1] += np.bincount(where[chosen[rows]], minlength=SIZE)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "n", "m"])

    found = df.select(text, weight).mapInArrow(lean(run), "bucket long, n long, m long")
    out = np.zeros((2, SIZE))
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toLocalIterator():  # SIZE rows
        out[:, r["bucket"]] = r["n"], r["m"]
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket, each kind of n-gram normalised by itself."""
    out = np.zeros(SIZE)
    for a, b in ((0, BUCKETS), (BUCKETS, 2 * BUCKETS), (2 * BUCKETS, SIZE)):
        raw = (counts[0, a:b] + SMOOTHING) / (counts[0, a:b] + SMOOTHING).sum()
        target = counts[1, a:b] + PRIOR * (b - a) * raw
        out[a:b] = np.log(target / target.sum()) - np.log(raw)
    return out


def log_importance(df: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """df with log_weight (double) and n_grams (long) added: the sum of the n-grams' log ratios, and their number."""
    rest = [c for c in df.columns if c not in ("log_weight", "n_grams")]
    schema = df.select(*rest).schema.add("log_weight", "double").add("n_grams", "long")
    at, model = rest.index(text), df.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                where, rows = buckets(part, at)
                sums = np.bincount(rows, model.value[where], minlength=part.num_rows).astype(np.float64)  # no n-grams give integers
                sizes = np.bincount(rows, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sums), pa.array(sizes)], [*rest, "log_weight", "n_grams"])

    return df.select(*rest).mapInArrow(lean(run), schema)


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that follows from the key and the seed alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def ordered_bits(x: Column) -> Column:
    """The double's bits as a long in the same order (for finite numbers), from its rounding to 1e-9."""
    return F.round(x * 1e9).cast("long")


def top_k(df: DataFrame, score: str, tie: Column, k: int) -> DataFrame:
    """df with selected (boolean): the k rows of the largest (score, tie), score a long; ties of both are all one side, so
    that repeated rows fall together. A radix search: counts over 2^16 ranges of the score, then inside the range that
    holds the k-th, and so on; nothing is sorted, and the driver sees counts of at most 2^16 ranges at a time."""
    pair = df.withColumn("_hi", F.col(score)).withColumn("_lo", tie)
    need = k
    total = df.count()
    if k >= total or k <= 0:
        return df.withColumn("selected", F.lit(k > 0))
    cut: dict[str, int] = {}
    for name in ("_hi", "_lo"):
        own = pair
        for c, v in cut.items():
            own = own.where(F.col(c) == v)
        lo, hi = own.agg(F.min(name), F.max(name)).first()
        while lo < hi:
            width = max(1, -(-(hi - lo + 1) // (1 << 16)))
            part = own.where(F.col(name).between(lo, hi))
            place = F.floor((F.col(name).cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")) / F.lit(width)).cast("long")
            counts = sorted(((r[0], r[1]) for r in part.groupBy(place.alias("b")).count().collect()), reverse=True)
            for b, n in counts:
                if n >= need:
                    lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                    break
                need -= n
        cut[name] = lo
    above = (F.col("_hi") > cut["_hi"]) | ((F.col("_hi") == cut["_hi"]) & (F.col("_lo") >= cut["_lo"]))
    return pair.withColumn("selected", above).drop("_hi", "_lo")


def keep_count(scored: DataFrame, labels: DataFrame, training: Column, key: str, label: str) -> int:
    """How many documents to draw: as many as have a log importance of at least a bound, which is the highest that at
    most one in two hundred of the training rows labelled good fall below, lowered to the middle of the gap to the rows
    labelled bad where there is one. Without labels of either kind, all documents."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    known = scored.where(training).join(marked, key)
    good, bad = (
        known.where(F.col("y") == y).agg(F.percentile_approx("log_weight", share, 100_000)).first()[0]
        for y, share in ((1, 0.005), (0, 0.98))
    )
    if good is None or bad is None:
        return scored.count()
    bound = (good + bad) / 2 if bad < good else good
    return scored.where(F.col("log_weight") >= bound).count()


def resample(
    docs: DataFrame, labels: DataFrame, training: Column, k: int | None = None, seed: int = 7, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """(key, text's hash, log_weight, n_grams, gumbel_key, selected) of every row of docs.

    The target model counts the documents labelled 1 for which `training` (a condition on the key) holds, the raw model
    all documents; both count whole texts. k documents with the largest log importance plus Gumbel noise are selected;
    k is keep_count's if none is given. The noise follows from the key and the seed, so the draw can be repeated, and
    repeated rows are selected together. Null and empty texts have log importance 0. Texts of any length count whole. An
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    with scope():
        return written(_resampled(docs, labels, training, k, seed, key, text, label), "resampled", keep=True)


def model_counts(docs: DataFrame, target: DataFrame, training: Column, key: str, text: str) -> np.ndarray:
    """count_buckets with the training documents whose key is in target as the weighted ones. Few keys go to where the
    texts lie. Of many, a Bloom filter picks the texts that are likely theirs; only these are shuffled, to an exact join,
    and counted in a pass of their own."""
    own = docs.select(F.col(key), F.col(text))
    if target.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marked = own.join(F.broadcast(target.withColumn("_target", F.lit(True))), key, "left")
        return count_buckets(marked.withColumn("_target", F.coalesce("_target", F.lit(False)) & training), text, "_target")
    hashes = target.select(F.xxhash64(key).alias("h"))
    held = docs.sparkSession.sparkContext.broadcast(build_filter(hashes, hashes.count()))

    @F.pandas_udf("boolean")
    def likely(h: pd.Series) -> pd.Series:
        block, bits = block_words(h.to_numpy().astype(np.int64).view(np.uint64), len(held.value))
        return pd.Series(((held.value[block] & bits) == bits).all(axis=1))

    some = own.where(F.col(key).isNotNull() & training).where(likely(F.xxhash64(key))).join(target, key, "left_semi")
    raw = count_buckets(own.withColumn("_target", F.lit(False)), text, "_target")
    raw[1] = count_buckets(some.withColumn("_target", F.lit(True)), text, "_target")[1]
    return raw


def _resampled(docs: DataFrame, labels: DataFrame, training: Column, k: int | None, seed: int, key: str, text: str, label: str) -> DataFrame:
    target = written(labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(key).distinct(), "target")
    counts = model_counts(docs, target, training, key, text)
    ratios = log_ratios(counts) if counts[1].sum() else np.zeros(SIZE)
    base = docs.select(F.col(key), F.col(text), F.xxhash64(text).alias("text_hash"))
    scored = log_importance(base, ratios, text).select(
        key, "text_hash", "log_weight", "n_grams", (F.col("log_weight") + gumbel(F.col(key), seed)).alias("gumbel_key")
    )
    scored = written(scored.withColumn("_order", ordered_bits(F.col("gumbel_key"))), "importance")
    size = keep_count(scored, labels, training, key, label) if k is None else k
    tie = F.xxhash64(F.col(key), F.col("text_hash"))
    return top_k(scored, "_order", tie, size).drop("_order")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance and whether it is drawn; see resample for nulls, repeats and empty tables."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return found.select("doc_id", "n_grams", F.round("log_weight", 6).alias("log_weight"), F.round("gumbel_key", 6).alias("gumbel_key"), "selected")
