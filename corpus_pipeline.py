"""A corpus pipeline of five stages, each an operator of loam.llm: toxicity, quality, near duplicates, decontamination, BPE.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: the documents that stay, with documents' columns (the last
one returns token ids). A stage finds the rows to remove by their key and text's hash, on narrow columns; documents'
texts are then filtered where they lie (or joined by that hash where very many go).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import bpe, decontaminate, quality, setjoin, toxicity
from loam.llm.common import bound_batches, restored, scope, small, table, written

#: Encoded pieces that a worker keeps: few, as executors of a long session have little memory left beside their heap.
KEPT_PIECES = 100_000
#: No SQL: learned scores and byte-pair encoding are beyond it. tests/llm compares stages with brute force.
ORACLE_SQL = None


def same_row(rows: DataFrame) -> Column:
    """Whether a document (its id, its text's hash as _text) is one of rows (_id, _hash); null ids are values like others."""
    return F.col("doc_id").eqNullSafe(rows["_id"]) & F.col("_text").eqNullSafe(rows["_hash"])


def joined(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The docs that are, or are not, among rows (doc_id, text_hash): by id and by text, not by one hash of both."""
    listed = rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    listed = small(written(listed, "rows"))
    return docs.withColumn("_text", F.xxhash64("text")).join(listed, same_row(listed), how).select(docs.columns)


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows (doc_id, text_hash)."""
    return joined(docs, rows, "left_anti")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity under a half; those without text stay, repeated rows go or stay together. Learned from a
    bounded sample of the labelled documents (see toxicity.fit)."""
    bound_batches(spark)
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score_toxicity(docs, scorer).where("toxicity < 0.5").select(docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws; those without text have importance 1, and repeated rows are drawn
    together. Learned from all labelled documents."""
    bound_batches(spark)
    found = quality.resample(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return without(docs, found.where("NOT selected"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that of the least doc_id; of repeated rows one. Documents
    without words all stay."""
    bound_batches(spark)
    found = setjoin.near_duplicates(docs)
    kept = without(docs, setjoin.extra_rows(found))
    repeated = found.where("component IS NOT NULL").groupBy("doc_id", "text_hash").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return joined(kept, repeated, "left_anti").unionByName(joined(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in windows of benchmark items; those without words stay, and
    repeated rows go or stay together."""
    bound_batches(spark)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    dirty = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return without(docs, dirty.select("doc_id", "text_hash"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): ids are little-endian unsigned 32-bit integers. A null or empty
    text has none; repeated rows each have theirs."""
    bound_batches(spark)
    found = bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), kept=KEPT_PIECES)
    return found.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxic),
    ("quality classifier", good),
    ("n-gram Jaccard join", unlike),
    ("benchmark decontamination", clean),
    ("BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = bound_batches(spark)
    try:
        for name, stage in STAGES:
            with scope():
                docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower(), keep=True)
    finally:
        restored(spark, before)
    return docs
