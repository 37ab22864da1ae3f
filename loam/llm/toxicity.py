"""Toxicity by multiple-instance learning: a document's sentences are the instances, its label is the bag's.

A sentence's evidence z is the sum of its words' weights (none negative), its probability s(b + z) - s(b) over 1 - s(b),
s the logistic function, so that a sentence without evidence has 0; the document's is the noisy-or of its sentences and a
small leak. Weights and b are learned from documents' labels alone, by gradient steps on the bags' likelihood with an L1
penalty; a sentence's probability then shows where a document offends.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.bpe import parts
from loam.llm.common import crc_mod, lean, table

#: The bounded sample of labelled rows that the weights are fitted on: so many of each label, of texts of at most so many
#: characters (longer labelled texts are left to scoring).
SAMPLE, LONGEST = 1500, 6_000
#: Lengths of word beginnings that are features beside whole words.
STEMS = (4, 5, 6, 7, 8)
#: Sentences of label-1 documents that a feature must be in to have weight, whatever the number of documents.
LEAST = 3
#: Words that a worker keeps weighed, and characters that it handles at once.
KEPT, TOGETHER = 200_000, 2_000_000
WORD = re.compile(r"[^\W_]+")
STOP = re.compile(r"[.!?][\"')\]»]*$")
BREAK = 1000.0


def word_features(chunk: str) -> list[str]:
    out = []
    for w in WORD.findall(chunk.lower()):
        out.append(w)
        out += [w[:n] + "*" for n in STEMS if len(w) > n]
    return out


def chunks(text: str) -> list[str]:
    return text.replace("\n", " \n ").split(" ")


def ends_sentence(chunk: str) -> bool:
    return chunk == "\n" or STOP.search(chunk) is not None


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the text's sentences, in characters."""
    out, start, at = [], 0, 0
    for line in text.split("\n"):
        for chunk in line.split(" "):
            at += len(chunk) + 1
            if ends_sentence(chunk):
                out.append((start, at - 1))
                start = at
        if at - 1 > start:
            out.append((start, at - 1))
        start = at
    return out


def instances(text: str) -> Iterator[set[str]]:
    """The features of each sentence."""
    for a, b in sentences(text):
        if own := {f for c in text[a:b].split() for f in word_features(c)}:
            yield own


def train(texts: list[str], labels: np.ndarray, steps: int = 400, rate: float = 0.1, penalty: float = 0.3) -> tuple[dict[str, float], float, float]:
    """Weights of features, b and the leak. Without a document of label 1 nothing has weight."""
    positive, negative = Counter(), Counter()
    for t, y in zip(texts, labels, strict=True):
        if y:
            positive.update({f for s in instances(t) for f in s})
    for t, y in zip(texts, labels, strict=True):
        if not y:
            negative.update({f for s in instances(t) for f in s if f in positive})
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    names = sorted(f for f, c in positive.items() if c >= LEAST and c / n1 > 4 * negative[f] / n0)
    leak, penalty = 0.02, penalty / n1
    if not names:
        return {}, -4.0, leak
    index = {f: i for i, f in enumerate(names)}
    doc, row, col = [], [], []
    for d, t in enumerate(texts):
        for s in instances(t):
            if own := [index[f] for f in s if f in index]:
                row += [len(doc)] * len(own)
                col += own
                doc.append(d)
    doc, row, col = np.array(doc, dtype=np.int64), np.array(row, dtype=np.int64), np.array(col, dtype=np.int64)
    y = labels.astype(float)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, b = np.full(len(names), 0.5), -4.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    logistic = lambda x: 1 / (1 + np.exp(-x))
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], minlength=len(doc))
        s0, s1 = logistic(b), logistic(b + z)
        p = np.clip((s1 - s0) / (1 - s0), 0, 1 - 1e-9)
        none = np.log1p(-p)
        clean = np.log1p(-leak) + np.bincount(doc, none, minlength=len(y))  # log of the chance that no sentence offends
        toxic = -np.expm1(clean)
        # d loss / d clean: label 0 wants clean high; label 1 wants 1 - exp(clean) high
        g = weight * np.where(y == 1, np.exp(clean) / np.maximum(toxic, 1e-9), -1.0)
        # none = log((1 - s1) / (1 - s0)): d none / dz = -s1, d none / db = s0 - s1
        gz = g[doc] * -s1
        grad = np.append(np.bincount(col, gz[row], minlength=len(w)) + penalty, (g[doc] * (s0 - s1)).sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = np.clip(w - step[:-1], 0, 20), float(np.clip(b - step[-1], -6, -2.5))
    return {f: float(x) for f, x in zip(names, w, strict=True) if x > 0.02}, b, leak


class Scorer:
    def __init__(self, weights: dict[str, float], b: float, leak: float):
        self.weights, self.b, self.leak = weights, b, leak
        self.base = 1 / (1 + np.exp(-b))
        self.kept: dict[str, float] = {}

    def weigh(self, chunk: str) -> float:
        z = min(100.0, sum(self.weights.get(f, 0.0) for f in word_features(chunk)))
        return z + BREAK * ends_sentence(chunk)

    def evidence(self, z: np.ndarray) -> np.ndarray:
        return np.clip((1 / (1 + np.exp(-(self.b + z))) - self.base) / (1 - self.base), 0, 1)

    def score(self, text: str) -> tuple[float, list[dict]]:
        """The document's probability, and the spans of its sentences of a half or more, with theirs."""
        own, kept = chunks(text), self.kept
        for c in set(own).difference(kept):
            kept[c] = self.weigh(c)
        x = np.fromiter(map(kept.__getitem__, own), dtype=np.float64, count=len(own))
        if len(kept) > KEPT:
            kept.clear()
        stop = x >= BREAK / 2
        w = x - BREAK * stop
        if not w.any():
            return self.leak, []
        sentence = np.cumsum(stop) - stop
        p = self.evidence(np.bincount(sentence, w))
        score = float(-np.expm1(np.log1p(-self.leak) + np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
        spans = []
        if (p >= 0.5).any():
            for a, b in sentences(text):
                part = text[a:b]
                z = sum(self.weigh(c) % BREAK for c in part.split(" ") if c)
                if (q := float(self.evidence(np.array([z]))[0])) >= 0.5:
                    spans.append({"start": a, "end": b, "p": q})
        return score, spans


def fit(docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """Fits on a bounded sample of labelled rows for which `training` (a condition on the key) holds: of each label, the
    SAMPLE rows with the least hashes of the key. Rows without text or label are left out; of several labels of one key
    the largest counts."""
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    sizes = docs.where(training & (F.length(text) <= LONGEST)).select(key, F.xxhash64(F.col(key)).alias("h"))
    known = sizes.join(marked, key).distinct()  # keys and hashes only
    chosen = [r for y in (1, 0) for r in known.where(F.col("y") == y).orderBy("h", key).limit(SAMPLE).collect()]
    keys = spark.createDataFrame([(r[key], r["y"]) for r in chosen], docs.select(key).schema.add("y", "integer"))
    # A row for each chosen key, the text of least hash: repeated keys cannot push out others.
    own = docs.select(key, F.col(text).alias("text")).where(F.length("text") <= LONGEST).join(F.broadcast(keys), key)
    least = own.groupBy(key, "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    rows = least.select(key, "y", "one.text").orderBy(key).collect()  # 2 * SAMPLE at most
    return Scorer(*train([r["text"] for r in rows], np.array([r["y"] for r in rows], dtype=np.int64)))


def score_toxicity(df: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """df with toxicity (double) and offending (array of spans: start, end in characters, p) added, columns so named
    replaced. Only the text is an input. Null and empty texts score the leak and have no spans; repeated rows score the
    same; texts of any length are read whole; an empty table gives no rows; other columns are kept. No shuffle."""
    rest = [c for c in df.columns if c not in ("toxicity", "offending")]
    span = T.StructType().add("start", "integer").add("end", "integer").add("p", "double")
    schema = df.select(*rest).schema.add("toxicity", "double").add("offending", T.ArrayType(span))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    at, model = rest.index(text), df.sparkSession.sparkContext.broadcast((scorer.weights, scorer.b, scorer.leak))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*model.value)
        for batch in batches:
            for part in parts(batch, at, TOGETHER):
                found = [own.score(t or "") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([x for _, x in found], kind)],
                    [*rest, "toxicity", "offending"],
                )

    return df.select(*rest).mapInArrow(lean(run), schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; see fit for labels and score_toxicity for nulls, repeats and empty tables."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = fit(docs, labels, crc_mod("doc_id", 5) != 0)
    return score_toxicity(docs.select("doc_id", "text"), scorer).select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        "offending",
    )
