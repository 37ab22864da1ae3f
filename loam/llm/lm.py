"""Language-model scores by deleted interpolation of word bigrams and unigrams.

    p(w | h) = lambda[bucket of c(h)] * c(h, w) / c(h) + (1 - lambda[...]) * p(w),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

Counts are of the training documents. The weights are learned by expectation-maximisation: a tenth of the training
documents is deleted from the counts, and its bigrams are the held-out events.

How it runs. Documents are packed into blocks of some MB, written once: each has the sorted distinct word hashes and every
document's words as places among them; some blocks of a task are a group. A group sends each count reducer its blocks'
distinct words and bigrams (hashes, sorted, with their counts) as one packed message; so a word sends one entry a block
however common it is. Reducers own a range of the hash space, add up the counts, and answer each message with its own
entries' counts. Groups then score their documents, block by block. As in any shuffle, there are at most groups times
reducers messages, and never more than entries; a message's own cost is some tens of bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import crc_mod, lean, scope, table, written
from loam.llm.ngrams import mix, pieces, text_bytes, word_hashes

#: Bytes of text in a block (a single longer document is a block of its own).
BLOCK = 10_000_000
#: Blocks of a group, which send and get counts together: bounds what a task holds of them.
GROUP = 4
#: Bytes of packed hashes that one count reducer aims at.
REDUCER = 16_000_000
#: Bytes below which packed numbers are not compressed.
FEW = 100
#: What stands for a document's beginning and end among word hashes.
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Context-frequency buckets (powers of two), cells of the events' likelihood ratio (eighths of a power of two), EM steps.
BUCKETS, CELLS, STEPS = 40, 1024, 60


def pack(x: np.ndarray, sorted_values: bool = False) -> bytes:
    """Unsigned integers as bytes, plane by plane, compressed unless they are few; those in (several) sorted runs as
    differences."""
    x = np.ascontiguousarray(x)
    if sorted_values and len(x):
        x = np.diff(x, prepend=np.zeros(1, x.dtype))
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T if len(x) else np.zeros((x.itemsize, 0), np.uint8)
    raw = planes.tobytes()
    few = len(raw) < FEW
    return struct.pack("<BBI", x.itemsize, sorted_values | few << 1, len(x)) + (raw if few else zstandard.ZstdCompressor(level=1).compress(raw))


def unpack(b: bytes) -> np.ndarray:
    size, flags, n = struct.unpack_from("<BBI", b)
    raw = b[6:] if flags & 2 else zstandard.ZstdDecompressor().decompress(b[6:], max_output_size=n * size)
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(f"<u{size}").ravel()
    return np.cumsum(x, dtype=x.dtype) if flags & 1 else x


def narrow(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest unsigned type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def bigrams(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def make_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(group, block, ids, parts, sizes, words, stream): the keys and training parts of a block's documents (part 0: not for
    training, 1: held out for the weights, 2: counted), their numbers of words, the distinct word hashes, and all words
    as places among these. The number of a block is that of its task and its place there, a group's that of its first block."""
    id_type = pa.list_(pa.int64())
    columns = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.col("part").cast("int"), F.spark_partition_id().alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list = []
        sizes: list = []
        hashes: list = []
        held = made = task = 0

        def block() -> pa.RecordBatch:
            h = np.concatenate(hashes)
            words, stream = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task << 32 | made - made % GROUP], pa.int64()),
                    pa.array([task << 32 | made], pa.int64()),
                    pa.array([ids], id_type),
                    pa.array([np.concatenate(parts).astype(np.uint8).tobytes()], pa.binary()),
                    pa.array([pack(np.concatenate(sizes).astype(np.uint32))], pa.binary()),
                    pa.array([pack(words, True)], pa.binary()),
                    pa.array([pack(narrow(stream))], pa.binary()),
                ],
                ["group", "block", "ids", "parts", "sizes", "words", "stream"],
            )

        for batch in batches:
            for part in pieces(batch, 1):
                raw, ends = text_bytes(part.column(1))
                if held and held + len(raw) > BLOCK:
                    yield block()
                    ids, parts, sizes, hashes, held, made = [], [], [], [], 0, made + 1
                h, bounds = word_hashes(raw, ends)
                task = part.column(3)[0].as_py()
                ids += part.column(0).to_pylist()
                parts.append(part.column(2).to_numpy(zero_copy_only=False))
                sizes.append(np.diff(bounds))
                hashes.append(h)
                held += len(raw)
        if ids:
            yield block()

    return columns.mapInArrow(lean(run), "group long, block long, ids array<long>, parts binary, sizes binary, words binary, stream binary")


class Block:
    """A block unpacked: for every token (its words, then an end, for each document) the place of its word and of the word
    before among `words` (with END and BEGIN as the last two places), its bigram's place among the distinct bigrams
    (`pairs`), its document and its document's part."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        words, stream, sizes = unpack(row["words"]), unpack(row["stream"]).astype(np.int64), unpack(row["sizes"]).astype(np.int64)
        self.n_words, n = len(words), len(sizes)
        self.words = np.concatenate([words, np.array([END, BEGIN])])
        self.sizes = sizes + 1
        total = len(stream) + n
        last = np.cumsum(self.sizes) - 1
        token = np.full(total, self.n_words, dtype=np.int64)
        inner = np.ones(total, dtype=bool)
        inner[last] = False
        token[inner] = stream
        before = np.empty(total, dtype=np.int64)
        before[1:] = token[:-1]
        before[last - self.sizes + 1] = self.n_words + 1
        self.token, self.before, self.doc = token, before, np.repeat(np.arange(n), self.sizes)
        self.part = np.frombuffer(row["parts"], np.uint8)[self.doc]
        self.pairs, self.pair = np.unique(bigrams(self.words[before], self.words[token]), return_inverse=True)

    def entries(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, sorted hashes, counts in part 1, counts in part 2) of the block's distinct unigrams and bigrams. An end
        counts as a word; so does a beginning, as a context only."""
        for kind, where, n in ((0, self.token, self.n_words + 2), (1, self.pair, len(self.pairs))):
            counts = [np.bincount(where[self.part == p], minlength=n) for p in (1, 2)]
            if kind:
                yield 1, self.pairs, *counts
            else:
                parts = self.part[np.cumsum(self.sizes) - 1]
                for p in (1, 2):
                    counts[p - 1][self.n_words + 1] = int((parts == p).sum())
                order = np.argsort(self.words, kind="stable")
                yield 0, self.words[order], counts[0][order], counts[1][order]


MESSAGE = "reducer int, group long, kind int, blocks array<long>, sizes array<int>"


def message_batch(rows: list[tuple], binaries: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * len(binaries)]
    names = ["reducer", "group", "kind", "blocks", "sizes", *binaries]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def send_entries(blocks: DataFrame, reducers: int) -> DataFrame:
    """(reducer, group, kind, blocks, sizes, hashes, held, counted): each group's entries by range of the hash, packed, its
    blocks' one after another, with the number of each block's."""
    step = (1 << 64) // reducers + 1
    limits = np.array([k * step for k in range(1, reducers)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names = None, []
        held_back: dict[int, list[tuple]] = {0: [], 1: []}

        def messages() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for kind, found in held_back.items():
                cuts = [[0, *np.searchsorted(x[0], limits), len(x[0])] for x in found]
                for r in range(reducers):
                    spans = [(i, slice(c[r], c[r + 1])) for i, c in enumerate(cuts) if c[r + 1] > c[r]]
                    if spans:
                        whole = [np.concatenate([found[i][c][own] for i, own in spans]) for c in range(3)]
                        sizes = [own.stop - own.start for _, own in spans]
                        out.append((r, group, kind, [names[i] for i, _ in spans], sizes, pack(whole[0], True), pack(narrow(whole[1])), pack(narrow(whole[2]))))
                        if len(out) == 64:
                            yield message_batch(out, ["hashes", "held", "counted"])
                            out = []
                found.clear()
            if out:
                yield message_batch(out, ["hashes", "held", "counted"])
            names.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if names and row["group"] != group:
                    yield from messages()
                group = row["group"]
                names.append(row["block"])
                for kind, hashes, held, counted in Block(row).entries():
                    held_back[kind].append((hashes, narrow(held), narrow(counted)))
        if names:
            yield from messages()

    return blocks.mapInArrow(lean(run), f"{MESSAGE}, hashes binary, held binary, counted binary")


def add_counts(sent: DataFrame, reducers: int) -> DataFrame:
    """(reducer, group, kind, blocks, sizes, held, counted): all documents' counts of each message's entries, in its order;
    and for group -1 one row a reducer and kind 0 with the number of distinct training words and of training tokens of its
    range."""

    def run(data: pa.Table) -> pa.Table:
        out: list[tuple] = []
        reducer = data.column("reducer")[0].as_py()
        for kind in (0, 1):
            rows = data.filter(pa.compute.equal(data.column("kind"), kind)).to_pylist()
            if not rows:
                continue
            hashes = [unpack(r.pop("hashes")) for r in rows]
            ends = np.cumsum([len(h) for h in hashes]).tolist()
            flat, where = np.unique(np.concatenate(hashes), return_inverse=True)
            del hashes
            sums = []
            for name in ("held", "counted"):
                x = np.concatenate([unpack(r.pop(name)).astype(np.int64) for r in rows])
                sums.append(np.bincount(where, x, minlength=len(flat)).astype(np.int64))
            for r, a, b in zip(rows, [0, *ends], ends, strict=False):
                own = where[a:b]
                out.append((reducer, r["group"], kind, r["blocks"], r["sizes"], pack(narrow(sums[0][own])), pack(narrow(sums[1][own]))))
            if not kind:
                real = flat != BEGIN
                known = int(((sums[0] + sums[1] > 0) & real).sum())
                counts = [np.array([known, int(s[real].sum())], dtype=np.uint64) for s in sums]
                out.append((reducer, -1, 0, [], [], pack(counts[0]), pack(counts[1])))
        return pa.Table.from_batches([message_batch(out, ["held", "counted"])])

    return sent.groupBy("reducer").applyInArrow(run, f"{MESSAGE}, held binary, counted binary")


def counts_of_blocks(answers: list[dict]) -> dict[int, list[list[np.ndarray]]]:
    """For each block the [held, counted] counts of its entries of kind 0 and of kind 1, in the order in which it sent them,
    as narrow integers."""
    found: dict[int, list] = {}
    for r in sorted(answers, key=lambda r: (r["reducer"], r["kind"])):
        cuts = np.cumsum(r["sizes"])[:-1]
        for block, held, counted in zip(r["blocks"], np.split(unpack(r["held"]), cuts), np.split(unpack(r["counted"]), cuts), strict=True):
            own = found.setdefault(block, [([], []), ([], [])])[r["kind"]]
            own[0].append(held)
            own[1].append(counted)
    return {b: [[np.concatenate(x) if x else np.zeros(0, np.uint8) for x in kind] for kind in kinds] for b, kinds in found.items()}


def with_counts(block: Block, counts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The block's [held, counted] counts of its words' places, and of its pairs."""
    word, pair = ([x.astype(np.int64) for x in kind] for kind in counts)
    order = np.argsort(block.words, kind="stable")
    for k in (0, 1):
        x = np.empty_like(word[k])
        x[order] = word[k]
        word[k] = x
    return word, pair


def frequency_bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c.astype(np.float64))[1], BUCKETS - 1)


class Model:
    """What all documents need: the totals, and a weight for each bucket."""

    def __init__(self, counted: int, held: int, known: int, weights: np.ndarray | None = None):
        self.counted, self.held, self.known, self.weights = counted, held, known, weights

    def base(self, c: np.ndarray, total: int) -> np.ndarray:
        return (c + 0.1) / (total + 0.1 * (self.known + 1))


def joined(blocks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """run(block, its counts) for each block, as tables of the schema; a group's blocks one after another."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        counts = counts_of_blocks(right.to_pylist())
        made = []
        for i in range(left.num_rows):
            row = left.slice(i, 1).to_pylist()[0]
            made.append(run(Block(row), counts.pop(row["block"])))
        return pa.concat_tables(made) if made else run(None, None)

    return blocks.groupBy("group").cogroup(answers.where("group >= 0").groupBy("group")).applyInArrow(both, schema)


def learn_weights(blocks: DataFrame, answers: DataFrame, model: Model) -> np.ndarray:
    """EM for the weights. An event of a held-out document matters only by its context's bucket and by the ratio of its
    two estimates, so events are counted by bucket and cell of that ratio, summed over all blocks, and EM runs on that
    table of a fixed size. Events whose context was not counted have no bigram estimate and no weight."""

    def run(b: Block | None, counts: list | None) -> pa.Table:
        cells = np.zeros(BUCKETS * CELLS, dtype=np.int64)
        if b is not None:
            (_, word), (_, pair) = with_counts(b, counts)
            event = np.flatnonzero(b.part == 1)
            context = word[b.before[event]]
            event, context = event[context > 0], context[context > 0]
            ratio = (pair[b.pair[event]] / context) / model.base(word[b.token[event]], model.counted)
            cell = np.clip(np.round(8 * np.log2(np.maximum(ratio, 1e-30))) + CELLS // 2, 0, CELLS - 1).astype(np.int64)
            cell[ratio == 0] = 0
            cells = np.bincount(frequency_bucket(context) * CELLS + cell, minlength=BUCKETS * CELLS)
        at = np.flatnonzero(cells)
        return pa.table({"cell": pa.array(at, pa.int64()), "n": pa.array(cells[at], pa.int64())})

    table_of = np.zeros((BUCKETS, CELLS))
    for r in joined(blocks, answers, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # BUCKETS * CELLS rows at most
        table_of[r["cell"] // CELLS, r["cell"] % CELLS] = r["n"]
    ratio = np.exp2((np.arange(CELLS) - CELLS // 2) / 8)
    ratio[0] = 0
    weights = np.full(BUCKETS, 0.5)
    for _ in range(STEPS):
        mass = weights[:, None] * ratio
        share = (table_of * mass / (mass + 1 - weights[:, None])).sum(axis=1)
        weights = np.clip((share + 0.5) / (table_of.sum(axis=1) + 1), 1e-4, 1 - 1e-4)
    return weights


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row of docs, which has a column `part`: 0 for
    documents that are only scored, 1 for training documents that are held out for the weights, 2 for the others.

    Whole texts; counts and statistics over all documents. Null and empty texts are one end token. Repeated rows are each
    scored (and counted), null keys too. Without training documents N is 0 and every score is the base. An empty table
    gives no rows. Texts of any length are read whole. Other columns are not read, whatever their names. The key must be an
    integer.
    """
    with scope():
        return written(_scored(docs, key, text), "lm-scores", keep=True)


def _scored(docs: DataFrame, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    blocks = written(make_blocks(docs, key, text), "lm-blocks")
    size = blocks.agg(F.sum(F.length("stream") + F.length("words"))).first()[0] or 0
    reducers = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, int(3 * size // REDUCER), 1)
    answers = written(add_counts(send_entries(blocks, reducers), reducers), "lm-counts")
    totals = np.zeros(3, dtype=np.int64)
    for r in answers.where("group < 0").select("held", "counted").toLocalIterator():  # one row a reducer
        held, counted = unpack(r["held"]), unpack(r["counted"])
        totals += np.array([counted[1], held[1], held[0]], dtype=np.int64)
    model = Model(*(int(x) for x in totals))
    model.weights = learn_weights(blocks, answers, model)
    train_tokens = model.counted + model.held

    def run(b: Block | None, counts: list | None) -> pa.Table:
        if b is None:
            columns = [[], np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0)]
        else:
            (w1, w2), (p1, p2) = with_counts(b, counts)
            word, pair = w1 + w2, p1 + p2
            base = model.base(word[b.token], train_tokens)
            context = word[b.before]
            weight = np.where(context > 0, model.weights[frequency_bucket(context)], 0.0)
            p = weight * pair[b.pair] / np.maximum(context, 1) + (1 - weight) * base
            sums = [np.bincount(b.doc, x, minlength=len(b.sizes)) for x in (word[b.token] > 0, np.log10(base), np.log10(p))]
            columns = [b.ids, b.sizes, *sums]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        cast = [c if isinstance(c, list) else c.astype(k.to_pandas_dtype()) for c, k in zip(columns, kinds, strict=True)]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("id", "n_tokens", "n_known", "base_score", "score"), cast, kinds, strict=True)})

    found = joined(blocks, answers, run, "id long, n_tokens long, n_known long, base_score double, score double")
    return found.select(
        F.col("id").cast(docs.schema[key].dataType).alias(key),
        "n_tokens",
        "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability; see score_documents for nulls, repeats and empty tables."""
    rest = crc_mod("doc_id", 10)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(rest == 0, 0).when(rest == 1, 1).otherwise(2).alias("part"))
    return score_documents(docs).select("doc_id", (rest == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
