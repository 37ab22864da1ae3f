"""Token-id files: one independent zstandard frame for each document, a trailing seek table, a checksum for each frame.

Layout of a file (integers little-endian): the frames one after another, each the document's ids as unsigned integers of
`width` bytes; then a zstandard skippable frame whose content is the seek table, an ENTRY for each frame in order, and the
FOOTER. A plain zstandard reader sees the ids alone; ours reads the footer, the table, and the asked documents' frames.
(Zstandard's own seekable layout has no place for document ids, and 32 bits for sizes.)
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.bpe import parts
from loam.llm.common import bound_batches, fresh_path, lean, restored, table, written

SKIPPABLE = 0x184D2A5E  # zstandard's first magic number for skippable frames (fixed value)
ENTRY = np.dtype(
    [("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("size", "<u8"), ("n_tokens", "<u8"), ("crc32", "<u4")]
)
FOOTER = struct.Struct("<QB4s")  # number of frames, width, magic
MAGIC = b"LTF1"
#: Files at most (more documents then go in each), whose bounds every task holds.
MOST_FILES = 10_000
#: Documents a file, text handled at once in a worker (characters), pieces and runs of them that a worker keeps encoded.
DOCS_A_FILE, TOGETHER, KEPT = 20_000, 8_000_000, 900_000


class TokenFileError(ValueError):
    """A token file that is cut short, is no token file, or has a frame that fails its checksum."""


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub("^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_file(uri: str, docs: Iterable[tuple[int | None, bytes]], width: int = 4, level: int = 1) -> tuple[int, int]:
    """Writes (doc_id or None, ids of `width` bytes each); gives the numbers of documents and of ids. The file appears
    under its name only when complete, so a task that is lost or runs twice does no harm."""
    store, path = opened(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    entries: list[tuple] = []
    at = total = 0
    press = zstandard.ZstdCompressor(level=level)
    with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as out:
        for doc_id, ids in docs:
            frame = press.compress(ids)
            entries.append((doc_id or 0, doc_id is not None, at, len(frame), len(ids) // width, zlib.crc32(ids)))
            out.write(frame)
            at += len(frame)
            total += len(ids) // width
        seek = np.array(entries, dtype=ENTRY).tobytes() + FOOTER.pack(len(entries), width, MAGIC)
        out.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)
    store.move(part, path)
    return len(entries), total


class TokenFile:
    """A token file opened for reading; only asked frames are read and decompressed."""

    def __init__(self, uri: str):
        store, path = opened(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        if end < FOOTER.size + 8:
            raise TokenFileError(f"{uri}: too short")
        self.file.seek(end - FOOTER.size)
        count, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        start = end - FOOTER.size - count * ENTRY.itemsize
        if magic != MAGIC or start < 8:
            raise TokenFileError(f"{uri}: no seek table")
        self.file.seek(start - 8)
        kind, size = struct.unpack("<II", self.file.read(8))
        if kind != SKIPPABLE or size != end - start:
            raise TokenFileError(f"{uri}: damaged seek table")
        self.entries = np.frombuffer(self.file.read(count * ENTRY.itemsize), ENTRY)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, its checksum verified."""
        e = self.entries[k]
        self.file.seek(int(e["offset"]))
        size = int(e["n_tokens"]) * self.width
        try:
            raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(e["size"])), max_output_size=size) if size else b""
        except zstandard.ZstdError as error:
            raise TokenFileError(f"frame {k} is damaged") from error
        if len(raw) != size or zlib.crc32(raw) != e["crc32"]:
            raise TokenFileError(f"frame {k} fails its checksum")
        return np.frombuffer(raw, f"<u{self.width}")

    def find(self, doc_id: int) -> list[int]:
        """Places of the frames of a document id."""
        return np.flatnonzero((self.entries["doc_id"] == doc_id) & (self.entries["has_id"] == 1)).tolist()

    def close(self) -> None:
        self.file.close()


#: A run of letters, a run of marks, or the one before the other: each run is one pre-token, whose letters only need lower
#: case. Letters are those below U+0180, where case and composition are the same in every version of Unicode.
SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017f]*)([!-&(-/:-@\[-`{-~]*)", re.DOTALL)


class Words:
    """Whole texts encoded by a tokenizers file whose white space separates; pieces that come again are kept encoded.

    A text is cut at spaces and newlines, and a piece that is letters and then marks once more between them. New runs are
    encoded many at a time, as one text, which the ids that end a word cut again. A run by itself is a piece, too, so one
    store keeps both."""

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()
        vocab = self.model.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.model.get_vocab_size() + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.kind, self.width = f"<u{width}", width
        self.kept: dict[str, bytes] = {"": b""}

    def encode_runs(self, runs: list[str]) -> None:
        ids = np.array(self.model.encode(" ".join(runs), add_special_tokens=False).ids, dtype=np.int64)
        cuts = (self.width * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) == len(runs):
            raw = ids.astype(self.kind).tobytes()
            self.kept.update(zip(runs, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        else:
            self.kept.update(zip(runs, self.whole(runs), strict=True))

    def whole(self, pieces: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in found]

    def prepare(self, pieces: list[str]) -> None:
        simple = [m.groups() if (m := SIMPLE.fullmatch(p)) and "<|" not in p else None for p in pieces]
        simple = [s and (s[0].lower(), s[1]) for s in simple]
        new = list({r for s in simple if s for r in s}.difference(self.kept))
        for k in range(0, len(new), 20_000):
            self.encode_runs(new[k : k + 20_000])
        odd = [p for p, s in zip(pieces, simple, strict=True) if not s]
        self.kept.update((p, self.kept[s[0]] + self.kept[s[1]]) for p, s in zip(pieces, simple, strict=True) if s)
        self.kept.update(zip(odd, self.whole(odd), strict=True))

    def trim(self) -> None:
        """Forgets encoded pieces and runs but for short ones, which are likely to come again."""
        if len(self.kept) > KEPT:
            short = {k: v for k, v in self.kept.items() if len(k) < 9}
            self.kept = short if len(short) < KEPT // 2 else {"": b""}

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string array (null: none). Pieces are numbered in Arrow; Python sees distinct ones."""
        lines = pa.compute.replace_substring(pa.compute.fill_null(texts, "").cast(pa.large_string()), "\n", " ")
        cut = pa.compute.split_pattern(lines, " ")
        coded = cut.flatten().dictionary_encode()
        pieces, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = [p for p in pieces if p not in self.kept]
        for k in range(0, len(new), 50_000):
            self.prepare(new[k : k + 50_000])
        own = list(map(self.kept.__getitem__, pieces))
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // self.width
        ids = np.frombuffer(b"".join(own), self.kind)
        n = sizes[codes]
        ends = np.cumsum(n)
        first = (np.cumsum(sizes) - sizes)[codes]
        raw = ids[np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        at = np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()] * self.width
        self.trim()
        return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@cache
def words(path: str, width: int) -> Words:
    return Words(path, width)


def write_token_files(
    df: DataFrame, vocabulary: str, folder: str, end_id: int = 1, width: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encodes whole texts, appends end_id, and writes token files in ascending key order; gives one row for each file:
    (file, path, n_docs, n_tokens, ids_before), ids_before being the ids in all files before it.

    Files hold ranges of keys, cut at quantiles; null keys come first. A key of very many rows is dealt over several files
    by a hash of text and input partition; in a file rows of equal keys are ordered by their ids. A null text counts as
    empty, and so has the end id alone. Repeated rows each have their frame. Texts of any length are one frame. An empty
    table gives no file. Ids must fit `width` bytes. folder is a URI that every executor reaches. Other columns are not
    read, whatever their names.
    """
    rows = df.count()
    files = max(1, min(MOST_FILES, -(-rows // DOCS_A_FILE)))
    shares = [k / files for k in range(1, files)]
    bounds = (df.select(F.percentile_approx(key, shares, 20 * files)).first()[0] or []) if shares else []
    many = max(2 * DOCS_A_FILE, rows // MOST_FILES)
    hot = df.groupBy(F.col(key).alias("key")).count().where(F.col("count") > many).collect()  # MOST_FILES at most
    # Cuts before a bound, and before and behind a hot key: between two of them lie the files of one range of keys.
    cuts = sorted({*((b, 0) for b in bounds), *((r["key"], side) for r in hot if r["key"] is not None for side in (0, 1))})
    range_of = lambda k: 0 if k is None else 1 + bisect_right(cuts, (k, 0.5))
    sizes = [1] * (len(cuts) + 2)
    for r in hot:
        sizes[range_of(r["key"])] = -(-r["count"] // DOCS_A_FILE)
    first = [0]
    for n in sizes:
        first.append(first[-1] + n)
    kind = df.schema[key].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = words(vocabulary, width), end_id.to_bytes(width, "little")
        for batch in batches:
            for part in parts(batch, 1, TOGETHER):
                ids = [x + end for x in model.encode(part.column(1))]
                ranges = [range_of(k) for k in part.column(0).to_pylist()]
                file = [first[r] + tie % sizes[r] for r, tie in zip(ranges, part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(file, pa.int32()), pa.array(ids, pa.binary())], ["key", "file", "ids"]
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple[int, int | None, bytes]]:
            for b in batches:
                yield from zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)

        rows_left = stream()
        ahead = next(rows_left, None)
        while ahead is not None:
            now = ahead[0]

            def docs() -> Iterator[tuple[int | None, bytes]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == now:
                    yield ahead[1], ahead[2]
                    ahead = next(rows_left, None)

            uri = f"{folder}/part-{now:07d}.ltf"
            n_docs, n_tokens = write_file(uri, docs(), width)
            yield pa.RecordBatch.from_pydict({"file": pa.array([now], pa.int32()), "path": [uri], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    encoded = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text, F.spark_partition_id())).mapInArrow(
        lean(encode), T.StructType([T.StructField("key", kind), T.StructField("file", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    )
    placed = encoded.repartitionById(first[-1], F.col("file")).sortWithinPartitions(
        "file", F.col("key").asc_nulls_first(), "ids"
    )
    before = bound_batches(df.sparkSession, 10_000, TOGETHER)
    try:
        made = written(placed.mapInArrow(lean(write), "file int, path string, n_docs long, n_tokens long"), "token-files")
    finally:
        restored(df.sparkSession, before)
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return made.withColumn("ids_before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of write_token_files's files, in parallel by file;
    every frame is verified. start: ids of all documents before; ids_crc32: of the ids as unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(row["path"])
                starts = row["ids_before"] + np.cumsum(f.entries["n_tokens"]) - f.entries["n_tokens"]
                for a in range(0, len(f.entries), 500):
                    e = f.entries[a : a + 500]
                    ids = [f.ids(a + k).astype("<u4").tobytes() for k in range(len(e))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(e["doc_id"].astype(np.int64), mask=e["has_id"] == 0),
                            pa.array(starts[a : a + 500].astype(np.int64)),
                            pa.array(e["n_tokens"].astype(np.int64)),
                            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )
                f.close()

    spread = files.select("file", "path", "ids_before").repartition(max(1, files.count()))
    return spread.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids as read back from files; see write_token_files for nulls, ties and empty tables."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), fresh_path(spark, "tokens"))
    return read_token_files(files).select("doc_id", "start", "n_tokens", "ids_crc32")
