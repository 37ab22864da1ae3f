"""The inverted index on disk: immutable segments of postings, and a manifest that says which are live.

A segment is a Parquet folder of (term, doc_id), sorted by term so that row groups can be skipped, and one of its terms
with their document frequency, so that expansion never reads postings. The manifest is a
numbered JSON file, written aside and renamed; a reader pins the version it opened and is never blocked, a writer that
lost a race fails. Deletions are a small Parquet folder for each segment, applied as an anti-join until a purge or merge.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import distinct_terms

FAN_OUT = 4
#: Postings of a segment's file at most.
FILE_ROWS = 20_000_000
#: Postings that one task sorts, some 90 bytes of memory each; beyond it there are more tasks, whatever the session's settings.
SORT_ROWS = 3_000_000
#: Postings for which a task of their own is worth while.
LEAST_ROWS = 50_000
#: Deletions of a segment up to which they are broadcast: some tens of MB.
BROADCAST_IDS = 1_000_000


class CorruptIndex(RuntimeError):
    """The manifest names what is not there."""


class IndexBusy(RuntimeError):
    """Another writer published first, or holds the lock."""


@dataclass(frozen=True)
class Segment:
    name: str
    level: int
    min_doc: int
    max_doc: int
    deletes: tuple[str, ...] = ()
    batch: int = -1


def with_batch(batches: tuple[tuple[int, int], ...], n: int) -> tuple[tuple[int, int], ...]:
    """Ranges (first, last) of batch numbers with one more."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((*batches, (n, n))):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return tuple(out)


def postings_of(lines: DataFrame) -> DataFrame:
    """(term, doc_id) of lines (id, content): each distinct term once for each line."""
    return lines.select(F.explode(distinct_terms(F.col("content"))).alias("term"), F.col("id").alias("doc_id"))


class MemoryIndex:
    """An index of lines (id, content) without files: postings in executors' memory, what does not fit on their disks.
    What a lost executor held is computed again. Searched like an Index; close() frees it."""

    def __init__(self, lines: DataFrame):
        self._postings = postings_of(lines).persist(StorageLevel.MEMORY_AND_DISK)

    def postings(self) -> DataFrame:
        return self._postings

    def vocabulary(self) -> DataFrame:
        return self._postings.groupBy("term").agg(F.count("*").alias("df"))

    def close(self) -> None:
        self._postings.unpersist()


class Store:
    """Files of an index through Hadoop's file system, so that any path Spark writes will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(""))] if self.fs.exists(self.path("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that does not exist yet; False if it does."""
        aside = self.path(f"_{uuid.uuid4().hex}")
        stream = self.fs.create(aside)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.exists(self.path(name)) and self.fs.rename(aside, self.path(name)):
            return True
        self.fs.delete(aside, False)
        return False

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Index:
    """A version of an index: readers keep theirs, writers return the next. batches: the ranges of batch numbers that were
    ever added, whatever became of their segments."""

    def __init__(self, spark: SparkSession, root: str, version: int = 0, segments: tuple[Segment, ...] = (), batches: tuple[tuple[int, int], ...] = ()):
        self.spark, self.store, self.version, self.segments, self.batches = spark, Store(spark, root), version, segments, batches

    @staticmethod
    def open(spark: SparkSession, root: str) -> Index:
        """The newest version; CorruptIndex if files that it names are missing."""
        if not root:
            raise ValueError("an index needs a path")
        store = Store(spark, root)
        versions = sorted(int(n[9:-5]) for n in store.names() if n.startswith("manifest-") and n.endswith(".json"))
        if not versions:
            return Index(spark, root)
        kept = json.loads(store.read(f"manifest-{versions[-1]:08d}.json"))
        segments = tuple(Segment(**{**r, "deletes": tuple(r["deletes"])}) for r in kept["segments"])
        found = Index(spark, root, versions[-1], segments, tuple((a, b) for a, b in kept["batches"]))
        for s in found.segments:
            for name in (s.name, f"{s.name}-terms", *s.deletes):
                if not store.exists(name):
                    raise CorruptIndex(f"{root}: {name} is missing")
        return found

    @staticmethod
    def open_or_restart(spark: SparkSession, root: str) -> Index:
        """The newest version, or, if it is corrupt, an empty index after all of its files are removed: it is built anew."""
        try:
            return Index.open(spark, root)
        except CorruptIndex:
            store = Store(spark, root)
            for name in store.names():
                store.delete(name)
            return Index(spark, root)

    def _publish(self, segments: tuple[Segment, ...], batches: tuple[tuple[int, int], ...] | None = None) -> Index:
        version = self.version + 1
        segments = sorted(segments, key=lambda s: (s.min_doc, s.name))
        text = json.dumps({"segments": [asdict(s) for s in segments], "batches": self.batches if batches is None else batches})
        if not self.store.create(f"manifest-{version:08d}.json", text):
            raise IndexBusy(f"{self.store.root}: version {version} exists")
        return Index.open(self.spark, self.store.root)

    def _write(self, postings: DataFrame, most: int, level: int, batch: int = -1) -> tuple[Segment, ...]:
        """A new segment of postings that come from files, none if there are no rows. most: how many rows they have at most."""
        name = f"segment-{uuid.uuid4().hex}"
        out = f"{self.store.root}/{name}"
        # ranges of terms with rows in proportion: a term of a third of all rows is dealt over several files
        tasks = max(1, min(self.spark.sparkContext.defaultParallelism, most // LEAST_ROWS), -(-most // SORT_ROWS))
        rows = postings.repartitionByRange(tasks, "term", "doc_id").sortWithinPartitions("term", "doc_id")
        rows.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(out)
        rows = self.spark.read.parquet(out)
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is None:
            self.store.delete(name)
            return ()
        rows.groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.parquet(f"{out}-terms")
        return (Segment(name, level, low, high, (), batch),)

    def _rewrite(self, old: tuple[Segment, ...], level: int, batch: int = -1) -> tuple[Segment, ...]:
        """A new segment of what is live in some segments."""
        part = Index(self.spark, self.store.root, self.version, old, self.batches)
        return self._write(part.postings(), part.postings(live=False).count(), level, batch)

    def _index(self, lines: DataFrame, batch: int) -> tuple[Segment, ...]:
        """A new segment of lines. Their terms are written first, a text for each line: finding the ranges would otherwise
        tokenise everything once more."""
        stage = f"_{uuid.uuid4().hex}"
        found = lines.select(F.col("id").alias("doc_id"), distinct_terms(F.col("content")).alias("terms"))
        kept = found.select("doc_id", F.array_join("terms", " ").alias("terms"), F.size("terms").alias("n"))
        kept.write.option("compression", "zstd").parquet(f"{self.store.root}/{stage}")
        kept = self.spark.read.parquet(f"{self.store.root}/{stage}")
        postings = kept.where("n > 0").select(F.explode(F.split("terms", " ")).alias("term"), "doc_id")
        out = self._write(postings, kept.agg(F.sum("n")).first()[0] or 0, 0, batch)
        self.store.delete(stage)
        return out

    def add(self, lines: DataFrame, batch: int = -1) -> Index:
        """Indexes lines (id, content) as a new segment. A batch number that was added before is not added again, also when
        its segment was merged or purged since, or when it had no terms."""
        if batch >= 0 and any(a <= batch <= b for a, b in self.batches):
            return self
        return self._publish(self.segments + self._index(lines, batch), with_batch(self.batches, batch) if batch >= 0 else None)

    def progress(self) -> dict:
        """What a build needs to go on: the last id, the batches that are in, the version, segments and documents' range."""
        low = min((s.min_doc for s in self.segments), default=None)
        return {"resume_id": self.resume_id(), "batches": list(self.batches), "version": self.version, "segments": len(self.segments), "min_doc": low}

    def files(self) -> DataFrame:
        """(name, live) of everything in the index's folder; live: this version names it."""
        named = {n for s in self.segments for n in (s.name, f"{s.name}-terms", *s.deletes)} | {f"manifest-{self.version:08d}.json"}
        return self.spark.createDataFrame([(n, n in named) for n in sorted(self.store.names())], "name string, live boolean")

    def resume_id(self) -> int:
        """The last id that is indexed, -1 for none."""
        return max((s.max_doc for s in self.segments), default=-1)

    def _live(self, s: Segment) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.store.root}/{s.name}")
        if not s.deletes:
            return rows
        listed = self.spark.read.parquet(*[f"{self.store.root}/{d}" for d in s.deletes]).select("doc_id")
        gone = listed.distinct()
        if listed.count() <= BROADCAST_IDS:  # what a session broadcasts by itself may be less
            gone = F.broadcast(gone)
        else:  # a join sorts both sides: what a task sorts is bounded here too
            tasks = max(1, -(-rows.count() // SORT_ROWS))
            rows, gone = rows.repartition(tasks, "doc_id"), gone.repartition(tasks, "doc_id")
        return rows.join(gone, "doc_id", "left_anti").select("term", "doc_id")

    def postings(self, live: bool = True) -> DataFrame:
        """(term, doc_id) of all segments, without deleted documents unless asked otherwise."""
        if not self.segments:
            return self.spark.createDataFrame([], "term string, doc_id long")
        clean = [s for s in self.segments if not live or not s.deletes]
        out = self.spark.read.parquet(*[f"{self.store.root}/{s.name}" for s in clean]).select("term", "doc_id") if clean else None
        for s in self.segments:
            if s not in clean:
                out = self._live(s) if out is None else out.unionByName(self._live(s))
        return out

    def vocabulary(self) -> DataFrame:
        """(term, df) with deleted documents still counted, as the term table has it."""
        if not self.segments:
            return self.spark.createDataFrame([], "term string, df long")
        rows = self.spark.read.parquet(*[f"{self.store.root}/{s.name}-terms" for s in self.segments])
        return rows if len(self.segments) == 1 else rows.groupBy("term").agg(F.sum("df").alias("df"))

    def delete(self, ids: DataFrame) -> tuple[Index, DataFrame]:
        """Marks ids (id) as deleted in the segments whose range holds them; the next version, and (id, deleted): whether
        some range does, even if the id itself is absent."""
        if not self.segments:
            return self, ids.select("id", F.lit(False).alias("deleted"))
        changed = []
        ids = ids.select(F.col("id").cast("long").alias("id"))
        for s in self.segments:
            own = ids.where(F.col("id").between(s.min_doc, s.max_doc)).select(F.col("id").alias("doc_id")).distinct()
            if own.isEmpty():
                changed.append(s)
                continue
            name = f"deletes-{uuid.uuid4().hex}"
            own.write.parquet(f"{self.store.root}/{name}")
            changed.append(replace(s, deletes=(*s.deletes, name)))
        hit = F.lit(False)
        for s in self.segments:
            hit = hit | F.col("id").between(s.min_doc, s.max_doc)
        return self._publish(tuple(changed)), ids.withColumn("deleted", hit)

    def purge(self) -> Index:
        """Rewrites the segments that have deletions, and only those."""
        dirty = [s for s in self.segments if s.deletes]
        if not dirty:
            return self
        kept = tuple(s for s in self.segments if not s.deletes)
        return self._publish(kept + tuple(x for s in dirty for x in self._rewrite((s,), s.level, s.batch)))

    def merge(self, fan_out: int = FAN_OUT) -> Index:
        """Merges the segments of a level that has fan_out of them into one of the next level, deletions applied, and so on
        upwards."""
        now = self
        while levels := [n for n in sorted({s.level for s in now.segments}) if sum(s.level == n for s in now.segments) >= fan_out]:
            old = tuple(s for s in now.segments if s.level == levels[0])
            kept = tuple(s for s in now.segments if s.level != levels[0])
            now = now._publish(kept + now._rewrite(old, levels[0] + 1))
        return now

    def ranges(self) -> DataFrame:
        """(segment, level, min_doc, max_doc) of the live segments."""
        rows = [(i, s.level, s.min_doc, s.max_doc) for i, s in enumerate(self.segments)]
        return self.spark.createDataFrame(rows, "segment int, level int, min_doc long, max_doc long")

    def vacuum(self) -> list[str]:
        """Removes files that this version does not name (readers of older versions must be gone)."""
        named = {n for s in self.segments for n in (s.name, f"{s.name}-terms", *s.deletes)} | {f"manifest-{self.version:08d}.json"}
        gone = [n for n in self.store.names() if n not in named and n.startswith(("segment-", "deletes-", "manifest-", "_"))]
        for n in gone:
            self.store.delete(n)
        return gone

    def locked(self) -> Lock:
        return Lock(self.store)


class Lock:
    """One writer at a time: a file that only one can create, where renaming a file fails if the name is taken (as on HDFS;
    an object store needs a lock of its own)."""

    def __init__(self, store: Store):
        self.store = store

    def __enter__(self) -> Lock:
        if not self.store.create("write.lock", "held"):
            raise IndexBusy(f"{self.store.root} is locked")
        return self

    def __exit__(self, *_) -> None:
        self.store.delete("write.lock")
