"""Jaccard self-join of documents' word n-gram sets, by vertical partitioning, and its connected components.

N-grams have one global order: those that are common come last, by their frequency, all others by their hash. The order
is cut into fragments. Candidate pairs come from the first fragments: sets that reach the similarity share an n-gram
among their first n - ceil(t n) + 1 (the prefix), have similar sizes, and differ little up to their last common prefix
n-gram. For each candidate pair every fragment counts its partial overlap by itself; the counts are summed per pair.

Sets are classes: documents of equal sets are one. A very common prefix n-gram does not make all pairs of its sets:
first each set is compared with the n-gram's least set, a star; then only pairs whose sets are still in different
components are made. So a group of near copies costs its size, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import lean, scope, small, table, written
from loam.llm.ngrams import mix, pieces, shingles, text_bytes, word_hashes

#: Word n-gram length and similarity in per cent.
SHINGLE, PERCENT = 5, 80
#: Common n-grams that come last in the order: at most so many, each with so many occurrences in some COMMON_CHUNK of them.
#: They decide the order only, never the result.
COMMON, COMMON_LEAST, COMMON_CHUNK = 200_000, 3, 3_000_000
#: Sets that share a prefix n-gram, beyond which the star comes first.
STAR = 16
#: Fragments of the order: FRAGMENTS - 1 equal ranges of hashes, and the common n-grams.
FRAGMENTS = 8
#: Bits of the map that drops n-grams of one set only (8 MB); with more than some ten million others it drops fewer.
MAP_BITS = 1 << 26
#: Entries of an n-gram beyond which its sets are first sifted by what their sizes allow, and dealt over cells of so many.
HOT = 2_000
#: Bits of a set's first hash (sets that share it are told apart by a second), and sets that a task knows to be given.
SET_BITS, KNOWN_SETS = 64, 250_000
#: What half hashes may count too much, but for a negligible chance: a constant and the expected number times eight.
MARGIN = "(3 + na * nb div 1000000000)"


def sets(batch: pa.RecordBatch, column: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams (not distinct) of a batch's texts and their rows."""
    raw, ends = text_bytes(batch.column(column))
    h, bounds = shingles(*word_hashes(raw, ends), size)
    return h, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def common_ngrams(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Hashes of the most common n-grams, the rarer first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty(COMMON_CHUNK, dtype=np.uint64), 0

        def counted() -> pa.RecordBatch:
            own = held[:n]
            own.sort()  # in place
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            counts = np.diff(first, append=n)
            keep = counts >= COMMON_LEAST
            return pa.RecordBatch.from_arrays([pa.array(own[first[keep]].view(np.int64)), pa.array(counts[keep])], ["h", "n"])

        for batch in batches:
            for part in pieces(batch, 0):
                h, rows = sets(part, 0, size)
                order = np.lexsort((h, rows))
                h, rows = h[order], rows[order]
                h = h[np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])])] if len(h) else h
                while len(h):
                    some, h = h[: COMMON_CHUNK - n], h[COMMON_CHUNK - n :]
                    held[n : n + len(some)] = some
                    n += len(some)
                    if n == COMMON_CHUNK:
                        yield counted()
                        n = 0
        if n:
            yield counted()

    found = docs.select(text).mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()
    return rows.column(0).to_numpy()[::-1].astype(np.int64).view(np.uint64)


class Order:
    """The global order: the rank of common n-grams is 1 and more, of others 0."""

    def __init__(self, common: np.ndarray):
        by_hash = np.argsort(common, kind="stable")
        self.hashes, self.ranks = common[by_hash], by_hash.astype(np.int64) + 1

    def rank(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ranks[at], 0)

    def ordered_sets(self, h: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams row by row in the order, their ranks, and each row's end and size."""
        rank = self.rank(h)
        order = np.lexsort((h, rank, rows))
        h, rank, rows = h[order], rank[order], rows[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        h, rank, rows = h[new], rank[new], rows[new]
        size = np.bincount(rows, minlength=n_rows)
        return h, rank, np.cumsum(size), size


def list_array(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64()), pa.array(values))
    return lists.cast(pa.list_(lists.type.value_type))


def set_hashes(h: np.ndarray, ends: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each row's set, the first of so many bits."""
    out = []
    for salt in (np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x3C6EF372FE94F82B)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ salt))])
        out.append(mix(sums[ends] - sums[ends - n] + n.astype(np.uint64)).view(np.int64))
    return out[0] >> (64 - bits), out[1]


def prefixes(docs: DataFrame, key: str, text: str, size: int, percent: int, order) -> DataFrame:
    """(key, t, n, rare, s, s2, prefix): a hash of the text, set size, how many of the set are not common n-grams, two
    hashes of the set, and its first n-grams; a task gives the prefix of a set only once, null otherwise. Empty sets have
    n = 0 and a null s."""
    schema = docs.select(key).schema.add("t", "long").add("n", "long").add("rare", "long").add("s", "long").add("s2", "long")
    schema = schema.add("prefix", T.ArrayType(T.LongType()))
    names, bits = schema.names, SET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Order(order.value), set()
        for batch in batches:
            for part in pieces(batch, 1):
                h, rows = sets(part, 1, size)
                h, rank, ends, n = own.ordered_sets(h, rows, part.num_rows)
                counted = np.concatenate([[0], np.cumsum(rank == 0)])
                rare = counted[ends] - counted[ends - n]
                s, s2 = set_hashes(h, ends, n, bits)
                first = np.zeros(len(n), dtype=bool)
                for i, x in enumerate(zip(s.tolist(), s2.tolist(), strict=True)):
                    if n[i] and x not in seen:
                        seen.add(x)
                        first[i] = True
                if len(seen) > KNOWN_SETS:
                    seen.clear()
                p = np.where(first, n - (percent * n + 99) // 100 + 1, 0)
                at = np.arange(int(p.sum())) + np.repeat(ends - n - (np.cumsum(p) - p), p)
                lists = list_array(h[at].view(np.int64), p)
                lists = pa.compute.if_else(pa.array(first), lists, pa.scalar(None, lists.type))
                columns = [part.column(0), part.column(2), pa.array(n), pa.array(rare), pa.array(s, mask=n == 0), pa.array(s2), lists]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(key, text, F.xxhash64(text)).mapInArrow(lean(run), schema)


def classes_of(rows: DataFrame, key: str) -> DataFrame:
    """(s, own, first, times, low, high) of each set: the row that holds it of least key (null last) and text's hash, of the
    rows that give its prefix the first and their number, and the range of its second hash. A set of a third of all rows is
    aggregated where its rows lie, before they meet."""
    given = F.when(F.col("prefix").isNotNull(), F.col("uid"))
    return (
        rows.where("s IS NOT NULL")
        .groupBy("s")
        .agg(
            F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), "t")).alias("own"),
            F.min(given).alias("first"),
            F.count(given).alias("times"),
            F.min("s2").alias("low"),
            F.max("s2").alias("high"),
        )
    )


def told_apart(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows and their classes, different sets with one first hash told apart by the second."""
    classes = written(classes_of(rows, key), "classes")
    double = classes.where("low != high").select("s", F.lit(True).alias("_double"))
    if double.isEmpty():
        return rows, classes
    both = F.when(F.col("_double"), F.xxhash64("s", "s2")).otherwise(F.col("s"))
    rows = written(rows.join(small(double), "s", "left").withColumn("s", both).drop("_double"), "prefixes")
    return rows, written(classes_of(rows, key), "classes")


def segments(bodies: DataFrame, size: int, order, whole: bool) -> DataFrame:
    """(s, fragment, grams, lost): the sets of bodies (s, text) cut at the fragments of the order; n-grams as whole hashes,
    or as 32 bits of what tells them apart inside their fragment, some of which may fall together: lost is how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Order(order.value), set()
        width = np.uint64((1 << 64) // (FRAGMENTS - 1) + 1)
        for batch in batches:
            fresh = []  # repeated rows of one set are cut once a task
            for i, s in enumerate(batch.column(0).to_pylist()):
                if s not in seen:
                    seen.add(s)
                    fresh.append(i)
            if len(seen) > KNOWN_SETS:
                seen.clear()
            for part in pieces(batch.take(pa.array(fresh, pa.int64())), 1):
                h, rows = sets(part, 1, size)
                h, rank, ends, n = own.ordered_sets(h, rows, part.num_rows)
                rows = np.repeat(np.arange(len(n)), n)
                range_of = h // width
                cell = rows * FRAGMENTS + np.where(rank > 0, FRAGMENTS - 1, range_of.astype(np.int64))  # ascending
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
                cells, counts = cell[first], np.diff(first, append=len(cell))
                half = np.where(rank > 0, rank.astype(np.uint64), (h - range_of * width) >> np.uint64(30))  # ascending in a cell
                again = np.zeros(len(h), dtype=np.int64)
                again[1:] = half[1:] == half[:-1]
                again[first] = 0
                lost = np.add.reduceat(again, first) if len(first) else again
                s = part.column(0).to_numpy(zero_copy_only=False)[cells // FRAGMENTS]
                grams = list_array(h.view(np.int64) if whole else half.astype(np.uint32).view(np.int32), counts)
                columns = [pa.array(s), pa.array((cells % FRAGMENTS).astype(np.int32)), grams, pa.array(lost.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["s", "fragment", "grams", "lost"])

    return bodies.select("s", "text").mapInArrow(lean(run), f"s long, fragment int, grams array<{'long' if whole else 'int'}>, lost int")


def overlaps(pairs: DataFrame, bodies: DataFrame, order, size: int, whole: bool) -> DataFrame:
    """The pairs (a, na, b, nb) with the overlap of their sets as counted, and what half hashes may have counted too
    little (lost). bodies: (s, text), a text for each set.

    Each side's segments meet pair by pair and fragment by fragment; a fragment's partial overlap is counted there, and
    only counts are summed per pair."""
    cut = written(segments(bodies, size, order, whole), "segments")
    if cut.count() > cut.select("s", "fragment").distinct().count():  # repeated rows, of several tasks
        cut = written(cut.dropDuplicates(["s", "fragment"]), "segments-once")
    right = cut.select(F.col("s").alias("b"), "fragment", F.col("grams").alias("gb"), F.col("lost").alias("lb"))
    left = cut.select(F.col("s").alias("a"), "fragment", F.col("grams").alias("ga"), F.col("lost").alias("la")).join(
        small(written(pairs.select("a").distinct(), "left-sets")), "a", "left_semi"
    )
    met = right.join(small(pairs), "b").join(left, ["a", "fragment"])
    partial = met.select("a", "na", "b", "nb", F.size(F.array_intersect("ga", "gb")).alias("overlap"), F.least("la", "lb").alias("lost"))
    sums = [F.sum(c).alias(c) for c in ("overlap", "lost")]
    return written(partial.groupBy("a", "na", "b", "nb").agg(*sums), "overlaps")


def verified(pairs: DataFrame, fetch, order, size: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose sets reach the similarity; fetch gives the texts of pairs' sets.

    Segments first travel as half hashes. Their overlaps are too small by `lost` at most, and too large by MARGIN at most
    (33 bits with the fragment tell n-grams of two sets apart). Pairs that these bounds do not decide are counted again
    with whole hashes."""
    reach = lambda o: F.expr(f"100 * ({o}) >= {percent} * (na + nb - ({o}))")
    rough = overlaps(pairs, fetch(pairs), order, size, whole=False).where(reach("overlap + lost"))
    decided = reach(f"overlap - {MARGIN}")
    sure = rough.where(decided).select("a", "b")
    doubtful = written(rough.where(~decided).select("a", "na", "b", "nb"), "doubtful-pairs")
    exact = overlaps(doubtful, fetch(doubtful), order, size, whole=True).where(reach("overlap")).select("a", "b")
    return sure.unionByName(exact)


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of links (a, b): the least vertex of its component. Alternates large-star and small-star
    steps, each a written table, until nothing changes."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        some = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(some.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    rooted = edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return rooted.unionByName(edges.select("v", F.col("v").alias("root")).distinct())


def shared_entries(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, s, n, rare, pos) of the prefixes' n-grams that more than one of the given prefixes has.

    Most n-grams are of one set only. Those of several are counted first, and their bits in a map of a fixed size drop
    nearly all others where they lie; an exact join drops the rest."""
    given = rows.where("prefix IS NOT NULL").select("s", "n", "rare", "prefix", "uid")
    again = given.select("s", "uid").join(small(classes.where("times > 1").select("s", "first")), "s").where("uid != first")
    again = written(again.select("uid"), "given-again")
    given = given.join(small(again), "uid", "left_anti").select("s", "n", "rare", "prefix")
    shared = written(given.select(F.explode("prefix").alias("token")).groupBy("token").count().where("count > 1").select("token"), "shared")
    place = F.expr(f"token & {MAP_BITS - 1}")
    words = shared.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(token & 63 as int))")).alias("bits"))
    held = words.select(F.col("word").cast("long"), "bits").toArrow()  # MAP_BITS / 64 rows at most
    bits = np.zeros(MAP_BITS // 64, dtype=np.uint64)
    bits[held["word"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    known = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            at = tokens.view(np.uint64) & np.uint64(MAP_BITS - 1)
            keep = np.flatnonzero(known.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
            ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            row = np.searchsorted(ends, keep, side="right")
            first = np.concatenate([[0], ends])[row]
            columns = [tokens[keep], *(batch.column(c).to_numpy(zero_copy_only=False)[row] for c in (0, 1, 2)), (keep - first).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "s", "n", "rare", "pos"])

    found = given.mapInArrow(lean(run), "token long, s long, n long, rare long, pos int")
    found = written(found.join(shared, "token"), "shared-entries")
    known.unpersist()
    return found


def step_of(n: Column) -> Column:
    """A bucket of set sizes: each size by itself up to 32, then steps of a twentieth."""
    return F.when(n <= 32, n.cast("int")).otherwise(F.lit(33) + F.floor(F.log(n / F.lit(32.0)) / F.lit(float(np.log(1.05)))).cast("int"))


def sifted(mixed: DataFrame, percent: int) -> DataFrame:
    """mixed without the entries of hot n-grams that can have no partner there: an entry whose n-gram is a common one of
    its set needs a set of a similar size such that the common n-grams of the two alone may reach the similarity.

    What a set allows its partner's size to be is (100 + percent) / percent times its common n-grams, less its own size.
    Sizes are compared by groups of entries and buckets of sizes, never pair by pair."""
    allows = f"({100 + percent} * (n - rare) - {percent} * n)"
    hot = mixed.where(f"sets > {HOT} AND pos >= rare")
    steps = hot.groupBy("token", step_of(F.col("n")).alias("step")).agg(F.max(F.expr(allows)).alias("most"), F.min("n").alias("least"))
    steps = written(steps, "size-steps")
    asked = hot.select("token", "n", "rare").distinct()
    low, high = F.expr(f"({percent} * n + 99) div 100"), F.expr(f"100 * n div {percent}")
    asked = asked.select("*", F.explode(F.sequence(step_of(low), step_of(high))).alias("step"))
    able = asked.join(small(steps), ["token", "step"]).where(f"most >= {percent} * n AND {percent} * least <= {allows}")
    able = written(able.select("token", "n", "rare").distinct(), "able-groups")
    kept = mixed.where(f"sets > {HOT} AND pos >= rare").join(small(able), ["token", "n", "rare"], "left_semi")
    return mixed.where(f"NOT (sets > {HOT} AND pos >= rare)").unionByName(kept.select(mixed.columns))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, component, text_hash, stays) for every row of docs; component is a number that the
    rows of a component share, null without a set; stays is true for the rows of a component's least key (null last) and
    then least text's hash, and for all without a set.

    A document's set is that of its n-grams of `size` words; with fewer words, but not none, its whole sequence is the
    one member. Two documents link when their sets' Jaccard similarity is `percent` or more; component_id is the least
    key that links reach, the document's own included. Null and empty texts have no set, link with nothing, and are their
    own component; a null key is never the least, and a component of null keys has a null id. Repeated rows are each
    given. Texts of any length are read whole. An empty table gives no rows. Other columns are not read, whatever their
    names. The key is an integer. Different sets are told apart by two 64-bit hashes.
    """
    with scope():
        order = docs.sparkSession.sparkContext.broadcast(common_ngrams(docs, text, size))
        found = written(_near_duplicates(docs, key, text, size, percent, order), "near-duplicates", keep=True)
        order.unpersist()
    return found


def _near_duplicates(docs: DataFrame, key: str, text: str, size: int, percent: int, order) -> DataFrame:
    rows = prefixes(docs, key, text, size, percent, order).withColumn("uid", F.monotonically_increasing_id())
    rows, classes = told_apart(written(rows, "prefixes"), key)
    entries = shared_entries(rows, classes)

    similar = f"least(na, nb) * 100 >= {percent} * greatest(na, nb)"
    # Two sets' common n-grams overlap by the smaller number of them at most; the star's centre is the set with the fewest others.
    reach = lambda o: f"({100 + percent}) * ({o}) >= {percent} * (na + nb)"
    commons = "least(na - ra, nb - rb)"
    named = (("s", ""), ("n", "n"), ("rare", "r"), ("pos", "p"))
    side = lambda df, x, *more: df.select("token", *[F.col(c).alias(short + x) for c, short in named], *more)
    counts = entries.groupBy("token").agg(F.count("*").alias("sets"), F.min(F.struct("rare", "s", "n")).alias("hub"))
    hubs = counts.where(f"sets > {STAR}").select("token", F.col("hub.s").alias("a"), F.col("hub.n").alias("na"), F.col("hub.rare").alias("ra"))
    stars = side(entries, "b").join(hubs, "token").where("a != b").where(similar).where(reach(f"{commons} + least(ra, rb)"))
    stars = written(stars.select("a", "na", "b", "nb").distinct(), "star-pairs")
    links = [checked(stars, docs, classes, key, text, size, percent, order)]
    tree = components(links[0])
    entries = written(
        entries.join(small(tree.select(F.col("v").alias("s"), "root")), "s", "left").withColumn("root", F.coalesce("root", "s")), "rooted-entries"
    )
    # Pairs of different components: on each n-gram, sets outside its largest component with all others. On a common n-gram
    # only those that common n-grams alone may bring to the similarity: others need one of the others in common, all of
    # which, where a set has no more than its prefix, are in its prefix.
    groups = entries.groupBy("token", "root").agg(F.count("*").alias("sets"))
    most = [F.max(F.struct("sets", "root")).alias("most"), F.count("*").alias("roots"), F.sum("sets").alias("sets")]
    main = groups.groupBy("token").agg(*most).where("roots > 1").select("token", F.col("most.root").alias("main"), "sets")
    mixed = entries.join(main, "token").withColumn("inner", F.col("root") == F.col("main"))
    mixed = written(sifted(written(mixed, "mixed-entries"), percent), "sifted-entries")
    # The entries outside of a hot n-gram are dealt over cells, and all of its entries are sent to each.
    cells = F.greatest(F.expr(f"cast(sets div {HOT} as int)"), F.lit(1))
    one = side(mixed.where("NOT inner"), "a", F.col("root").alias("roota"), F.pmod(F.xxhash64("s"), cells).cast("int").alias("cell"))
    two = side(mixed, "b", F.col("root").alias("rootb"), "inner", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
    met = one.join(two, ["token", "cell"]).where(f"roota != rootb AND (inner OR a < b) AND {similar} AND (pa < ra OR {reach(commons)})")
    swap = F.col("a") < F.col("b")
    pick = lambda x, y, name: F.when(swap, F.col(x)).otherwise(F.col(y)).alias(name)
    pairs = [pick(f"{c}a", f"{c}b", f"{c}a") for c in ("", "n", "r", "p")] + [pick(f"{c}b", f"{c}a", f"{c}b") for c in ("", "n", "r", "p")]
    sums = [F.count("*").alias("c"), F.sum(F.expr("cast(pa < ra AS int)")).alias("c0"), F.max("pa").alias("pa"), F.max("pb").alias("pb")]
    per_pair = met.select(*pairs).groupBy("a", "na", "ra", "b", "nb", "rb").agg(*sums)
    # Of two prefixes the one that ends first in the order is all within the other's range. So up to its end, one set has
    # its whole prefix, the other at least all up to the last shared n-gram, and c of them are shared; similar sets differ
    # in at most (100 - percent) / (100 + percent) of their sizes' sum. Where rows of common n-grams were left out above,
    # this holds up to the end of the others.
    length = lambda n: f"({n} - ({percent} * {n} + 99) div 100 + 1)"
    known = lambda n, r: f"if({reach(commons)}, {length(n)}, least({length(n)}, {r}))"
    apart = f"least({known('na', 'ra')} + pb + 1, {known('nb', 'rb')} + pa + 1) - 2 * c"
    near = f"({apart}) * {100 + percent} <= {100 - percent} * (na + nb)"
    whole = f"ra <= {length('na')} AND rb <= {length('nb')}"  # c0 counts all that are shared beside the common ones
    crossed = per_pair.where(near).where(f"NOT ({whole}) OR {reach(f'{commons} + c0')}")
    crossed = written(crossed.select("a", "na", "b", "nb"), "cross-pairs")
    links.append(checked(crossed, docs, classes, key, text, size, percent, order))
    tree = components(links[0].unionByName(links[1]))

    rooted = classes.join(tree.select(F.col("v").alias("s"), "root"), "s", "left").select("s", "own", F.coalesce("root", "s").alias("root"))
    rooted = written(rooted, "rooted-classes")
    least = written(rooted.groupBy("root").agg(F.min("own").alias("least")), "least-rows")
    of_class = rooted.join(small(least), "root").select("s", F.col("root").alias("component"), "least")
    of_class = small(written(of_class, "components"))
    columns = [key, F.col("n").alias("n_shingles"), "component_id", "component", F.col("t").alias("text_hash"), "stays"]
    stays = F.col(key).eqNullSafe(F.col("least.k")) & (F.col("t") == F.col("least.t"))
    with_set = rows.where("s IS NOT NULL").join(of_class, "s").withColumns({"component_id": F.col("least.k"), "stays": stays})
    bare = rows.where("s IS NULL").withColumns({"component_id": F.col(key), "component": F.lit(None).cast("long"), "stays": F.lit(True)})
    return with_set.select(columns).unionByName(bare.select(columns))


def extra_rows(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text_hash) of near_duplicates's rows that are not the one of their component that stays."""
    return found.where("NOT stays").select(key, "text_hash")


def checked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str, size: int, percent: int, order) -> DataFrame:
    """verified, with a text for each set of the pairs fetched."""

    def fetch(some: DataFrame) -> DataFrame:
        wanted = written(some.select(F.col("a").alias("s")).unionByName(some.select(F.col("b").alias("s"))).distinct(), "wanted")
        # a row for each set, found on narrow columns
        holders = small(written(classes.join(small(wanted), "s", "left_semi").select("s", "own.k", "own.t"), "holders"))
        own = docs.select(F.col(key).alias("_k"), F.col(text).alias("text"), F.xxhash64(text).alias("_t"))
        return own.join(holders, F.col("_k").eqNullSafe(F.col("k")) & (F.col("_t") == F.col("t"))).select("s", "text")

    return written(verified(pairs, fetch, order, size, percent), "links")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component; see near_duplicates for nulls, repeats and empty tables."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
