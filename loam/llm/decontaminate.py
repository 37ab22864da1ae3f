"""Benchmark decontamination by a prefix-filtered set join of word windows. DataFrame operations only.

A window is 13 consecutive words of an item (an item of fewer, but not none, is one window), as a set of its shingles of
up to five words. A document holds a window only if it holds all of the window's shingles, so one necessary shingle of
each window is looked up: its rarest, by the number of times that documents have it. Rows that the lookup brings are
bounded by place and length, and then verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import ascii_lower, small, table, written

WINDOW, SHINGLE = 13, 5
#: What separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def bound(x: Column, f) -> Column:
    """f of x's value, evaluated once: a name for an expression inside one."""
    return F.element_at(F.transform(F.array(x), f), 1)


def shingle_runs(w: Column, sizes: list[int]) -> Column:
    """A struct (at, shingle, n) for every run of so many words of an array, for all sizes at once: its place from 0, its
    hash, the array's length."""
    none = F.array().cast("array<struct<at:int,shingle:bigint,n:int>>")

    def of_size(h: Column, size: int) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(h) - size),
            lambda i: F.struct(
                i.alias("at"),
                F.xxhash64(F.lit(size), *[F.get(h, i + k) for k in range(size)]).alias("shingle"),
                F.size(h).alias("n"),
            ),
        )
        return F.when(F.size(h) >= size, runs).otherwise(none)

    return bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.concat(*[of_size(h, n) for n in sizes]))


def item_windows(items: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(item_id, words, length, window) of every window of every item, window being a hash of its words."""
    name = F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item_id")
    own = items.select(name, words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = own.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), size).alias("words"))
    return cut.distinct().select("item_id", "words", F.size("words").alias("length"), F.xxhash64("words").alias("window"))


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW
) -> DataFrame:
    """(key, text_hash, n_words, n_hit, items, spans) of every row of docs: its words, how many of them lie in an occurrence of a
    window, the sorted ids (as strings) of the items with occurring windows, and the occurrences as (start, length) in
    words.

    Whole texts on both sides. Null and empty texts have no words, no hits and no items; items without words have no
    windows; an item's null id is the empty string. Repeated rows each have their result; rows that share a key but not
    the text are told apart. Empty tables of documents or items give no rows, or no hits. Texts of any length are read
    whole. Other columns are not read, whatever their names. A shingle that very many documents have is looked up only for
    windows that have no rarer one.
    """
    windows = written(item_windows(items, item, item_text, size), "windows")
    distinct = windows.select("window", "words", "length").dropDuplicates(["window"])
    sizes = sorted(r[0] for r in distinct.select(F.least("length", F.lit(SHINGLE))).distinct().collect())  # 1 to 5
    row = F.struct(F.xxhash64(F.col(key)).alias("key"), F.xxhash64(F.col(text)).alias("text")).alias("row")  # 128 bits
    tokens = docs.select(row, words(F.col(text)).alias("w"))
    counts = docs.select(F.col(key), row, F.xxhash64(text).alias("text_hash"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    found = None
    if sizes:
        cut = [
            distinct.where(F.least("length", F.lit(SHINGLE)) == n).select("window", "length", F.inline(shingle_runs(F.col("words"), [n])))
            for n in sizes
        ]
        shingles = cut[0]
        for x in cut[1:]:
            shingles = shingles.unionByName(x)
        shingles = written(shingles.select("window", "length", "shingle", F.col("at").alias("place")), "window-shingles")
        known = small(written(shingles.select("shingle").distinct(), "shingles"))
        seen = tokens.select("row", F.inline(shingle_runs(F.col("w"), sizes))).join(known, "shingle", "left_semi")
        found = occurrences(docs.select(row, F.col(text).alias("text")), written(seen, "shingles-seen"), shingles, distinct, windows)
    if found is None:
        return counts.select(
            key, "text_hash", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"),
            F.array().cast("array<struct<start:int,length:int>>").alias("spans"),
        )
    return counts.join(found, "row", "left").select(
        key,
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
    )


def occurrences(texts: DataFrame, seen: DataFrame, shingles: DataFrame, distinct: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, n_hit, items, spans) of the rows with verified occurrences."""
    rarity = seen.groupBy("shingle").count()
    prefix = (  # a shingle that no document has rules its window out
        shingles.join(rarity, "shingle", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "place")).alias("least"), F.first("length").alias("length"))
        .where("least.count > 0")
        .select("window", "length", "least.shingle", "least.place")
    )
    start = F.col("at") - F.col("place")
    candidates = written(
        seen.join(small(written(prefix, "prefixes")), "shingle")
        .where((start >= 0) & (start + F.col("length") <= F.col("n")))
        .select("row", "window", start.alias("start"))
        .distinct()
        .join(small(distinct), "window"),
        "candidates",
    )
    asked = candidates.groupBy("row").agg(F.collect_list(F.struct("start", "length", "words", "window")).alias("asked"))
    rows = small(written(candidates.select("row").distinct(), "candidate-rows"))
    bodies = texts.join(rows, "row", "left_semi").dropDuplicates(["row"]).select("row", words(F.col("text")).alias("w"))

    def same(w: Column, c: Column) -> Column:
        return F.forall(F.sequence(F.lit(0), c["length"] - 1), lambda k: F.get(w, c["start"] + k) == F.get(c["words"], k))

    ok = bound(F.col("w"), lambda w: F.filter("asked", lambda c: same(w, c)))
    held = written(
        bodies.join(asked, "row")
        .select("row", F.transform(ok, lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length"), c["window"].alias("window"))).alias("held"))
        .where(F.size("held") > 0),
        "occurrences",
    )
    places = F.flatten(F.transform("held", lambda c: F.sequence(c["start"], c["start"] + c["length"] - 1)))
    spans = F.array_sort(F.array_distinct(F.transform("held", lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length")))))
    hits = held.select("row", F.size(F.array_distinct(places)).alias("n_hit"), spans.alias("spans"))
    owned = held.select("row", F.explode(F.array_distinct(F.transform("held", lambda c: c["window"]))).alias("window"))
    named = (
        owned.join(small(windows.select("window", "item_id")), "window")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    return hits.join(named, "row")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's benchmark words; see contamination for nulls, repeats and empty tables."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS v
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(s) WHERE len(w) > 0),
places AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS v
  FROM d, (SELECT DISTINCT n FROM windows) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(s)),
found AS (SELECT DISTINCT r, s, places.n, item FROM places JOIN windows ON places.v = windows.v AND places.n = windows.n),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(s, s + n)) AS t(p) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
