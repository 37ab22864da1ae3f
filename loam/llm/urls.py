"""URL filter: a blocked Bloom filter of listed URL rules passes possible hits to an exact join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import ascii_lower, small, table, written

#: Odd multipliers that pick one bit in each of the eight 32-bit words of a block (fixed values).
SALTS = np.array(
    [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint64
)
#: Bounds of the broadcast filter: bits for each rule, and 256-bit blocks at most (64 MB); beyond, it passes more, never less.
BITS_PER_RULE, MAX_BLOCKS = 16, 1 << 21
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def block_words(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each 64-bit hash, and the bit that it has in each of the block's eight words."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    bits = ((low[:, None] * SALTS) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
    return (high * np.uint64(blocks)) >> np.uint64(32), np.uint32(1) << bits.astype(np.uint32)


def key_hash(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode(), seed=42)  # as Spark's xxhash64 of one string


def build_filter(hashes: DataFrame, count: int) -> np.ndarray:
    """The filter of keys' hashes (h) as blocks x 8 words; executors set the bits, the driver gets the bounded array's words."""
    blocks = max(1, min(MAX_BLOCKS, -(-count * BITS_PER_RULE // 256)))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            block, words = block_words(pdf["h"].to_numpy().astype(np.int64).view(np.uint64), blocks)
            at = (block[:, None] * np.uint64(8) + np.arange(8, dtype=np.uint64)).ravel()
            yield pd.DataFrame({"at": at.astype(np.int64), "word": words.ravel().astype(np.int64)})

    found = hashes.select("h").mapInPandas(bits, "at long, word long")
    words = found.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(blocks * 8, dtype=np.uint32)
    out[words["at"].to_numpy()] = words["word"].to_numpy().astype(np.uint32)
    return out.reshape(blocks, 8)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added (replacing columns so named).

    rules has host, path, verdict. A rule fits its host and all its subdomains where the page's path starts with the
    rule's path; of several that fit, the longest host and path together wins, then the longer host. A page's keys are
    its host's suffixes at dots, each with the prefixes of its path that have the length of some rule's path; the Bloom
    filter drops nearly all keys that no rule has, and a hash join on the key removes the rest. Pages without a rule get
    `default`.

    Null, empty and scheme-less urls have empty host and path and fit no rule of a host. Repeated pages are all kept,
    repeated rules count once; with no rules or no pages all is `default` or empty. Lookups are made once for each
    distinct (host, path), whatever the number of pages of a hot host; pages without a host are not joined. Urls of any
    length are parsed whole.
    """
    spark = pages.sparkSession
    listed = rules.select(
        F.concat(ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))).alias("key"),
        F.length("host").alias("host_length"),
        F.length("path").alias("path_length"),
        F.col("verdict").alias("rule_verdict"),
    ).dropDuplicates(["key", "host_length"])
    count = listed.count()
    lengths = sorted(r[0] for r in listed.select("path_length").distinct().collect())  # path lengths of rules: as many as a URL may be long
    held = spark.sparkContext.broadcast(build_filter(listed.select(F.xxhash64("key").alias("h")), count))

    @F.pandas_udf("array<struct<key:string,host_length:int>>")
    def possible(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        words = held.value
        keys, sizes, owner = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            cut = [path[:n] for n in lengths if n <= len(path)]
            suffix = host
            while suffix:
                keys += [suffix + p for p in cut]
                sizes += [len(suffix)] * len(cut)
                owner += [i] * len(cut)
                suffix = suffix.partition(".")[2]
        out: list[list] = [[] for _ in range(len(hosts))]
        if keys:
            block, bits = block_words(np.array([key_hash(k) for k in keys], dtype=np.uint64), len(words))
            for j in np.flatnonzero(((words[block] & bits) == bits).all(axis=1)):
                out[owner[j]].append({"key": keys[j], "host_length": sizes[j]})
        return pd.Series(out)

    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*rest, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    asked = parsed.select("host", "path").where("host != ''").distinct()
    hits = asked.select("host", "path", F.inline(possible("host", "path")))
    longest = F.struct(F.length("key").alias("n"), "host_length", "key", "rule_verdict")
    judged = (
        hits.join(small(listed), ["key", "host_length"])
        .groupBy("host", "path")
        .agg(F.max(longest).alias("best"))
        .select("host", "path", F.col("best.key").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    )
    found = parsed.where("host != ''").join(small(written(judged, "judged-urls")), ["host", "path"], "left")
    bare = parsed.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    columns = [*rest, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")]
    return found.select(columns).unionByName(bare.select(columns))


#: The rules of the query (fixed values).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; see filter_urls for nulls, repeats and empty tables."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict"
    )


OP6_SQL = """
WITH rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                               ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parsed AS (
  SELECT page_id, row_number() OVER () AS r,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parsed LEFT JOIN fits ON parsed.r = fits.r AND fits.k = 1
"""
