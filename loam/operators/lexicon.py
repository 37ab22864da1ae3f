"""A dictionary of (key, value): lookups exact, by part, by edits, and by Hebrew affixes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.hebrew import LEXICON_PREFIXES, LEXICON_SUFFIXES


class BadEntries(ValueError):
    """Entries with a null or repeated key."""


def build(entries: DataFrame, path: str | None = None) -> DataFrame:
    """Checks entries (key, value) and gives them sorted, with the reversed key beside; written if a path is given, and
    beside it, under the name with -reversed, a copy sorted by the reversed key, whose row groups ends_with can skip. Spark
    sorts, so that input order does not matter; a null or repeated key is an error, the empty key is not."""
    bad = entries.groupBy("key").count().where("key IS NULL OR count > 1").orderBy("key").limit(1).collect()
    if bad:
        raise BadEntries(f"key {bad[0]['key']!r} is null or repeated")
    out = entries.select("key", "value", F.reverse("key").alias("rkey")).orderBy("key")
    if path is None:
        return out
    out.write.mode("overwrite").parquet(path)
    out.orderBy("rkey").write.mode("overwrite").parquet(f"{path}-reversed")
    return entries.sparkSession.read.parquet(path)


def exact(lexicon: DataFrame, key: str) -> DataFrame:
    return lexicon.where(F.col("key") == key).select("key", "value")


def enumerate_all(lexicon: DataFrame) -> DataFrame:
    return lexicon.select("key", "value").orderBy("key")


def starts_with(lexicon: DataFrame, part: str) -> DataFrame:
    return lexicon.where(F.col("key").startswith(part)).select("key", "value")


def ends_with(lexicon: DataFrame, part: str) -> DataFrame:
    """By the reversed key, as a prefix that a sorted file can skip by, where the lexicon has one."""
    test = F.col("rkey").startswith(part[::-1]) if "rkey" in lexicon.columns else F.col("key").endswith(part)
    return lexicon.where(test).select("key", "value")


def contains(lexicon: DataFrame, part: str) -> DataFrame:
    return lexicon.where(F.col("key").contains(part)).select("key", "value")


def fuzzy(lexicon: DataFrame, key: str, edits: int) -> DataFrame:
    """Within so many insertions, deletions and substitutions of code points; with the distance."""
    distance = F.levenshtein(F.col("key"), F.lit(key), edits)
    return lexicon.where(distance.between(0, edits)).select("key", "value", distance.alias("distance"))


def _only(affixes: list[str]) -> str:
    return "(?:" + "|".join(map(re.escape, sorted(set(affixes), key=len, reverse=True))) + ")*"


def affixed(lexicon: DataFrame, word: str, before: bool = True, after: bool = True, strict: bool = False) -> DataFrame:
    """Keys that are the word with known prefixes before it, and suffixes after it, if these are asked for. strict: keys
    whose greedy stripping leaves exactly the word."""
    if strict:
        part = contains if before and after else ends_with if before else starts_with
        return part(lexicon, word).where(stripped(F.col("key"), before, after) == word)
    pattern = f"^{_only(LEXICON_PREFIXES) if before else ''}{re.escape(word)}{_only(LEXICON_SUFFIXES) if after else ''}$"
    return lexicon.where(F.col("key").contains(word) & F.col("key").rlike(pattern)).select("key", "value")


def stripped(word: Column, before: bool = True, after: bool = True) -> Column:
    """A word without the dictionary's prefixes before it, the longest first, as long as one fits, and then without its
    suffixes after it, each length's in turn as often as it fits. Native; null gives null."""
    if before:
        word = F.regexp_replace(word, f"^{_only(LEXICON_PREFIXES)}+", "")  # possessive
    if after:
        for s in sorted(LEXICON_SUFFIXES, key=len, reverse=True):
            word = F.regexp_replace(word, f"(?:{re.escape(s)})+$", "")
    return word


def morphology(df: DataFrame, word: str = "word") -> DataFrame:
    """df with root, prefix and suffix of a word column added (columns so named replaced): prefix, root and suffix together
    are the word. Null has none."""
    w, rest = F.col(word), stripped(F.col(word), after=False)
    root = stripped(rest, before=False)
    prefix = F.substring(w, F.lit(1), F.length(w) - F.length(rest))
    return df.withColumns({"root": root, "prefix": prefix, "suffix": F.substring(rest, F.length(root) + 1, F.length(rest))})


def trie_edges(lexicon: DataFrame) -> DataFrame:
    """(node, label, next, final) edges of the keys' prefix tree, for drawing."""
    steps = lexicon.where(F.length("key") > 0).select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n"))
    part = lambda n: F.substring("key", F.lit(1), n)
    rows = steps.select(
        part(F.col("n") - 1).alias("node"),
        F.substring("key", F.col("n"), F.lit(1)).alias("label"),
        part(F.col("n")).alias("next"),
        (F.col("n") == F.length("key")).alias("final"),
    )
    return rows.groupBy("node", "label", "next").agg(F.max("final").alias("final"))


def to_dot(lexicon: DataFrame, limit: int = 1000) -> str:
    """The prefix tree's first edges as a Graphviz graph."""
    rows = trie_edges(lexicon).orderBy("next").limit(limit).collect()
    lines = [f'  "{r.node}" -> "{r.next}" [label="{r.label}"{", style=bold" if r.final else ""}];' for r in rows]
    return "\n".join(["digraph lexicon {", *lines, "}"])
