"""Tokenisation as native columns: one regular expression tiles the text, so nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LONGEST = 2, 29
#: Letters; entities that are white space; what vanishes inside a word: other entities, a bare &, quotes, combining marks.
LETTER = r"[a-zA-Zא-ת]"
SPACE_ENTITY = r"&(?:nbsp|ensp|emsp|#0*(?:160|8194|8195|8201));"
IGNORED = rf"(?:(?!{SPACE_ENTITY})&[^;]{{0,10}};|&(?![^;]{{0,10}};)|[\"׳״]|[\p{{Mn}}&&[\u0080-￿]])"
#: Possessive, so that words and runs of any length take a loop and no stack.
TILE = rf"(?:<[^>]*+(?:>|\z)|&[^;]{{0,10}}+;)|({LETTER}++(?:(?:{IGNORED})++{LETTER}++)*+)"
#: The same where nothing vanishes and no entity is, of lower-case text; only words of SHORTEST to LONGEST letters are captured.
PLAIN = rf"([a-zא-ת]{{{SHORTEST},{LONGEST}}}+)(?![a-zא-ת])|[a-zא-ת]++|<[^>]*+(?:>|\z)"
#: What a text must hold, if not & or a quote, to need TILE; also the two letters whose lower case has an ASCII letter.
VANISHING = r"[\u0080-￿&&[\p{Mn}׳״\u0130\u212A]]"
#: Elements that end a line of text (fixed values).
BLOCK_TAGS = (
    "p br hr li ul ol tr td th dd dt h1 h2 h3 h4 h5 h6 div pre nav main table aside header footer figure section article "
    "caption figcaption blockquote"
).split()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _tiled(body: Column) -> Column:
    """Whether a text needs TILE; only texts beyond ASCII are searched by a regular expression."""
    return body.contains("&") | body.contains('"') | ((F.octet_length(body) != F.length(body)) & body.rlike(VANISHING))


def _found(text: Column) -> Column:
    """tokens, with empty strings between."""
    body = F.coalesce(text, F.lit(""))
    plain = F.regexp_extract_all(F.lower(body), F.lit(PLAIN), F.lit(1))
    found = F.filter(F.regexp_extract_all(body, F.lit(TILE), F.lit(1)), lambda t: t != "")
    gone = lambda t: F.when(t.rlike(r"[^a-zA-Zא-ת]"), F.regexp_replace(t, r"&[^;]{0,10};|[^a-zA-Zא-ת]", "")).otherwise(t)
    bare = F.transform(found, lambda t: ascii_lower(gone(t)))
    return F.when(_tiled(body), F.filter(bare, lambda t: F.length(t).between(SHORTEST, LONGEST))).otherwise(plain)


def tokens(text: Column) -> Column:
    """The normalised terms of an HTML text in order: tags and white-space entities separate, other entities, quotes and
    combining marks vanish, only terms of 2 to 29 letters stay. Null has none."""
    return F.array_remove(_found(text), "")


def tokens_sql(text: str) -> str:
    """tokens of a SQL expression, as SQL."""
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    bare = lower.format(r"regexp_replace(t, r'&[^;]{0,10};|[^a-zA-Zא-ת]', '')")
    body = f"coalesce({text}, '')"
    tiled = f"contains({body}, '&') OR contains({body}, '\"') OR (octet_length({body}) <> length({body}) AND {body} RLIKE r'{VANISHING}')"
    return (
        f"array_remove(if({tiled}, filter(transform(filter(regexp_extract_all({body}, r'{TILE}', 1), t -> t <> ''), t -> {bare}), "
        f"t -> length(t) BETWEEN {SHORTEST} AND {LONGEST}), regexp_extract_all(lower({body}), r'{PLAIN}', 1)), '')"
    )


def distinct_terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(_found(text)), "")


def strip_markup(text: Column) -> Column:
    """Without tags and {X} paragraph marks (X a Hebrew letter); entities stay. Null gives the empty string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*(?:>|\z)|\{[א-ת]\}", "")


def is_block_tag(name: Column) -> Column:
    return F.lower(name).isin(BLOCK_TAGS)


def normalise_query(q: Column) -> Column:
    """A query word as it is looked up: letters, * and ? stay, all else goes and its neighbours join."""
    return ascii_lower(F.regexp_replace(q, r"[^a-zA-Zא-ת*?]", ""))


def ngrams(term: Column, n: int) -> Column:
    """The distinct n-grams of a term's letters, in order; none for shorter terms."""
    starts = F.sequence(F.lit(1), F.length(term) - n + 1)
    return F.when(F.length(term) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(term, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>")
    )
