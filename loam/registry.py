"""Names of the engine's queries, with the SQL that states the same result.

The corpus is `documents` (a document is a line, its source the book). Queries that search use an index of it, built once
for each session and folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import hebrew
from loam.functions import text as tx
from loam.functions.scanner import positional_tokens
from loam.operators import lexicon, matching, proximity, snippets
from loam.operators.search import Engine, parse_batch
from loam.plans.expand import Plan, expand
from loam.plans.query import parse
from loam.sources.corpus import Corpus
from loam.sources.pieces import dealt
from loam.sources.segments import Index, MemoryIndex
from loam.sources.storage import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_indexes: dict[tuple[str, str], Index] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf}/documents.parquet"))


def corpus(spark: SparkSession, sf: str) -> Corpus:
    return Corpus.of_documents(documents(spark, sf))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def index(spark: SparkSession, sf: str) -> Index:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = Index(spark, scratch(spark, "documents")).add(lines(spark, sf))
    return _indexes[key]


def engine(spark: SparkSession, sf: str) -> Engine:
    found = index(spark, sf)
    return Engine(corpus(spark, sf), found.postings(), found.vocabulary())


# SQL blocks: tokens with offsets, distinct terms, vocabulary, and the corpus.
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PIECE = r"""'<[^>]*>?|[a-zA-Z](?:["]|&[^;]{0,10};|&|[a-zA-Z])*|(?:&[^;]{0,10};)|[^a-zA-Z<&]+|&'"""
TOKENS = rf"""
pieces AS (SELECT doc_id, unnest(regexp_extract_all(text, {_PIECE})) AS p, generate_subscripts(regexp_extract_all(text, {_PIECE}), 1) AS i
           FROM documents),
placed AS (SELECT doc_id, i, p, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS off
           FROM pieces),
raw AS (SELECT doc_id, i, off, off + length(p) AS fin,
               {_FOLD.format("regexp_replace(p, '&[^;]{0,10};|[^a-zA-Z]', '', 'g')")} AS term
        FROM placed WHERE regexp_matches(p, '^[a-zA-Z]')),
tok AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, term, off::INT AS raw_start, fin::INT AS raw_end
        FROM raw WHERE length(term) BETWEEN 2 AND 29)"""
POST = rf"""
terms AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all({_FOLD.format("regexp_replace(text, '<[^>]*(>|$)', ' ', 'g')")}, '[a-z]+'))) AS term
          FROM documents),
post AS (SELECT term, doc_id FROM terms WHERE length(term) BETWEEN 2 AND 29),
vocab AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
CORPUS = """
book AS (SELECT dense_rank() OVER (ORDER BY source) AS book_id, source AS title FROM (SELECT DISTINCT source FROM documents)),
line AS (SELECT doc_id AS id, book_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS line_index, text AS content,
                source || ':' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS he_ref
         FROM documents JOIN book ON title = source)"""


def in_slots(*slots: str) -> str:
    """SQL: ids of documents with a term of each condition."""
    return " INTERSECT ".join(f"SELECT DISTINCT doc_id FROM post WHERE {s}" for s in slots)


# --- scans and corpus reads


@query("scan_lines_ordered_limit", "SELECT doc_id AS id, text AS content FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, sf):
    return corpus(spark, sf).scan(100)


@query("scan_lines_after_id", "SELECT doc_id AS id, text AS content FROM documents WHERE doc_id > 150 ORDER BY doc_id")
def _(spark, sf):
    return corpus(spark, sf).scan(after=150)


@query("count_lines", "SELECT count(*) AS n_lines FROM documents")
def _(spark, sf):
    return corpus(spark, sf).count_lines()


@query("count_lines_up_to", "SELECT count(*) AS n_lines FROM documents WHERE doc_id <= 120")
def _(spark, sf):
    return corpus(spark, sf).count_lines(120)


@query("id_stats", "SELECT count(*) AS n_lines, min(doc_id) AS min_id, max(doc_id) AS max_id FROM documents")
def _(spark, sf):
    return corpus(spark, sf).id_stats()


@query("offset_row", "SELECT doc_id AS id, source AS title FROM documents ORDER BY doc_id LIMIT 1 OFFSET 99")
def _(spark, sf):
    return corpus(spark, sf).row_at(99)


@query("fetch_no_content", f"WITH {CORPUS} SELECT id, title FROM line JOIN book USING (book_id)")
def _(spark, sf):
    c = corpus(spark, sf)
    return c.fetch_titles(c.line.select("id"))


@query("line_info", f"WITH {CORPUS} SELECT id, title, line_index, he_ref FROM line LEFT JOIN book USING (book_id) WHERE id = 42")
def _(spark, sf):
    return corpus(spark, sf).line_info(42)


@query("find_phrase", "SELECT doc_id AS id, text AS content FROM documents WHERE contains(lower(text), 'the of') ORDER BY doc_id LIMIT 20")
def _(spark, sf):
    return corpus(spark, sf).find_phrase("The of", 20)


@query(
    "find_book_phrase",
    f"WITH {CORPUS} SELECT id, title, line_index, he_ref FROM line JOIN book USING (book_id) WHERE contains(lower(content), 'with the') AND contains(lower(title), 'src1')",
)
def _(spark, sf):
    return corpus(spark, sf).find_book_phrase("SRC1", "with the")


@query("find_books", f"WITH {CORPUS} SELECT book_id, title FROM book WHERE contains(lower(title), 'src1') ORDER BY book_id LIMIT 50")
def _(spark, sf):
    return corpus(spark, sf).find_books("src1")


# --- tokens


@query("tokenize_terms", f"WITH {TOKENS} SELECT term, count(*) AS n FROM tok GROUP BY term")
def _(spark, sf):
    terms = documents(spark, sf).select(F.explode(tx.tokens(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


@query("tokenize_distinct", f"WITH {TOKENS} SELECT doc_id, count(DISTINCT term) AS n_terms FROM tok GROUP BY doc_id")
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.size(tx.distinct_terms(F.col("text"))).cast("long").alias("n_terms"))
    return docs.where("n_terms > 0")


@query("token_positions", f"WITH {TOKENS} SELECT doc_id, pos, term, raw_start, raw_end FROM tok")
def _(spark, sf):
    return positional_tokens(documents(spark, sf)).select("doc_id", "pos", "term", "raw_start", "raw_end")


_SPACED = "regexp_replace(html, '&(nbsp|ensp|emsp|#0*(160|8194|8195|8201));', ' ', 'g')"


@query(
    "tokenize_html_pages",
    f"WITH {TOKENS.replace('FROM documents)', f'FROM (SELECT page_id AS doc_id, {_SPACED} AS text FROM pages))')} "
    "SELECT page_id, count(term)::INT AS n_tokens, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS terms "
    "FROM pages LEFT JOIN tok ON page_id = doc_id GROUP BY page_id",
)
def _(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", F.size(tx.tokens(F.col("html"))).alias("n_tokens"), F.array_join(tx.tokens(F.col("html")), " ").alias("terms"))


def fixture(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """SQL: constant rows."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


HEBREW = [
    ("רשב\"א", "רשבא"),
    ("א־בגד", "בגד"),
    ("כִּי בְיִצְחָק יִקָּרֵא", "כי ביצחק יקרא"),
    ("שלום׀עולם", "שלום עולם"),
    ("תורה׃ מצוה", "תורה מצוה"),
]
ENTITIES = [
    ("AT&amp;T x", "att"),
    ("foo&nbsp;bar", "foo bar"),
    ("foo & bar; baz", "foo baz"),
    ("x&#0160;yy zz", "yy zz"),
    ("<b>ab</b>cd", "ab cd"),
    ("q<b", ""),
    ("ab&lt;cd&gt; ef", "abcd ef"),
    ("&lt;foo", "foo"),
    ("étude é", "tude"),
    ("x" * 30 + " " + "y" * 29, "y" * 29),
]
MARKUP = [("a <b>bold</b> c", "a bold c"), ("{א} first {b} <i", " first {b} "), ("x &amp; y", "x &amp; y")]


def _terms_of(rows):
    return lambda spark, sf: fixture(spark, [(a,) for a, _ in rows], "html string").select(
        "html", F.array_join(tx.tokens(F.col("html")), " ").alias("terms")
    )


query("tokenize_hebrew_fixture", values(HEBREW, "html, terms"))(_terms_of(HEBREW))
query("html_entity_fixture", values(ENTITIES, "html, terms"))(_terms_of(ENTITIES))


@query("encode_strip_tags", values(MARKUP, "html, stripped"))
def _(spark, sf):
    return fixture(spark, [(a,) for a, _ in MARKUP], "html string").select("html", tx.strip_markup(F.col("html")).alias("stripped"))


# --- index


@query("build_postings", f"WITH {POST} SELECT term, doc_id FROM post")
def _(spark, sf):
    return index(spark, sf).postings()


@query("vocabulary_df", f"WITH {POST} SELECT term, df FROM vocab")
def _(spark, sf):
    return index(spark, sf).vocabulary()


@query("segment_ranges", f"WITH {POST} SELECT 0 AS segment, 0 AS level, min(doc_id) AS min_doc, max(doc_id) AS max_doc FROM post")
def _(spark, sf):
    return index(spark, sf).ranges()


@query("vocab_stats", f"WITH {POST} SELECT count(*) AS n_terms, sum(length(term))::BIGINT AS n_letters, max(df) AS max_df FROM vocab")
def _(spark, sf):
    return index(spark, sf).vocabulary().agg(F.count("*").alias("n_terms"), F.sum(F.length("term")).alias("n_letters"), F.max("df").alias("max_df"))


# --- boolean search


def searched(name: str, text: str, *slots: str) -> None:
    sql = f"WITH {POST} {in_slots(*slots)}" if slots else f"WITH {POST} SELECT doc_id FROM post WHERE false"
    query(name, sql)(lambda spark, sf: engine(spark, sf).search_ids(text))


STAR = "term LIKE '{}' AND length(term) <= {}"
searched("search_and_two", "the of", "term = 'the'", "term = 'of'")
searched("search_and_three", "the and with", "term = 'the'", "term = 'and'", "term = 'with'")
searched("search_missing_term", "the nonexistentword")
searched("search_or", "with | from", "term IN ('with', 'from')")
searched("search_mixed_and_or", "the of | and is", "term = 'the'", "term IN ('of', 'and')", "term = 'is'")
searched("search_ids_only", "The  AND", "term = 'the'", "term = 'and'")
searched("search_wildcard_and_literal", "the* of", STAR.format("the%", 7), "term = 'of'")
_NEAR = "(contains(term, 'the') OR contains(term, 'her') OR contains(term, 'ere')) AND levenshtein(term, 'there') <= {}"
searched("search_fuzzy_and_literal", "there~ of", _NEAR.format(1), "term = 'of'")
searched("search_or_mixed_expansion", "the* | and with", f"({STAR.format('the%', 7)}) OR term = 'and'", "term = 'with'")
searched("search_dropped_slot", "zq* the of", "term = 'the'", "term = 'of'")
searched("fuzzy_hard_miss", "zqxjkv~ | the")


def searched_unlisted(name: str, text: str, *slots: str) -> None:
    query(name, f"WITH {POST} {in_slots(*slots)}")(lambda spark, sf: engine(spark, sf).search_ids_unlisted(text))


searched_unlisted("search_unlisted_infix", "*he* | of and", f"({STAR.format('%he%', 9)}) OR term = 'of'", "term = 'and'")
searched_unlisted("search_unlisted_fuzzy", "zq* there~2 the*", _NEAR.format(2), STAR.format("the%", 7))


@query("search_in_memory", f"WITH {POST} {in_slots("term = 'the'", STAR.format('of%', 6))}")
def _(spark, sf):
    own = MemoryIndex(lines(spark, sf))
    return Engine(corpus(spark, sf), own.postings(), own.vocabulary()).search_ids("the of*")


@query("reader_modes", f"WITH {POST} SELECT 'and' AS mode, count(*) AS n FROM ({in_slots(STAR.format('the', 3), STAR.format('and', 3))}) UNION ALL SELECT 'or', count(DISTINCT doc_id) FROM post WHERE term IN ('the', 'and') UNION ALL SELECT 'df:the', df FROM vocab WHERE term = 'the'")
def _(spark, sf):
    rows = index(spark, sf).postings()
    count = lambda df, mode: df.agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n")
    both, one = matching.all_of(rows, ["the", "and"]), matching.any_of(rows, ["the", "and"])
    df = matching.term_counts(rows, ["the"]).select(F.concat(F.lit("df:"), "term").alias("mode"), F.col("df").alias("n"))
    return count(both, "and").unionByName(count(one, "or")).unionByName(df)


@query("diff_ids", f"WITH {POST}, l AS ({in_slots(STAR.format('the', 3))}), r AS ({in_slots(STAR.format('and', 3))}) SELECT doc_id, 'left' AS side FROM (FROM l EXCEPT FROM r) UNION ALL SELECT doc_id, 'right' FROM (FROM r EXCEPT FROM l)")
def _(spark, sf):
    e = engine(spark, sf)
    return matching.difference(e.search_ids("the"), e.search_ids("and"))


# --- expansion


def expanded(name: str, text: str, where: str) -> None:
    def run(spark, sf):
        return expand(index(spark, sf).vocabulary(), parse(text)[0][0])

    query(name, f"WITH {POST} SELECT term FROM vocab WHERE {where}")(run)


expanded("wildcard_prefix", "the*", STAR.format("the%", 7))
expanded("wildcard_suffix", "*tion", STAR.format("%tion", 7))
expanded("wildcard_infix", "*ther*", STAR.format("%ther%", 11))
expanded("wildcard_middle", "t*on", STAR.format("t%on", 7))
expanded("wildcard_short_anchor", "t*", "false")
expanded("optional_char", "thre?", "term IN ('thre', 'thr')")
expanded("optional_multi", "th?e?re*", f"({STAR.format('there%', 9)}) OR ({STAR.format('thre%', 8)}) OR ({STAR.format('tere%', 8)}) OR ({STAR.format('tre%', 7)})")
expanded("optional_too_many", "a?b?c?d?e?f", "false")
expanded("fuzzy_1", "there~", _NEAR.format(1))
expanded("fuzzy_2", "there~2", _NEAR.format(2))
expanded("fuzzy_3", "there~3", _NEAR.format(3))
expanded("fuzzy_3letter", "the~", "(contains(term, 'th') OR contains(term, 'he')) AND levenshtein(term, 'the') <= 1")
expanded("fuzzy_2letter", "in~", "contains(term, 'in') AND levenshtein(term, 'in') <= 1")

AFFIX_VOCABULARY = ["תורה", "ותורה", "בתורה", "תורהכם", "התורתי", "שבתורה", "ותורהנו", "מצוה", "הקתורה"]
GRAMMAR = {
    "grammar_prefix_fixture": ("%תורה", ["תורה", "ותורה", "בתורה"]),
    "grammar_suffix_fixture": ("תורה%", ["תורה", "תורהכם"]),
    "grammar_both_fixture": ("%תורה%", ["תורה", "ותורה", "בתורה", "תורהכם", "ותורהנו"]),
}


def _affixed(text):
    return lambda spark, sf: expand(fixture(spark, [(t,) for t in AFFIX_VOCABULARY], "term string"), parse(text)[0][0])


for _name, (_text, _terms) in GRAMMAR.items():
    query(_name, values([(t,) for t in _terms], "term"))(_affixed(_text))

#: Every variant of some words, worked out by hand from the rule (see hebrew.spelling_variants): the vowel letter left
#: out; vowel letters in the gaps of what is left, no two neighbours; one put after each consonant. The word is never one.
KETIV = {
    "שישים": "ששים שושים שוישים",
    "תורה": "תרה תירה תיורה",
    "שולחן": "שלחן שילחן שלוחן שליחן שלחון שולחון שילחון שלחין שולחין שילחין שיולחן שולוחן שוליחן",
    "גבורים": "גברים גוברים גיברים גבירים גובורים גיבורים גביורים",
    "א": "",
}


@query("ketiv_fixture", values([(t, v) for t, vs in KETIV.items() for v in vs.split()], "term, variant"))
def _(spark, sf):
    return fixture(spark, [(t, v) for t in KETIV for v in hebrew.spelling_variants(t)], "term string, variant string")


SPELLINGS = [(1, "ספר תורה"), (2, "ספר תרה"), (3, "תירה"), (4, "תורהה"), (5, "תורה ספרים"), (6, None)]


@query("search_variants_fixture", values([(1,), (2,)], "doc_id"))
def _(spark, sf):
    """A literal with its spellings, and another word."""
    docs = fixture(spark, [(i, t, "s") for i, t in SPELLINGS], "doc_id long, text string, source string")
    rows = docs.select(F.explode(tx.distinct_terms(F.col("text"))).alias("term"), "doc_id")
    return Engine(Corpus.of_documents(docs), rows, rows.select("term").distinct()).search_ids("ספר תורה", variants=True)


PARSED = [
    (1, 0, 0, "literal", "the", 0, False, False),
    (1, 1, 0, "literal", "of", 0, False, False),
    (1, 1, 1, "fuzzy", "and", 2, False, False),
    (2, 0, 0, "wildcard", "the*", 0, False, False),
    (2, 1, 0, "grammar", "תורה", 0, True, True),
]


@query("parse_query_batch", values(PARSED, "query_id, slot, alternative, kind, pattern, edits, prefixes, suffixes"))
def _(spark, sf):
    return parse_batch(fixture(spark, [(1, "the of | And~2 |"), (2, "The*% 12 %תּוֹרָה%"), (3, " | ")], "query_id int, query string"))


# --- results


@query(
    "search_result_rows",
    f"WITH {POST}, {CORPUS} SELECT id, title, content, 'with,from' AS groups, 1 AS original_group_count FROM line JOIN book USING (book_id) WHERE id IN ({in_slots(chr(40) + 'term IN (' + chr(39) + 'with' + chr(39) + ', ' + chr(39) + 'from' + chr(39) + '))')})",
)
def _(spark, sf):
    rows = engine(spark, sf).search("with | from")
    return rows.select("id", "title", "content", F.array_join(F.flatten("matched_groups"), ",").alias("groups"), "original_group_count")


@query("search_capped", f"WITH {POST}, {CORPUS} SELECT id, title FROM line JOIN book USING (book_id) WHERE id IN ({in_slots(STAR.format('the', 3), STAR.format('of', 2))}) ORDER BY id LIMIT 25")
def _(spark, sf):
    return engine(spark, sf).search("the of", cap=25).select("id", "title")


# --- proximity


def window_sql(*slots: str) -> str:
    """SQL: the tightest window over slots of terms, and the greedy order test by the slots' first places in turn."""
    n = len(slots)
    case = " ".join(f"WHEN {s} THEN {i}" for i, s in enumerate(slots))
    last = ", ".join(
        f"last_value(CASE WHEN g = {i} THEN raw_start END IGNORE NULLS) OVER w AS s{i}, last_value(CASE WHEN g = {i} THEN pos END IGNORE NULLS) OVER w AS p{i}"
        for i in range(n)
    )
    all_of = " AND ".join(f"s{i} IS NOT NULL" for i in range(n))
    steps = ["o0 AS (SELECT doc_id, min(pos) AS p FROM marked WHERE g = 0 GROUP BY doc_id)"]
    steps += [
        f"o{i} AS (SELECT doc_id, min(pos) AS p FROM marked JOIN o{i - 1} USING (doc_id) WHERE g = {i} AND pos > p GROUP BY doc_id)"
        for i in range(1, n)
    ]
    starts, places = ", ".join(f"s{i}" for i in range(n)), ", ".join(f"p{i}" for i in range(n))
    return f"""WITH {TOKENS},
marked AS (SELECT *, CASE {case} END AS g FROM tok WHERE CASE {case} END IS NOT NULL),
seen AS (SELECT doc_id, pos, raw_end, {last} FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
spans AS (SELECT doc_id, pos AS right_pos, least({places}) AS left_pos, raw_end - least({starts}) AS span FROM seen WHERE {all_of}),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span, right_pos) AS k FROM spans),
{", ".join(steps)},
found AS (SELECT doc_id AS id, left_pos, right_pos, span, greatest(right_pos - left_pos - {n - 1}, 0) AS word_distance,
                 doc_id IN (SELECT doc_id FROM o{n - 1}) AS ordered
          FROM best WHERE k = 1)"""


_W3 = window_sql("term = 'the'", "term IN ('of', 'and')", "term = 'is'")


@query("tightest_window", f"{_W3} SELECT id, left_pos, right_pos, span, word_distance, ordered FROM found")
def _(spark, sf):
    return engine(spark, sf).proximity("the of | and is")


@query("word_distance_filter", f"{_W3} SELECT id, word_distance FROM found WHERE word_distance <= 10")
def _(spark, sf):
    return proximity.near(engine(spark, sf).proximity("the of | and is")).select("id", "word_distance")


@query("ordered_match", f"{window_sql(STAR.format('the', 3), STAR.format('with', 4))} SELECT id, span FROM found WHERE ordered AND word_distance <= 5")
def _(spark, sf):
    return proximity.near(engine(spark, sf).proximity("the with"), 5, ordered=True).select("id", "span")


@query("proximity_or_group", f"{window_sql('term IN (' + repr('of') + ', ' + repr('from') + ')', STAR.format('the%', 7))} SELECT id, span, word_distance FROM found")
def _(spark, sf):
    return engine(spark, sf).proximity("of | from the*").select("id", "span", "word_distance")


@query("paged_search", f"{_W3} SELECT id, span AS score, word_distance FROM found WHERE word_distance <= 10 ORDER BY id LIMIT 50 OFFSET 20")
def _(spark, sf):
    return engine(spark, sf).interactive("the of | and is", skip=20, batch=50).select("id", "score", "word_distance")


_BARE = r"regexp_replace({}, '<[^>]*(>|$)|\{{[א-ת]\}}', '', 'g')"
_SHOWN = f"""{_W3},
tops AS (SELECT doc_id, max(pos) AS top FROM tok GROUP BY doc_id),
cut AS (SELECT id, span, word_distance, greatest(left_pos - 8, 0) AS a, least(right_pos + 8, top) AS b, top
        FROM found JOIN tops ON doc_id = id WHERE word_distance <= 10),
ends AS (SELECT id, span, word_distance, text, CASE WHEN a = 0 THEN 0 ELSE ta.raw_start END AS low,
                CASE WHEN b = top THEN length(text)::INT ELSE tb.raw_end END AS high
         FROM cut JOIN tok ta ON ta.doc_id = id AND ta.pos = a JOIN tok tb ON tb.doc_id = id AND tb.pos = b
         JOIN documents d ON d.doc_id = id),
hit AS (SELECT id, pos, raw_start, raw_end, text, lag(raw_end, 1, low) OVER (PARTITION BY id ORDER BY pos) AS before
        FROM ends JOIN marked ON doc_id = id WHERE raw_end > low AND raw_start < high),
body AS (SELECT id, max(raw_end) AS last, string_agg({_BARE.format("substr(text, before + 1, raw_start - before)")}
                || '<mark>' || substr(text, raw_start + 1, raw_end - raw_start) || '</mark>', '' ORDER BY pos) AS shown
         FROM hit GROUP BY id)
SELECT id, CASE WHEN low > 0 THEN '…' ELSE '' END || shown || {_BARE.format("substr(text, last + 1, high - last)")}
           || CASE WHEN high < length(text) THEN '…' ELSE '' END AS html, span AS score, word_distance
FROM ends JOIN body USING (id)"""


@query("snippet_near", _SHOWN)
def _(spark, sf):
    """Snippets of rows with at most ten words between."""
    rows = engine(spark, sf).snippets("the of | and is").where("is_match AND word_distance <= 10")
    return rows.select("id", "html", "score", "word_distance")


@query("snippet_highlight")
def _(spark, sf):
    return engine(spark, sf).snippets("the of | and is").select("id", "html", "score", "word_distance", "is_match")


@query("snippet_fallback")
def _(spark, sf):
    return engine(spark, sf).line_snippets(None, "the | of").select("id", "html", "score", "word_distance", "is_match")


SNIPPETS = [
    ("שישים גבורים סביב לה", "<mark>שישים</mark> <mark>גבורים</mark> סביב לה", 0, True),
    ("<b>שישים</b> x גבורים", "<mark>שישים</mark> x <mark>גבורים</mark>", 0, True),
    ("{א} שישים ושוב גבורים", " <mark>שישים</mark> ושוב <mark>גבורים</mark>", 1, True),
    ("שישים לבד", "שישים לבד", 2147483647, False),
]


@query("snippet_fixture", values(SNIPPETS, "content, html, word_distance, is_match"))
def _(spark, sf):
    rows = fixture(spark, [(s[0],) for s in SNIPPETS], "content string")
    p = Plan([["שישים"], ["גבורים"]], 2)
    return snippets.with_snippets(rows, p).select("content", "html", "word_distance", "is_match")


# --- lexicon


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary as (key, value, rkey), value being the document frequency."""
    return index(spark, sf).vocabulary().select(F.col("term").alias("key"), F.col("df").alias("value"), F.reverse("term").alias("rkey"))


def looked_up(name: str, where: str, f: Callable[[DataFrame], DataFrame], more: str = "") -> None:
    sql = f"WITH {POST} SELECT term AS key, df AS value{more} FROM vocab WHERE {where}"
    query(name, sql)(lambda spark, sf: f(dictionary(spark, sf)))


looked_up("lex_exact", "term = 'the'", lambda d: lexicon.exact(d, "the"))
looked_up("lex_starts_with", "starts_with(term, 'thr')", lambda d: lexicon.starts_with(d, "thr"))
looked_up("lex_ends_with", "ends_with(term, 'ing')", lambda d: lexicon.ends_with(d, "ing"))
looked_up("lex_contains", "contains(term, 'nth')", lambda d: lexicon.contains(d, "nth"))
looked_up("lex_fuzzy", "levenshtein(term, 'there') <= 2", lambda d: lexicon.fuzzy(d, "there", 2), ", levenshtein(term, 'there')::INT AS distance")
looked_up("lex_enumerate", "true", lexicon.enumerate_all)
looked_up("lex_reverse", "true", lambda d: lexicon.build(d.select("key", "value")), ", reverse(term) AS rkey")

WORDS = [("card", 0), ("care", 1), ("cat", 2), ("dare", 3), ("dot", 4), ("dote", 5)]


@query("lex_trie_edges", "WITH k(key) AS (VALUES ('card'), ('care'), ('cat'), ('dare'), ('dot'), ('dote')) SELECT left(key, n - 1) AS node, key[n] AS label, left(key, n) AS next, bool_or(n = length(key)) AS final FROM k, unnest(range(1, length(key) + 1)) AS t(n) GROUP BY ALL")
def _(spark, sf):
    return lexicon.trie_edges(fixture(spark, WORDS, "key string, value int"))


AFFIXED = [("בית", 1), ("הבית", 2), ("ובבית", 3), ("ביתי", 4), ("בביתנו", 5), ("קבית", 6), ("ביתק", 7)]


@query("lex_hebrew_affix_fixture", values([("before", "בית"), ("before", "הבית"), ("before", "ובבית"), ("after", "בית"), ("after", "ביתי"), ("both", "בית"), ("both", "הבית"), ("both", "ובבית"), ("both", "ביתי"), ("both", "בביתנו")], "side, key"))
def _(spark, sf):
    rows = fixture(spark, AFFIXED, "key string, value int")
    side = lambda name, b, a: lexicon.affixed(rows, "בית", b, a).select(F.lit(name).alias("side"), "key")
    return side("before", True, False).unionByName(side("after", False, True)).unionByName(side("both", True, True))




MORPHOLOGY = [("והספרים", "ספר", "וה", "ים"), ("ספר", "ספר", "", ""), ("דבריכם", "דבר", "", "יכם")]


@query("morphology_strip_fixture", values(MORPHOLOGY, "word, root, prefix, suffix"))
def _(spark, sf):
    return lexicon.morphology(fixture(spark, [(m[0],) for m in MORPHOLOGY], "word string"))


@query("morphology_vocabulary", f"WITH {POST} SELECT term AS word, term AS root, '' AS prefix, '' AS suffix FROM vocab")
def _(spark, sf):
    """Latin words have no Hebrew affixes."""
    return lexicon.morphology(index(spark, sf).vocabulary().select(F.col("term").alias("word")))


# --- life of an index


def batches(spark: SparkSession, sf: str, name: str, n: int = 5) -> Index:
    """A new index of documents, built in n additions."""
    rows, now = lines(spark, sf), Index(spark, scratch(spark, name))
    for k in range(n):
        now = now.add(rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k), k)  # null and negative ids too
    return now


_GONE = f"WITH {POST} SELECT term, count(*) AS df FROM post WHERE doc_id % 7 <> 0 GROUP BY term"


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def _counts_of_ids(rows: DataFrame) -> DataFrame:
    """Counts without null ids, which `doc_id % 7 <> 0` in SQL leaves out."""
    return _counts(rows.where("doc_id IS NOT NULL"))


def _deleted(spark: SparkSession, sf: str, name: str) -> Index:
    return batches(spark, sf, name, 2).delete(lines(spark, sf).select("id").where("id % 7 = 0"))[0]


@query("delete_then_search", _GONE)
def _(spark, sf):
    return _counts_of_ids(_deleted(spark, sf, "delete").postings())


@query("purge_then_search", _GONE)
def _(spark, sf):
    return _counts_of_ids(_deleted(spark, sf, "purge").purge().postings())


@query("compaction_equivalence", _GONE)
def _(spark, sf):
    now = batches(spark, sf, "merge", 4).delete(lines(spark, sf).select("id").where("id % 7 = 0"))[0]
    return _counts_of_ids(now.merge().postings())


@query("incremental_equals_batch", f"WITH {POST} SELECT term, df FROM vocab")
def _(spark, sf):
    return _counts(batches(spark, sf, "incremental", 3).merge(3).postings())


def _streamed(spark: SparkSession, sf: str, merge: bool) -> DataFrame:
    from loam.streaming.indexer import index_stream, read_lines

    root, inbox, cores = scratch(spark, "stream"), scratch(spark, "inbox"), spark.sparkContext.defaultParallelism
    spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(4 * cores).write.parquet(inbox)
    lines_of = lambda: read_lines(spark, inbox, "doc_id", "text", cores)  # noqa: E731  four batches, each with a file for each core
    index_stream(lines_of(), root, scratch(spark, "progress"), merge).awaitTermination()
    index_stream(lines_of(), root, scratch(spark, "progress-lost"), merge).awaitTermination()  # replayed: adds nothing
    return Index.open(spark, root).vocabulary()


@query("streaming_index", f"WITH {POST} SELECT term, df FROM vocab")
def _(spark, sf):
    return _streamed(spark, sf, False)


@query("streaming_index_merged", f"WITH {POST} SELECT term, df FROM vocab")
def _(spark, sf):
    return _streamed(spark, sf, True)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).search("the of | and").select("id", "title", "content", "original_group_count")
