"""Search over a corpus and its index: parse, expand on the vocabulary, match postings, fetch rows, filter, highlight."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.text import tokens_sql
from loam.operators import matching
from loam.operators import proximity as near
from loam.operators import snippets as marked
from loam.plans.expand import MOST_TERMS, Plan, TooManyTerms, marked as marked_terms, plan
from loam.plans.query import literal_terms, parse
from loam.sources.corpus import Corpus


#: By how much a page's search widens.
GROWTH = 4


@dataclass
class Engine:
    """A corpus with its postings (term, doc_id) and vocabulary (term, ...): both lazily planned, any size."""

    corpus: Corpus
    postings: DataFrame
    vocabulary: DataFrame

    def plan(self, query: str, variants: bool = False) -> Plan:
        return plan(parse(query), self.vocabulary, variants)

    def search_ids(self, query: str | Plan, variants: bool = False) -> DataFrame:
        """(doc_id) of matching documents; no content is read. A query that stands for more than MOST_TERMS terms is joined
        with the vocabulary instead of being listed."""
        try:
            p = query if isinstance(query, Plan) else plan(parse(query), self.vocabulary, variants, MOST_TERMS)
        except TooManyTerms:
            return self.search_ids_unlisted(query, variants)
        return matching.none(self.postings) if p.hopeless else matching.match(self.postings, p.slots)

    def search_ids_unlisted(self, query: str, variants: bool = False) -> DataFrame:
        """What search_ids gives, without a list of terms on the driver."""
        found = marked_terms(parse(query), self.vocabulary, variants)
        return matching.none(self.postings) if found is None else matching.match_marked(self.postings, *found)

    def _rows(self, p: Plan, cap: int) -> DataFrame:
        ids = self.search_ids(p).select(F.col("doc_id").alias("id"))
        if cap:  # ids without a line do not count
            ids = ids.join(self.corpus.line.select("id"), "id", "left_semi").orderBy("id").limit(cap)
        return self.corpus.fetch(ids)

    def search(self, query: str, cap: int = 0, variants: bool = False) -> DataFrame:
        """(id, title, content, matched_groups, original_group_count) in order of id, the first `cap` if it is not 0."""
        p = self.plan(query, variants)
        groups = F.array(*[F.array(*map(F.lit, s)) for s in p.slots]) if p.slots else F.array().cast("array<array<string>>")
        rows = self._rows(p, cap).withColumn("matched_groups", groups).withColumn("original_group_count", F.lit(p.slots_asked))
        return rows.orderBy("id")

    def proximity(self, query: str | Plan, variants: bool = False) -> DataFrame:
        """(id, left_pos, right_pos, span, word_distance, ordered) of matching rows whose text covers every slot."""
        p = query if isinstance(query, Plan) else self.plan(query, variants)
        return near.windows_of_rows(self._rows(p, 0), p)

    def snippets(
        self, query: str, cap: int = 0, ordered: bool = False, context: int = marked.CONTEXT, variants: bool = False, mark: tuple[str, str] = marked.MARK
    ) -> DataFrame:
        """Matching rows with html, score, word_distance and is_match; mark is put before and after a highlighted word."""
        p = self.plan(query, variants)
        return marked.with_snippets(self._rows(p, cap), p, "content", ordered, context, mark)

    def line_snippets(self, ids: DataFrame | None, query: str, context: int = marked.CONTEXT, mark: tuple[str, str] = marked.MARK) -> DataFrame:
        """Snippets of given lines (id), None for all, for a query's literal words: every alternative must occur, wildcards are letters."""
        terms = list(dict.fromkeys(literal_terms(query)))
        p = Plan([[t] for t in terms], len(terms), not terms)
        return marked.with_snippets(self.corpus.fetch(ids), p, "content", False, context, mark)

    def interactive(
        self, query: str, most: int = 10, ordered: bool = False, skip: int = 0, batch: int = 200, variants: bool = False, mark: tuple[str, str] = marked.MARK
    ) -> DataFrame:
        """A page of results: snippets that match within `most` words, in order of id, after `skip` of them.

        The matching documents of least id are looked at first, GROWTH times as many each time the page is not full yet;
        only the page's own rows are rendered. What reaches the driver is the page's ids."""
        p = self.plan(query, variants)
        matching_ids = self.search_ids(p).select(F.col("doc_id").alias("id")).where("id IS NOT NULL")
        looked, page = GROWTH * (skip + batch), []
        while True:
            some = matching_ids.orderBy("id").limit(looked)
            found = near.near(near.windows_of_rows(self.corpus.fetch(some), p), most, ordered)
            page = [r["id"] for r in found.select("id").orderBy("id").limit(skip + batch).collect()]
            if len(page) == skip + batch or matching_ids.limit(looked + 1).count() <= looked:
                break
            looked *= GROWTH
        return marked.with_snippets(self.corpus.fetch_listed(page[skip:]), p, "content", ordered, mark=mark).orderBy("id")


def parse_batch(queries: DataFrame) -> DataFrame:
    """(query_id, slot, alternative, kind, pattern, edits, prefixes, suffixes) of queries (query_id, query)."""
    names = ("slot", "alternative", "kind", "pattern", "edits", "prefixes", "suffixes")
    kinds = (T.IntegerType(), T.IntegerType(), T.StringType(), T.StringType(), T.IntegerType(), T.BooleanType(), T.BooleanType())
    row = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    @F.udf(T.ArrayType(row))
    def parsed(query: str):
        return [
            (i, j, p.kind, p.text, p.edits if p.fuzzy else 0, p.prefixes, p.suffixes)
            for i, slot in enumerate(parse(query))
            for j, p in enumerate(slot)
        ]

    return queries.select("query_id", F.inline(parsed("query")))


def register(spark: SparkSession, engine: Engine | None = None) -> None:
    """SQL: fts_tokens(html) and fts_terms(html), native; fts_normalise(word), native; and the table functions
    fts_parse(query) and fts_search(query), which give a query's slots and patterns. With an engine, also the views
    fts_postings and fts_vocabulary."""
    from pyspark.sql.functions import udtf

    define = "CREATE OR REPLACE TEMPORARY FUNCTION {}({} STRING) RETURNS {} RETURN {}"
    spark.sql(define.format("fts_tokens", "html", "ARRAY<STRING>", tokens_sql("html")))
    spark.sql(define.format("fts_terms", "html", "ARRAY<STRING>", f"array_distinct({tokens_sql('html')})"))
    bare = r"regexp_replace(coalesce(word, ''), r'[^a-zA-Zא-ת*?]', '')"
    spark.sql(define.format("fts_normalise", "word", "STRING", f"translate({bare}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))

    @udtf(returnType="slot int, alternative int, kind string, pattern string")
    class Parse:
        def eval(self, query: str):
            for i, slot in enumerate(parse(query)):
                for j, p in enumerate(slot):
                    yield i, j, p.kind, p.text

    for name in ("fts_parse", "fts_search"):
        spark.udtf.register(name, Parse)
    if engine is not None:
        engine.postings.createOrReplaceTempView("fts_postings")
        engine.vocabulary.createOrReplaceTempView("fts_vocabulary")
