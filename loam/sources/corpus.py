"""The corpus as two tables, line(id, book_id, line_index, he_ref, content) and book(book_id, title), and reads of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Ids up to which a fetch broadcasts them: some tens of MB.
BROADCAST_IDS = 1_000_000


class CorpusNotFound(FileNotFoundError):
    """There is no readable corpus at the path."""


#: Ids of a book that one task numbers.
CHUNK = 1_000_000


@dataclass
class Corpus:
    """placed: lines with line_index and he_ref, where finding these costs more than reading them. named: lines (id, title,
    content), where the title lies beside the content."""

    line: DataFrame
    book: DataFrame
    placed: DataFrame | None = None
    named: DataFrame | None = None

    @staticmethod
    def read(spark: SparkSession, line_path: str, book_path: str) -> Corpus:
        if not line_path or not book_path:
            raise ValueError("a corpus needs the paths of its lines and of its books")
        try:
            return Corpus(spark.read.parquet(line_path), spark.read.parquet(book_path))
        except Exception as e:  # the path is checked by Spark when its schema is read
            raise CorpusNotFound(f"{line_path}, {book_path}: {type(e).__name__}") from e

    @staticmethod
    def of_documents(docs: DataFrame) -> Corpus:
        """documents as a corpus: a source is a book, its documents are the lines in order of their ids."""
        titles = docs.select(F.col("source").alias("title")).distinct()
        books = titles.withColumn("book_id", F.dense_rank().over(Window.orderBy("title")).cast("long"))  # a row for each source
        of_book = lambda rows: rows.join(books, F.col("source").eqNullSafe(F.col("title")))
        text = F.col("text").alias("content")
        # A source of a third of all rows is numbered in chunks of its ids, from counts of the chunks before.
        chunked = docs.withColumn("chunk", F.floor(F.col("doc_id") / CHUNK))
        counts = chunked.groupBy("source", "chunk").agg(F.count("*").alias("n"))
        before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
        starts = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("doc_id"))
        met = F.col("source").eqNullSafe(F.col("s")) & F.col("chunk").eqNullSafe(F.col("c"))
        numbered = chunked.withColumn("inside", inside).join(starts, met).withColumn("place", (F.col("start") + F.col("inside") - 1).cast("int"))
        return Corpus(
            of_book(docs).select(F.col("doc_id").alias("id"), "book_id", text),
            books.select("book_id", "title"),
            of_book(numbered).select(
                F.col("doc_id").alias("id"), "book_id", F.col("place").alias("line_index"), F.concat("source", F.lit(":"), "place").alias("he_ref"), text
            ),
            docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), text),
        )

    def scan(self, limit: int | None = None, after: int | None = None) -> DataFrame:
        """(id, content) in order of id, after an id if one is given; a null content is the empty string."""
        rows = self.line if after is None else self.line.where(F.col("id") > after)
        rows = rows.select("id", F.coalesce("content", F.lit("")).alias("content")).orderBy("id")
        return rows if limit is None else rows.limit(limit)

    def count_lines(self, up_to: int | None = None) -> DataFrame:
        rows = self.line if up_to is None else self.line.where(F.col("id") <= up_to)
        return rows.agg(F.count("*").alias("n_lines"))

    def id_stats(self) -> DataFrame:
        return self.line.agg(F.count("*").alias("n_lines"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))

    def row_at(self, offset: int) -> DataFrame:
        """(id, title) of the line at an offset in id order."""
        return self._titled(self.line.select("id", "book_id").orderBy("id").offset(offset).limit(1)).select("id", "title")

    def _places(self) -> DataFrame:
        return self.line if self.placed is None else self.placed

    def _titled(self, rows: DataFrame, how: str = "left") -> DataFrame:
        """rows with their book's title, the empty string if it has none."""
        titles = self.book.select("book_id", "title")
        return rows.join(titles, "book_id", how).withColumn("title", F.coalesce("title", F.lit("")))

    def _shown(self, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(id, title, content) of the lines that are wanted, nulls as empty strings."""
        rows = wanted(self.named) if self.named is not None else self._titled(wanted(self.line))
        return rows.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))

    def fetch(self, ids: DataFrame | None = None) -> DataFrame:
        """(id, title, content) of the lines whose id is in ids (id), of every line that has an id if there are none; ids
        without a line are dropped. Ids that are counted to be few go to where the contents lie; beyond that contents are
        shuffled by id."""
        if ids is None:
            return self._shown(lambda rows: rows.where("id IS NOT NULL"))
        asked = ids.select("id").distinct()
        asked = F.broadcast(asked) if asked.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else asked
        return self._shown(lambda rows: rows.join(asked, "id", "left_semi"))

    def fetch_listed(self, ids: list[int]) -> DataFrame:
        """fetch of a few ids that are known: the filter reaches the scan."""
        return self._shown(lambda rows: rows.where(F.col("id").isin(ids) if ids else F.lit(False)))

    def fetch_titles(self, ids: DataFrame) -> DataFrame:
        """(id, title) by book and line; lines without a book are dropped, contents are not read."""
        place = "line_index" if self.placed is None else "id"  # documents are numbered by their ids
        rows = self.line.select(F.col("id"), "book_id", F.col(place).alias("place")).join(ids.select("id"), "id", "left_semi")
        return self._titled(rows, "inner").orderBy("book_id", "place").select("id", "title")

    def line_info(self, line_id: int) -> DataFrame:
        rows = self._places().where(F.col("id") == line_id).select("id", "book_id", "line_index", "he_ref")
        return self._titled(rows).select("id", "title", "line_index", "he_ref")

    def find_phrase(self, phrase: str, limit: int) -> DataFrame:
        """(id, content) of the first lines that contain the phrase, whatever the case of ASCII letters."""
        return self.line.where(holds(F.col("content"), phrase)).select("id", "content").orderBy("id").limit(limit)

    def find_book_phrase(self, title: str, phrase: str) -> DataFrame:
        rows = self._places().where(holds(F.col("content"), phrase)).select("id", "book_id", "line_index", "he_ref")
        books = self.book.where(holds(F.col("title"), title))
        return rows.join(books, "book_id").select("id", "title", "line_index", "he_ref")

    def find_books(self, title: str, limit: int = 50) -> DataFrame:
        return self.book.where(holds(F.col("title"), title)).orderBy("book_id").limit(limit).select("book_id", "title")


def holds(text: Column, part: str) -> Column:
    return F.lower(text).contains(part.lower())
