"""What keeps a query's figures from growing faster than its input."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loam import registry
from loam.functions import text as tx
from loam.operators import matching
from loam.sources import segments
from loam.sources.segments import Index, Store
from loam.sources.storage import scratch
from tests.oracle import same


@pytest.fixture
def folder(spark, tmp_path):
    random.seed(4)
    words = [f"{a}{b}{c}" for a in "abcdef" for b in "aeiou" for c in "lmnr"] + ["the", "of"]
    rows = [(i, " ".join(random.choices(words, k=40)), f"src{i % 3}") for i in range(600)]
    rows += [(None, "the sea of", "src1"), (-3, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["streaming_index", "streaming_index_merged"])
def test_a_streams_batch_has_a_file_for_each_core(spark, folder, tmp_path, monkeypatch, name):
    monkeypatch.setattr(registry, "scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    same(spark, folder, registry.queries()[name], registry.oracle_sql()[name])
    assert len(list(Path(f"{tmp_path}/inbox").glob("*.parquet"))) == 4 * spark.sparkContext.defaultParallelism
    now = Index.open(spark, f"file://{tmp_path}/stream")
    assert now.batches == ((0, 3),)
    assert [s.level for s in now.segments] == ([1] if name.endswith("merged") else [0] * 4)


def test_difference_as_sql_has_it(spark):
    left, right = (spark.createDataFrame([(i,) for i in s], "doc_id long") for s in ([None, 1, 2, 2, 5], [None, 2, 3, 3]))
    got = matching.difference(left, right).collect()
    assert sorted((r.doc_id, r.side) for r in got) == [(1, "left"), (3, "right"), (5, "left")]


def test_a_tasks_sort_is_bounded_whatever_the_settings(spark, folder, monkeypatch):
    monkeypatch.setattr(segments, "SORT_ROWS", 1_000)
    now = Index(spark, scratch(spark, "sorted")).add(registry.lines(spark, folder))
    n = now.postings().count()
    sizes = [r["count"] for r in now.postings().groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= n // 1_000 > 10 and max(sizes) < 3_000


def test_a_merge_writes_postings_once(spark, folder, monkeypatch):
    rows, now = registry.lines(spark, folder), Index(spark, scratch(spark, "merged"))
    for k in range(2):
        now = now.add(rows.where(F.pmod("id", F.lit(2)) == k))
    now = now.delete(spark.range(0, 600, 7))[0]
    want = sorted(tuple(r) for r in now.postings().collect())
    gone, delete = [], Store.delete
    monkeypatch.setattr(Store, "delete", lambda self, name: (gone.append(name), delete(self, name)))
    monkeypatch.setattr(segments, "SORT_ROWS", 1_000)
    for done in (now.purge(), Index(spark, now.store.root, now.version + 1, now.segments).merge(2)):
        assert sorted(tuple(r) for r in done.postings().collect()) == want
    assert len(done.segments) == 1 and len(done.postings().inputFiles()) > 10
    assert not [n for n in gone if n.startswith("_")]  # nothing was staged


def test_a_batch_is_staged_as_a_row_for_each_line(spark, folder, monkeypatch):
    rows, now, staged, delete = registry.lines(spark, folder), Index(spark, scratch(spark, "staged")), [], Store.delete

    def seen(self, name):
        if name.startswith("_"):
            staged.append(spark.read.parquet(f"{self.root}/{name}").count())
        delete(self, name)

    monkeypatch.setattr(Store, "delete", seen)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    odd = [(7001, None), (7002, ""), (7003, "a . <b>"), (None, "x&amp;y zz"), (-7, 'שלו"ם zz ZZ zz')]
    rows = rows.union(spark.createDataFrame(odd, "id long, content string"))
    assert key(now.add(rows).postings()) == key(segments.postings_of(rows))
    assert staged == [rows.count()]


def _with_deletions(spark, folder):
    now = Index(spark, scratch(spark, "gone")).add(registry.lines(spark, folder))
    want = [tuple(r) for r in now.postings().where("doc_id IS NULL OR doc_id % 7 <> 0 OR doc_id < 0").collect()]
    return now.delete(spark.range(0, 600, 7))[0], sorted(want, key=str)


def test_few_deletions_need_no_sort_whatever_the_settings(spark, folder):
    now, want = _with_deletions(spark, folder)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in now.postings()._jdf.queryExecution().executedPlan().toString()
        assert sorted((tuple(r) for r in now.postings().collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_deletions_sort_a_bounded_number_of_rows_in_a_task(spark, folder, monkeypatch):
    now, want = _with_deletions(spark, folder)
    monkeypatch.setattr(segments, "BROADCAST_IDS", 10, raising=False)
    monkeypatch.setattr(segments, "SORT_ROWS", 1_000)
    sizes = [r["count"] for r in now.postings().groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 3_000
    assert sorted((tuple(r) for r in now.postings().collect()), key=str) == want


def test_every_line_is_fetched_without_a_join(spark, folder):
    df = registry.queries()["snippet_fallback"](spark, folder)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.where("id IS NULL").count() == 0 and df.count() == 601


def test_letters_whose_lower_case_is_ascii(spark):
    rows = spark.createDataFrame([("xxİyy Kelvin ABKCD ÀÉcd",)], "t string")
    assert rows.select(tx.tokens(F.col("t")).alias("t")).first().t == ["xx", "yy", "elvin", "ab", "cd", "cd"]
