"""A small table in few files is dealt over the cores, whole; any other is read as it lies."""

import pytest

from loam.sources import pieces


@pytest.fixture
def path(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "if(id % 3 = 0, NULL, concat('word ', id)) AS text", "id AS _metadata_")
    rows.unionByName(rows.limit(5)).coalesce(1).write.parquet(f"file://{tmp_path}/one")
    return f"file://{tmp_path}/one"


def test_dealt_keeps_every_row(spark, path, monkeypatch):
    monkeypatch.setattr(pieces, "LEAST", 1000)
    rows = spark.read.parquet(path)
    out = pieces.dealt(rows)
    assert out is not rows and out.schema == rows.schema
    assert out.exceptAll(rows).isEmpty() and rows.exceptAll(out).isEmpty()
    assert out.groupBy("id").count().count() == 2000
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,7)]" in plan(out.where("id = 7").select("id"))
    assert "ReadSchema: struct<id:bigint>" in plan(out.where("id = 7").select("id"))


def test_left_as_it_lies(spark, path, monkeypatch, tmp_path):
    rows = spark.read.parquet(path)
    assert pieces.dealt(rows) is rows  # not worth it
    monkeypatch.setattr(pieces, "LEAST", 1000)
    monkeypatch.setattr(pieces, "MOST", 1000)
    assert pieces.dealt(rows) is rows  # too large to be shuffled
    monkeypatch.setattr(pieces, "MOST", 32_000_000)
    rows.repartition(8).write.parquet(f"file://{tmp_path}/many")
    many = spark.read.parquet(f"file://{tmp_path}/many")
    assert pieces.dealt(many) is many  # splits enough
    rows.limit(0).write.parquet(f"file://{tmp_path}/none")
    assert pieces.dealt(spark.read.parquet(f"file://{tmp_path}/none")).count() == 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
