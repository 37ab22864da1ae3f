"""Cancelling searches: everything that runs under a tag can be stopped from another thread."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that this thread starts inside, expansion and fetch alike, carry the tag."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stops the jobs that run under the tag, in whatever thread; the calls that wait for them fail with an error."""
    spark.sparkContext.cancelJobsWithTag(tag)
