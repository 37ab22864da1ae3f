"""How a small table in few files comes to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of files that a piece is worth, and bytes for each core beyond which a table is left as it lies.
LEAST, MOST = 500_000, 32_000_000


def dealt(df: DataFrame) -> DataFrame:
    """df, its rows dealt over the cores if df reads files that are small for so many cores and have rows in fewer splits
    than that (a file of one row group is one task's work, however many cores wait). A table of more than MOST bytes for
    each core is left alone, so this never shuffles much; filters and columns chosen later still reach the scan."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = min(cores, size // LEAST)
    if wanted <= 1 or size > cores * MOST:
        return df
    splits = df.select("_metadata.file_path", "_metadata.file_block_start").distinct().limit(wanted).count()
    return df.repartition(cores) if splits < wanted else df
