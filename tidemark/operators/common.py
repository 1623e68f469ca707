"""Small relations used everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.filter(F.col("deleted_at").isNull())


def once(df: DataFrame, key: str = "id", *order: Column) -> DataFrame:
    """One row per key, the first by ``order`` (any, where rows are written twice unchanged).  Keys compare without letter case.

    Without order this is an aggregation with map-side combining; with one, a ranked window of which Spark keeps only rank 1
    before the shuffle.  Rows with a null key are one group.
    """
    if not order:
        return df.withColumn("__k", F.lower(key)).dropDuplicates(["__k"]).drop("__k")
    w = Window.partitionBy(F.lower(key)).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def episodes_once(episodes: DataFrame, *columns: str) -> DataFrame:
    """Live episodes, each id at its earliest ingestion, with the asked columns."""
    rows = live(episodes).select(*dict.fromkeys(["id", "ingested_at", *columns]))
    return once(rows, "id", F.asc_nulls_last("ingested_at"))


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def latest(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per group; only n rows per group and task are shuffled."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows spread over all cores where a small input comes in fewer splits than half of them; otherwise the input as it is, unshuffled.

    For work that is heavy per row.  At scale a table has far more splits than cores and nothing moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df
