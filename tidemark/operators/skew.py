"""Hot keys are cut into slots along an ordering column, as many as their size asks for.

Keys are counted on the first rows of every split only, so the table is not read twice; that sample decides the physical layout and never a
result.  A key is hot from ``target`` rows on, whatever its share of the table, and gets a slot per ``target`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = 4096  # rows of each split that are looked at
TARGET = 1_000_000  # rows one task can well take of one key
MOST = 100_000  # slots of all hot keys together, which bounds the broadcast (about 1 MB)
WIDTH = 256


def heads(rows: DataFrame, n: int = HEAD) -> DataFrame:
    """The first ``n`` rows of every input partition; the rest of a split is not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = n
        for b in batches:
            yield b.slice(0, left)
            left -= b.num_rows
            if left <= 0:
                return

    return rows.mapInArrow(run, rows.schema)


def hot_cuts(rows: DataFrame, keys: list[str], at: str, total: int, target: int = TARGET) -> DataFrame | None:
    """``keys..., fine, coarse`` of the hot keys, or None where there are none: cuts at equal shares of ``at``, in chunks of WIDTH.

    ``rows`` should come straight from a scan; ``total`` is their number or a little more (a count of the table, read from its footers).
    """
    target = max(target, math.ceil(total / MOST))
    if total <= target:
        return None
    sample = heads(rows.select(*keys, at))
    seen = sample.count()
    if not seen:
        return None
    least = max(2, math.ceil(target * seen / total))  # at most total / target keys can reach it
    found = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).collect()
    if not found:
        return None
    need = {tuple(r[k] for k in keys): max(2, math.ceil(r["__n"] / seen * total / target)) for r in found}
    grid = max(need.values())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    spark = rows.sparkSession
    hot = spark.createDataFrame(list(need), schema)
    cut = sample.join(F.broadcast(hot), keys).groupBy(*keys).agg(F.percentile_approx(at, [i / grid for i in range(1, grid)], 10 * grid).alias("cuts")).collect()
    out = []
    for r in cut:
        key = tuple(r[k] for k in keys)
        every = max(1, grid // need[key])
        cuts = sorted(set(r["cuts"][every - 1 :: every]))
        fine = [cuts[i : i + WIDTH] for i in range(0, len(cuts), WIDTH)]
        out.append((*key, fine, [c[0] for c in fine[1:]]))
    return spark.createDataFrame(out, schema + ", fine array<array<bigint>>, coarse array<bigint>")


def slotted(rows: DataFrame, keys: list[str], at: str, cuts: DataFrame | None) -> DataFrame:
    """``rows`` with ``slot``: 0 for all keys but hot ones, whose rows count their slots from 1 along ``at``.  Null keys have slot 0."""
    if cuts is None:
        return rows.withColumn("slot", F.lit(0))
    rows = rows.join(F.broadcast(cuts), keys, "left")  # at most MOST cuts
    below = lambda a: F.size(F.filter(a, lambda c: c <= F.col(at)))
    chunk = below(F.col("coarse"))
    slot = F.lit(1) + chunk * WIDTH + below(F.get(F.col("fine"), chunk))
    return rows.withColumn("slot", F.when(F.col("fine").isNull(), 0).otherwise(slot).cast("int")).drop("fine", "coarse")
