"""Messages delivered more than once.

Deliveries are partitioned by message identifier and ranked by arrival; the first stays.  Spark keeps rank 1 of every identifier in each
task before the shuffle, so an identifier with any share of the rows reaches its task as one row per task.  What must go is the
anti-join with the firsts by delivery, whose ids are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["namespace", "source", "ident"]


def trimmed(c: str) -> Column:
    """Without surrounding white space of any script; null where nothing is left."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def messages(deliveries: DataFrame) -> DataFrame:
    """``delivery_id, batch_id, delivered_at, namespace, source, ident`` of each delivery.

    ident is 'e:' and the trimmed event id, else 'h:' and the lower-case hash without its prefix, else 'h:' and the SHA-256 of the
    content; where all three are null it is 'd:' and the delivery's own id, so that it equals no other.  Null namespaces or
    sources are equal.
    """
    bare = F.regexp_replace(F.lower("content_hash"), "^sha256:", "")
    ident = F.coalesce(F.concat(F.lit("e:"), trimmed("source_event_id")), F.concat(F.lit("h:"), F.coalesce(bare, F.sha2(F.col("content").cast("binary"), 256))), F.concat(F.lit("d:"), F.col("delivery_id").cast("string")))
    return deliveries.select("delivery_id", "batch_id", "delivered_at", "namespace", "source", ident.alias("ident"))


def firsts(rows: DataFrame) -> DataFrame:
    """The first delivery of each message: earliest delivered_at, nulls last, then least id."""
    order = Window.partitionBy(*KEY).orderBy(F.asc_nulls_last("delivered_at"), F.asc("delivery_id"))
    return rows.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def found(deliveries: DataFrame) -> DataFrame:
    """``delivery_id`` of the deliveries that must go.  Rows without delivery_id name none; one id on several rows is one delivery."""
    rows = messages(deliveries).filter("delivery_id is not null")
    return rows.select("delivery_id").join(firsts(rows).select("delivery_id"), "delivery_id", "left_anti").distinct()


def kept_per_batch(deliveries: DataFrame) -> DataFrame:
    """Per batch, deliveries and messages that stay; a null batch is one."""
    all_ = deliveries.groupBy("batch_id").agg(F.count(F.lit(1)).alias("deliveries"))
    kept = firsts(messages(deliveries)).groupBy(F.col("batch_id").alias("b")).agg(F.count(F.lit(1)).alias("kept"))
    return all_.join(kept, F.col("batch_id").eqNullSafe(F.col("b")), "left").select("batch_id", "deliveries", F.coalesce("kept", F.lit(0)).alias("kept"))


def new_messages(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Firsts of ``batch`` whose message is not in ``stored``: null-safe anti-join by identifier.

    Only firsts enter the join, so no identifier occurs twice on either side and none can be hot.
    """
    new = firsts(messages(batch))
    old = messages(stored).select(*[F.col(k).alias(f"o_{k}") for k in KEY]).distinct()
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    return new.join(old, same, "left_anti")
