from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import late_events
from tidemark.sources.tables import table
from tidemark.streaming import episodes as st
from tests.conftest import SF


def drain(df, mode: str, tmp_path):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table("out")


def test_revisions_agree_with_the_batch(spark, tmp_path):
    rows = table(spark, SF, "loom_episodes").filter("deleted_at is null and occurred_at is not null").select("id", "namespace", "source", "occurred_at", "ingested_at", "deleted_at")
    first = rows.groupBy("id").agg(F.min_by(F.struct("namespace", "source", "occurred_at", "ingested_at", "deleted_at"), "ingested_at").alias("r")).select("id", "r.*")
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
    got = {tuple(r)[:3] for r in drain(st.revisions(stream), "complete", tmp_path).collect()}
    assert got == {tuple(r) for r in late_events.found(first).collect()} and got


def test_deduplicated_and_rates(spark, tmp_path):
    ev = table(spark, SF, "events").limit(300)
    ev.unionByName(ev).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    assert drain(st.deduplicated(stream, ["event_id"], "ts"), "append", tmp_path).count() == 300
    total = drain(st.rates(stream), "complete", tmp_path / "r").agg(F.sum("events")).first()[0]
    assert total == 600
