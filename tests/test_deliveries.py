from __future__ import annotations

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from tidemark.operators import deliveries as dl

SCHEMA = "delivery_id bigint, batch_id string, delivered_at timestamp_ntz, namespace string, source string, source_event_id string, content string, content_hash string, hot string, keep int, rn int, salt int, ident string"


def row(i, t, ns="n", src="s", event=None, content="c", h=None):
    return (i, f"b{(i or 0) % 3}", None if t is None else dt.datetime(2025, 1, 1) + dt.timedelta(minutes=t), ns, src, event, content, h, "x", 1, 1, 1, "z")


def test_identifiers(spark):
    sha = hashlib.sha256(b"c").hexdigest()
    rows = [
        row(1, 5, event=" A "), row(2, 4, event="A"), row(3, 4, event="A \t"), row(4, 1, event="a"),  # 2 stays of 1-3
        row(5, 9, event="  ", h="SHA256:" + sha.upper()), row(6, 8, event=None), row(7, 7, event="\n", h=sha),  # 7 stays of 5-7
        row(8, 1, event=sha),  # an event id is no hash
        row(9, 1, src="t", event="A"), row(10, 1, ns=None, event="A"), row(11, 2, ns=None, event="A"),
        row(12, 1, content=None), row(13, 1, content=None), row(14, None, event="q"), row(15, 3, event="q"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r[0] for r in dl.found(df).collect()) == [1, 3, 5, 6, 11, 14]
    assert dl.found(df.limit(0)).count() == 0
    kept = dl.kept_per_batch(df).agg(F.sum("deliveries"), F.sum("kept")).first()
    assert tuple(kept) == (15, 9)


def test_a_hot_identifier_is_reduced_before_the_shuffle(spark):
    rnd = random.Random(2)
    rows = [row(i, rnd.randrange(50), event="hot" if i % 3 else f"e{rnd.randrange(40)}") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    first: dict[str, tuple] = {}
    for r in rows:
        first[r[5]] = min(first.get(r[5], (r[2], r[0])), (r[2], r[0]))
    want = sorted(r[0] for r in rows if first[r[5]][1] != r[0])
    assert sorted(r["delivery_id"] for r in dl.found(df).collect()) == want
    plan = dl.firsts(dl.messages(df))._jdf.queryExecution().executedPlan().toString()
    final, partial = plan.index("WindowGroupLimit"), plan.rindex("WindowGroupLimit")
    assert final < plan.index("Exchange") < partial  # rank 1 of each task is taken before the exchange


def test_rows_without_or_with_one_delivery_id(spark):
    rows = [row(1, 1, event="a"), row(1, 1, event="a"), row(2, 2, event="a"), row(None, 3, event="a"), row(None, 0, event="b"), row(3, 4, event="b")]
    assert [r[0] for r in dl.found(spark.createDataFrame(rows, SCHEMA)).collect()] == [2]


def test_new_messages(spark):
    stored = spark.createDataFrame([row(1, 1, event="a"), row(2, 1, ns=None, event="b")], SCHEMA)
    batch = spark.createDataFrame([row(11, 5, event="a"), row(12, 5, ns=None, event="b"), row(13, 6, event="c"), row(14, 5, event="c")], SCHEMA)
    assert [r["delivery_id"] for r in dl.new_messages(batch, stored).collect()] == [14]
