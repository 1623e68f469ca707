from __future__ import annotations

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import percentiles as pc

SCHEMA = "id string, created_at timestamp_ntz, namespace string, primary_class string, latency_total_ms int, n int, q int, sizes string, day string"


def rows_of(values, ns="n", cls="c", start=0):
    return [(f"i{start + i}", dt.datetime(2025, 1, 1 + i % 5), ns, cls, v, 1, 1, "x", "y") for i, v in enumerate(values)]


def test_small_groups_are_exact_and_rows_count_once(spark):
    rows = rows_of([5, 1, 4, 2, 3, None, -7, 0]) + rows_of([5, 1, 4]) + [("I0", *rows_of([5])[0][1:])]
    rows += [(None, None, None, None, 9, 1, 1, "x", "y")] * 2
    got = {(r["namespace"], r["q"]): (r["n"], r["value"], r["rank_error"]) for r in pc.latency_percentiles(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[("n", 0.5)] == (6, 2, 0.0) and got[("n", 0.99)] == (6, 5, 0.0) and got[(None, 0.5)] == (2, 9, 0.0)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pc.latency_percentiles(empty).count() == 0 and pc.daily_and_overall(empty).count() == 0 and pc.bound_check(empty).count() == 0


def test_bounds_hold_on_a_large_group(spark):
    big = spark.range(400_000).select(
        F.concat(F.lit("k"), "id").alias("id"), F.date_add(F.lit("2025-01-01"), (F.col("id") % 7).cast("int")).cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("ns"), F.col("id") % 50)).alias("namespace"), F.lit("c").alias("primary_class"),
        F.least(F.lit(2_000_000_000.0), F.exp(F.rand(3) * 14)).cast("int").alias("latency_total_ms"))
    assert pc.bound_check(big).filter("not within_bound").count() == 0
    assert pc.bound_check(big).filter("not tight and namespace <> 'hot'").count() == 0
    hot = [r for r in pc.latency_percentiles(big).collect() if r["namespace"] == "hot"]
    err = {r["q"]: r["rank_error"] for r in hot}
    assert 0 < err[0.5] < 0.2 and err[0.99] < err[0.5] and all(r["n"] == 133_334 for r in hot)


def test_high_percentiles_are_close(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 10**6, 200_000)
    s = pc.Sketches(1, np.zeros(len(v)), np.zeros(len(v)), v, np.array([len(v)]))
    s.compact()
    assert len(s.value) < 12_000 and s.n[0] == len(v) and int((1 << s.level).sum()) == len(v)
    w = np.cumsum((1 << s.level)[np.argsort(s.value)])
    vals, true = np.sort(s.value), np.sort(v)
    for q, tol in ((0.5, 0.02), (0.9, 0.006), (0.99, 0.001), (0.999, 0.0002)):
        got = vals[np.searchsorted(w, math.ceil(q * len(v)))]
        assert abs(np.searchsorted(true, got) / len(v) - q) < tol


def test_merging_keeps_weight_and_is_stable(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(3000)], "g int, v int").repartition(7)
    one = pc.merge(pc.sketch(df, ["g"], "v"), ["g"])
    two = pc.merge(one.unionByName(pc.merge(pc.sketch(df, ["g"], "v"), ["g"])), ["g"])
    assert sorted(r["n"] for r in two.collect()) == [2000] * 3
    a, b = (sorted(map(str, pc.quantiles(one, ["g"], [0.5, 0.9]).collect())) for _ in range(2))
    assert a == b


def test_many_groups_are_handed_on_and_lanes_merge_the_same(spark, monkeypatch):
    monkeypatch.setattr(pc, "CHUNK", 500)
    monkeypatch.setattr(pc, "HELD", 800)
    monkeypatch.setattr(pc, "BIG", 100)
    df = spark.createDataFrame([(i % 7 if i % 3 else 100 + i, i) for i in range(6000)], "g int, v int").repartition(5)
    for lanes in (1, 3):
        got = pc.quantiles(pc.merge(pc.sketch(df, ["g"], "v"), ["g"], lanes), ["g"], [0.5, 0.99]).collect()
        assert sum(r["n"] for r in got) == 12_000 and len(got) == 2 * (7 + 2000)
        for r in got:
            assert r["tail_error"] >= r["rank_error"] and (r["n"] > 1 or (r["value"] == r["g"] - 100 and r["rank_error"] == 0))
