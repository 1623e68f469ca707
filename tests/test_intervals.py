from __future__ import annotations

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv
from tidemark.operators.skew import hot_cuts, slotted

D = dt.datetime
SCHEMA = "subject_id string, predicate string, valid_from timestamp_ntz, valid_until timestamp_ntz, deleted_at timestamp_ntz, slot string, carry int, froms int, cuts string"


def brute(rows, least):
    by = {}
    for s, p, a, b in rows:
        by.setdefault((s, p), []).append((a, b))
    gaps, periods = [], []
    for k, xs in by.items():
        xs.sort()
        cur = list(xs[0])
        for a, b in xs[1:]:
            if a > cur[1]:
                periods.append((*k, *cur))
                if a - cur[1] >= least:
                    gaps.append((*k, cur[1], a))
                cur = [a, b]
            else:
                cur[1] = max(cur[1], b)
        periods.append((*k, *cur))
    return sorted(gaps), sorted(periods)


def test_against_brute_force_with_and_without_slots(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        rows = []
        for i in range(400):
            s = "hot" if i % 3 else f"s{rnd.randrange(12)}"
            a = rnd.randrange(0, 4000)
            b = a + rnd.choice([1, 2, 5, 30]) if rnd.random() > 0.003 else iv.OPEN
            rows.append((s, "p", a, b))
        df = spark.createDataFrame(rows, "subject_id string, predicate string, from_us bigint, until_us bigint").repartition(3)
        gaps, periods = brute(rows, 2)
        for cuts in (None, hot_cuts(df, iv.KEY, "from_us", len(rows), target=rnd.choice([7, 60, 150]))):
            lists = iv.interval_lists(df, cuts)
            assert sorted(map(tuple, iv.gaps_of(lists, cuts is not None, 2).collect())) == gaps
            assert sorted(map(tuple, iv.periods_of(lists, cuts is not None).collect())) == periods


def test_linear_merge_and_tree():
    rnd = random.Random(4)
    for n in (0, 1, 5, 40):
        tree, all_ = iv.Tree(), []
        for _ in range(n + 1):
            part = sorted((a := rnd.randrange(500), a + rnd.choice([1, 3, 40])) for _ in range(rnd.choice([0, 1, 30])))
            own = [(a, b) for _, _, a, b in brute([("s", "p", a, b) for a, b in part], 1)[1]] if part else []
            all_ += part
            tree.add(*(np.array([x[i] for x in own], np.int64) for i in (0, 1)))
        want = [(a, b) for _, _, a, b in brute([("s", "p", a, b) for a, b in all_], 1)[1]] if all_ else []
        assert list(zip(*map(list, tree.whole()))) == want


def test_one_key_over_many_batches(spark):
    """A key whose lists come in many batches, before and after others."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [("m" if i % 10 else f"{'az'[i // 10 % 2]}{i}", "p", 3 * (i * 37 % 4001), 3 * (i * 37 % 4001) + 1) for i in range(4000)]
        df = spark.createDataFrame(rows, "subject_id string, predicate string, from_us bigint, until_us bigint").repartition(4)
        got = iv.periods_of(iv.interval_lists(df), False).collect()
        assert sorted(map(tuple, got)) == brute(rows, 1)[1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_slots_grow_with_a_key(spark):
    df = spark.range(6000).selectExpr("if(id % 3 = 0, 'hot', concat('s', id)) subject_id", "id * 10 from_us").repartition(4)
    sizes = []
    for target in (1000, 100, 5):
        cuts = hot_cuts(df, ["subject_id"], "from_us", 6000, target)
        rows = slotted(df, ["subject_id"], "from_us", cuts)
        assert rows.filter("subject_id <> 'hot' and slot <> 0").count() == 0
        n = [r["count"] for r in rows.filter("subject_id = 'hot'").groupBy("slot").count().collect()]
        sizes.append((len(n), max(n)))
        w = rows.filter("subject_id = 'hot'").groupBy("slot").agg(F.min("from_us").alias("a"), F.max("from_us").alias("z")).orderBy("slot").collect()
        assert all(x["z"] < y["a"] for x, y in zip(w, w[1:]))
    assert sizes[0][0] == 2 and 15 <= sizes[1][0] <= 21 and sizes[2][0] > 300 and sizes[2][1] <= 15
    assert hot_cuts(df, ["subject_id"], "from_us", 6000, 3000) is None and hot_cuts(df.limit(0), ["subject_id"], "from_us", 6000, 10) is None


def test_dirty_rows(spark):
    f = lambda s, a, b, dead=None, p="p": (s, p, a, b, dead, "x", 1, 1, "y")
    d = [D(2025, 1, i) for i in range(1, 20)]
    rows = [
        f("A", d[0], d[1]), f("a", d[1], d[2]), f("a", d[4], d[5]), f("a", d[4], d[5]), f("a", d[3], d[3]), f("a", d[4], d[2]),  # touching, repeated, empty, reversed
        f("a", d[8], None), f("a", d[12], d[13]), f("a", d[6], d[7], d[0]),  # open end, nested in it, deleted
        f(None, d[0], d[1]), f("a", d[0], d[1], p=None), f("a", None, d[1]), f("b", d[0], D(9999, 12, 31)), f("c", D(1969, 1, 1), d[0]), f("c", d[0] + dt.timedelta(milliseconds=900), d[1]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    us = lambda t: int((t - D(1970, 1, 1)).total_seconds()) * 10**6
    assert sorted(map(tuple, iv.found(df).collect())) == [("a", "p", us(d[2]), us(d[4])), ("a", "p", us(d[5]), us(d[8]))]
    got = sorted(((r[0], r[2], r[3]) for r in iv.periods(df).collect()), key=str)
    assert ("a", us(d[8]), None) in got and ("b", us(d[0]), us(D(9999, 12, 31))) in got and len(got) == 6
    assert iv.found(df.limit(0)).count() == 0 and iv.periods(df.limit(0)).count() == 0
