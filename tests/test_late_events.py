from __future__ import annotations

import datetime as dt
import random

from tidemark.functions.time import DAY, HOUR
from tidemark.operators import late_events as le

EPOCH = dt.datetime(1970, 1, 1)
SCHEMA = "id string, source string, namespace string, occurred_at timestamp_ntz, ingested_at timestamp_ntz, deleted_at timestamp_ntz, grp string, state int, period_us double, r string"


def at(us: int) -> dt.datetime:
    return EPOCH + dt.timedelta(microseconds=us)


def episode(i, source, ns, occ, arr, dead=None):
    return (i, source, ns, None if occ is None else at(occ), None if arr is None else at(arr), None if dead is None else at(dead), "x", 1, 1.0, "y")


def test_found_against_brute_force(spark):
    rnd = random.Random(1)
    rows, want = [], set()
    for i in range(300):
        occ = rnd.randrange(0, 5 * DAY, HOUR)
        arr = occ + rnd.choice([-HOUR, 0, HOUR, 20 * HOUR, 24 * HOUR, 47 * HOUR, 72 * HOUR, 96 * HOUR, 200 * HOUR])
        ns = rnd.choice(["a", "b", None])
        rows.append(episode(f"ID{i}", "s", ns, occ, arr))
        end = occ - occ % DAY + DAY
        if end <= arr < end + 3 * DAY:
            want.add((ns, at(occ).strftime("%Y-%m-%d"), at(arr).strftime("%Y-%m-%d")))
        if i % 5 == 0:
            rows.append(episode(f"id{i}", "s", ns, occ, arr + 10 * DAY))  # written again later
    rows += [episode("dead", "s", "z", 0, 2 * DAY, 1), episode(None, "s", "z", 0, 2 * DAY), episode("n1", "s", "z", None, 2 * DAY), episode("n2", "s", "z", 0, None)]
    got = le.found(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want


def test_cutoff_and_closing_are_half_open(spark):
    rows = [episode("a", "s", "n", 0, DAY), episode("b", "s", "m", 0, DAY - 1), episode("c", "s", "o", 0, 4 * DAY - 1), episode("d", "s", "p", 0, 4 * DAY)]
    got = {r["namespace"] for r in le.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"n", "o"}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for op in (le.found, le.corrected_counts, le.diverted_counts, le.watermark_counts):
        assert op(empty).count() == 0


def test_corrected_counts_add_up(spark):
    rows = [episode(str(i), "s", "n", 0, t) for i, t in enumerate([0, HOUR, DAY, DAY + HOUR, 3 * DAY, 10 * DAY])]
    got = [(r["report_day"], r["added"], r["episodes"]) for r in le.corrected_counts(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=lambda x: x[0] or "") == [(None, 2, 2), ("1970-01-02", 2, 4), ("1970-01-04", 1, 5)]
    late = le.diverted_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["period"], r["diverted"]) for r in late] == [("1970-01-01", 1)]


def exact_closings(rows, bound, idle, said=()):
    """Each period closes when every source has passed its end, record by record: the mark after every single arrival, punctuations, silences between any two."""
    out = {}
    for p in {e - e % DAY for _, e, _ in rows}:
        end, per = p + DAY, []
        for s in {s for s, _, _ in rows}:
            mine = sorted((a, e) for x, e, a in rows if x == s)
            times = [a for a, e in mine if min(e, a) - bound >= end][:1] if bound is not None else []
            times += [t for x, to, t in said if x == s and to >= end]
            for (a, _), nxt in zip(mine, [a for a, _ in mine[1:]] + [2**62]):
                if idle is not None and nxt - a > idle and nxt > end:
                    times.append(max(a + idle, end))
                    break
            per.append(min(times) if times else None)
        out[p] = None if None in per else max(per)
    return out


def test_watermarks_with_idle_sources(spark):
    rnd = random.Random(5)
    rows = []
    for s, step in (("a", HOUR), ("b", 5 * HOUR), ("c", 40 * HOUR)):
        t = 0
        while t < 6 * DAY:
            t += rnd.randrange(1, 2 * step)
            rows.append((s, max(0, t - rnd.choice([0, HOUR, 10 * HOUR, 30 * HOUR])), t))
    df = spark.createDataFrame([(s, "g", e, a) for s, e, a in rows], "source string, grp string, event_us bigint, arrival_us bigint")
    got = {r["period_us"]: r["closed_us"] for r in le.closings(df, bound_us=6 * HOUR, idle_us=12 * HOUR).collect()}
    assert got == exact_closings(rows, 6 * HOUR, 12 * HOUR)


def test_punctuations_of_each_source(spark):
    """Punctuations, watermarks and silences together and alone; one source never speaks, one has no records."""
    rnd = random.Random(11)
    for bound, idle in ((None, None), (HOUR, None), (None, 9 * HOUR), (3 * HOUR, 20 * HOUR)):
        for quiet in (False, True):
            rows = [(s, rnd.randrange(0, 5 * DAY), rnd.randrange(0, 6 * DAY)) for s in "abc" for _ in range(rnd.choice([3, 30]))]
            said = [(s, rnd.randrange(0, 7 * DAY), rnd.randrange(0, 8 * DAY)) for s in ("ab" if quiet else "abc") for _ in range(12)] + [("z", 9 * DAY, 0)]
            df = spark.createDataFrame([(s, "g", e, a) for s, e, a in rows], "source string, grp string, event_us bigint, arrival_us bigint")
            words = spark.createDataFrame(said + [(None, 1, 1), ("a", None, 1)], "source string, asserted_us bigint, at_us bigint")
            got = {r["period_us"]: r["closed_us"] for r in le.closings(df, bound_us=bound, idle_us=idle, punctuations=words).collect()}
            assert got == exact_closings(rows, bound, idle, said)


def test_a_late_punctuation_of_one_source_holds_all_open(spark):
    df = spark.createDataFrame([("a", "g", 0, 0), ("b", "g", 0, 0), ("a", "g", HOUR, DAY + HOUR)], "source string, grp string, event_us bigint, arrival_us bigint")
    words = spark.createDataFrame([("a", DAY, DAY), ("b", DAY, DAY + 2 * HOUR)], "source string, asserted_us bigint, at_us bigint")
    assert [r["closed_us"] for r in le.closings(df, punctuations=words).collect()] == [DAY + 2 * HOUR]
    assert le.classify(df, le.closings(df, punctuations=words)).filter("state <> 'on_time'").count() == 0
    assert [r["closed_us"] for r in le.closings(df, punctuations=words.filter("source = 'a'")).collect()] == [None]
    assert {r["closed_us"] for r in le.closings(df, punctuations=le.calendar_punctuations(df)).collect()} == {DAY}


def test_watermarks_record_by_record(spark):
    rnd = random.Random(7)
    for bound, idle, step in ((6 * HOUR, 12 * HOUR, HOUR // 4), (0, None, HOUR // 9), (None, HOUR // 3, HOUR // 6), (2 * HOUR, HOUR // 2, HOUR // 3)):
        rows = []
        for s in "ab":
            t = 0
            while t < 4 * DAY:
                t += rnd.randrange(1, 2 * step)
                rows.append((s, max(0, t - rnd.choice([0, HOUR // 7, 10 * HOUR])), t))
        df = spark.createDataFrame([(s, "g", e, a) for s, e, a in rows], "source string, grp string, event_us bigint, arrival_us bigint")
        got = {r["period_us"]: r["closed_us"] for r in le.closings(df, bound_us=bound, idle_us=idle).collect()}
        assert got == exact_closings(rows, bound, idle)


def test_a_record_after_the_mark_is_a_correction(spark):
    """The mark passes the end at 00:05; a record of the old period at 00:50 of the same hour is late."""
    m = HOUR // 60
    rows = [("s", 0, 0), ("s", DAY, DAY + 5 * m), ("s", HOUR, DAY + 50 * m)]
    df = spark.createDataFrame([(s, "g", e, a) for s, e, a in rows], "source string, grp string, event_us bigint, arrival_us bigint")
    closed = le.closings(df, bound_us=0)
    assert {r["period_us"]: r["closed_us"] for r in closed.collect()}[0] == DAY + 5 * m
    assert sorted((r["arrival_us"], r["state"]) for r in le.classify(df, closed).collect()) == [(0, "on_time"), (DAY + 5 * m, "on_time"), (DAY + 50 * m, "correction")]
