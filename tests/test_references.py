from __future__ import annotations

import datetime as dt
import random

from tidemark.operators import references as rf

D = dt.datetime
FACT = "id string, subject_id string, object_id string, superseded_by string, source_episodes array<string>, created_at timestamp_ntz, deleted_at timestamp_ntz, salt int, state string, ref_id string"
ENT = "id string, created_at timestamp_ntz, deleted_at timestamp_ntz, live int"
EPI = "id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, made_us int"


def fact(i, s, o, by=None, eps=None, made=D(2025, 1, 10), dead=None):
    return (i, s, o, by, eps, made, dead, 1, "s", "r")


def frames(spark, facts, ents, eps):
    return spark.createDataFrame(facts, FACT), spark.createDataFrame(ents, ENT), spark.createDataFrame(eps, EPI)


def test_states(spark):
    ents = [("E1", D(2025, 1, 1), None, 1), ("e2", D(2025, 1, 20), None, 1), ("e3", D(2025, 1, 1), D(2025, 2, 1), 1), ("e4", None, None, 1), (None, None, None, 1), ("e1", D(2025, 1, 1), None, 1)]
    eps = [("p1", D(2025, 1, 30), None, 1), ("p1", D(2025, 1, 5), None, 1), ("p2", D(2025, 1, 1), D(2025, 1, 2), 1)]
    facts = [
        fact("f1", "e1", "e2", "F2", ["p1", "P1", "p2", None, "p9"]), fact("f1", "e1", "e2", "F2", ["p1", "P1", "p2", None, "p9"]),
        fact("f2", "e3", "e4", "f3", []), fact("f3", None, "gone", None, None, None), fact("f4", "x", "y", "z", ["w"], dead=D(2025, 1, 1)), fact("f5", "e2", "e1", "f4", None, None),
    ]
    f, e, p = frames(spark, facts, ents, eps)
    got = sorted((r["fact_id"], r["field"], r["ref_id"], r["state"]) for r in rf.orphans(f, e, p).collect())
    assert got == sorted([
        ("f1", "object_id", "e2", "late"), ("f1", "source_episodes", "p2", "deleted"), ("f1", "source_episodes", "p9", "missing"),
        ("f2", "subject_id", "e3", "deleted"), ("f3", "object_id", "gone", "missing"), ("f5", "superseded_by", "f4", "deleted")])
    assert rf.found(f, e, p).columns == ["fact_id", "field", "ref_id"]


def test_empty(spark):
    f, e, p = frames(spark, [], [], [])
    assert rf.found(f, e, p).count() == 0 and rf.by_table_and_day(f, e, p).count() == 0


def test_a_hot_target_is_split_by_size(spark):
    """Nearly all references name one target: its partition is cut, the result is the same, and the parents' own repeats change nothing."""
    rnd = random.Random(3)
    ents = [(f"e{i}", D(2025, 1, rnd.randrange(1, 28)), D(2025, 3, 1) if i % 7 == 0 else None, 1) for i in range(20)] * 3
    facts = [fact(f"f{i}", "e1", f"e{rnd.randrange(30)}" if i % 5 == 0 else "E7", None, None, D(2025, 1, rnd.randrange(1, 28))) for i in range(20_000)]
    f, e, p = frames(spark, facts, ents, [])
    f = f.repartition(8)
    refs, known = rf.references(f), rf.parents(e, p, f)
    state = {}
    for i, made, dead, _ in ents[:20]:
        state[i] = (made, dead)
    want = {}
    for r in facts:
        for field, ref in (("subject_id", r[1]), ("object_id", r[2].lower())):
            made, dead = state.get(ref, (None, None))
            want[r[0], field] = "missing" if made is None else "deleted" if dead else "late" if made > r[5] else "ok"
    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "60k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        out = rf.merge_references(refs, known)
        got = {(r["fact_id"], r["field"]): r["state"] for r in out.collect()}
        assert "skew=true" in out._jdf.queryExecution().toString()
    finally:
        for k in names:
            spark.conf.unset(k)
    assert got == want
