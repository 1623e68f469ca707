from __future__ import annotations

import datetime as dt
import random

from tests.test_retrieval import ENTITIES, FACTS
from tidemark.operators import memory as m

T = dt.datetime(2025, 1, 1)


def fact(i, s, o, until=None, dead=None, ns="n"):
    return (i, ns, s, "p", o, T, until, None, None, None, T, dead)


def test_facts_by_entity_and_recall_give_the_facts(spark):
    en = spark.createDataFrame([("A", "Ann", "n", None), ("b", "Bob", "n", None), ("c", "ann", "n", None), ("d", "Dead", "n", T)], ENTITIES)
    fa = spark.createDataFrame([fact("F1", "a", "b"), fact("f1", "a", "b", dead=T), fact("f2", "a", "A"), fact("f3", "b", "a", until=T), fact("f4", "a", None, dead=T), fact("f5", "a", "b", ns="x"), fact("f6", "d", None)], FACTS)
    now = {(r["entity_id"], r["fact_id"], r["state"]) for r in m.entity_facts(fa, en).collect()}
    assert now == {("a", "f1", "current"), ("b", "f1", "current"), ("a", "f2", "current")}
    rows = [(r["entity_id"], r["fact_id"], r["state"]) for r in m.entity_facts(fa, en, historical=True).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == now | {("a", "f3", "closed"), ("b", "f3", "closed"), ("a", "f4", "deleted")}
    assert {(r["name"], r["fact_id"]) for r in m.recall(fa, en).collect()} == {("ann", "f1"), ("ann", "f2"), ("bob", "f1")}
    assert {(r["name"], r["fact_id"]) for r in m.recall(fa, en, historical=True).collect()} == {("ann", f) for f in ("f1", "f2", "f3", "f4")} | {("bob", f) for f in ("f1", "f3")}


def test_entity_type_validation_drops_other_types(spark):
    en = spark.createDataFrame([("a", "x", "Person", "n", None), ("b", "x", "spaceship", "n", None), ("c", "x", None, "n", None)], "id string, name string, entity_type string, namespace string, deleted_at timestamp_ntz")
    assert [r["entity_id"] for r in m.valid_types(en).collect()] == ["a"]


def test_supersession_with_slots_gives_the_same(spark):
    rnd = random.Random(8)
    fa = spark.createDataFrame([(f"f{i:03}", "n", "hot" if i % 3 else f"s{i % 5}", "p", rnd.choice("xyz"), T + dt.timedelta(hours=rnd.randrange(60)), None, None, None, None, T, None) for i in range(300)], FACTS).repartition(3)
    plain = sorted(map(tuple, m.supersede(fa).collect()))
    assert plain == sorted(map(tuple, m.supersede(fa, target=20).collect())) == sorted(map(tuple, m.supersede(fa, target=90).collect())) and len(plain) > 200


def test_chains_of_any_length_and_circles(spark):
    rows = [(f"c{i}", f"c{i + 1}" if i < 3000 else None) for i in range(3001)] + [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x"), ("self", "self"), ("d1", "d2"), ("d2", "gone"), ("lone", "gone")]
    fa = spark.createDataFrame([(i, "n", "s", "p", "o", T, None, by, None, None, T, None) for i, by in rows], FACTS)
    got = {r["id"]: (r["root"], r["hops"]) for r in m.chain_roots(fa).collect()}
    assert all(got[f"c{i}"] == ("c3000", 3000 - i) for i in range(3000)) and got["d1"] == ("d2", 1)
    assert all(got[k] == (None, None) for k in ("x", "y", "z", "into")) and "lone" not in got
