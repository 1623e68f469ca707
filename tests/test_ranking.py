from __future__ import annotations

import datetime as dt
import json

from tests.test_retrieval import ENTITIES, FACTS
from tidemark.operators import ranking as k

T = dt.datetime(2025, 1, 1)


def fact(i, o, day, predicate="p"):
    return (i, "n", "hub", predicate, o, None if day is None else T + dt.timedelta(days=day), None, None, None, None, T, None)


def test_dangling_facts_take_no_rank(spark):
    """The 20 newest facts lead nowhere or to a deleted entity; 20 of the 25 valid ones must come out."""
    en = spark.createDataFrame([("hub", "Hub", "n", None), ("dead", "Dead", "n", T), *[(f"o{i}", f"O{i}", "n", None) for i in range(25)]], ENTITIES)
    fa = spark.createDataFrame([fact(f"x{i}", "gone" if i % 2 else "dead", 100 + i) for i in range(20)] + [fact(f"f{i:02}", f"o{i}", i) for i in range(25)], FACTS)
    want = [f"O{i}" for i in range(24, 4, -1)]
    got = k.compile_compact(fa, en).collect()
    assert [[x["o"] for x in json.loads(r["context"])] for r in got] == [want]
    lines = k.compile_structured(fa, en).collect()[0]["context"].split("\n")[1:-1]
    assert [x.split('object="')[1].split('"')[0] for x in lines] == want


def test_facts_without_time_or_predicate_stay(spark):
    en = spark.createDataFrame([("hub", "Hub", "n", None), ("o", "O", "n", None)], ENTITIES)
    fa = spark.createDataFrame([fact("a", "o", 0), fact("b", "o", None), fact("c", "o", 1, None)], FACTS)
    lines = k.compile_structured(fa, en).collect()[0]["context"].split("\n")[1:-1]
    assert len(lines) == 3 and 'predicate=""' in lines[0] and 'since=""' in lines[2]
