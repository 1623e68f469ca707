from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import retrieval as r

ENTITIES = "id string, name string, namespace string, deleted_at timestamp_ntz"
FACTS = "id string, namespace string, subject_id string, predicate string, object_id string, valid_from timestamp_ntz, valid_until timestamp_ntz, superseded_by string, properties string, source_episodes array<string>, created_at timestamp_ntz, deleted_at timestamp_ntz"


def log(spark, *queries):
    return spark.createDataFrame([("n", q) for q in queries], "namespace string, query_text string")


def entities(spark, *names):
    return spark.createDataFrame([(f"e{i}", n, "n", None) for i, n in enumerate(names)], ENTITIES)


def test_fact_lookup_asks_all_entities_a_term_names(spark):
    """Seven entities match; the best fact is about the last of them by name."""
    en = entities(spark, *[f"node {c}" for c in "abcdefg"])
    fa = spark.createDataFrame([(f"f{i}", "n", f"e{i}", "p", None, None, None, None, '{"confidence": %s}' % (0.1 * i + 0.1), None, None, None) for i in range(7)], FACTS)
    got = [(x["fact_id"], x["rank"]) for x in r.fact_lookup(log(spark, "node"), fa, en).orderBy("rank").collect()]
    assert got == [(f"f{i}", 7 - i) for i in range(6, -1, -1)]
    assert [x["name"][-1] for x in r.keyword_entities(log(spark, "node"), en).orderBy("rank").collect()] == list("abcde")


def test_short_terms_of_three_bytes_meet_longer_names(spark):
    en = entities(spark, "Отдел ИИ и данных", "数据库服务", "ИИ", "node", "库")
    got = {(x["term"], x["entity_id"]) for x in r.keyword_entities(log(spark, "ИИ", "库", "数据", "服务 node"), en).collect()}
    assert got == {("ии", "e0"), ("ии", "e2"), ("库", "e1"), ("库", "e4"), ("数据", "e1"), ("服务", "e1"), ("node", "e3")}


def test_tiles_give_the_exact_neighbours(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(-3, 4, (230, 5)).astype(float)
    m[7] = 0
    rows = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(m)] + [(900, None, 1), (901, [], 1), (None, [1.0] * 5, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("rank", F.lit("x"))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    s = np.round(u @ u.T, 6)
    for same in (None, "label"):
        want = set()
        for q in range(0, 230, 50):
            near = sorted((-s[q, j], j) for j in range(230) if j != q and (same is None or j % 3 == q % 3))[:4]
            want |= {(q, j, -x, r + 1) for r, (x, j) in enumerate(near)}
        for tile in ((2, 17), (4096, 16_384), (1, 300)):
            got = {(r["query_id"], r["vec_id"], r["similarity"], r["rank"]) for r in r.nearest(df, df.filter("vec_id % 50 = 0"), 4, same=same, tile=tile).collect()}
            assert got == want
    assert r.nearest(df.limit(0), df, 3).count() == 0 and r.nearest(df, df.limit(0), 3).count() == 0


def test_ways_through_a_graph(spark):
    """A node reached by two ways of two hops comes twice; loops, deleted ends and other namespaces lead nowhere."""
    seed = "00000000-0000-0000-0000-000000000032"  # 0x32 = 50
    en = spark.createDataFrame([(seed, "s", "n", None), *((x, x, "n", None) for x in ("b", "c", "d", "e")), ("dead", "x", "n", dt.datetime(2025, 1, 1))], ENTITIES)
    fact = lambda i, s, o, until=None, ns="n": (i, ns, s, "p", o, None, until, None, None, None, None, None)
    fa = spark.createDataFrame([fact("1", seed.upper(), "b"), fact("2", "c", seed), fact("3", "b", "d"), fact("4", "d", "C"), fact("5", "b", "b"), fact("6", "b", "dead"), fact("7", seed, "e", dt.datetime(2025, 1, 1)), fact("8", "d", "e", ns="m"), fact("9", "d", "e")], FACTS)
    got = {(x["entity_id"], x["hop"], x["facts"]) for x in r.walk_rows(fa, en).collect()}
    assert got == {("b", 1, "1"), ("c", 1, "2"), ("d", 2, "1>3"), ("d", 2, "2>4")}
    far = {(x["entity_id"], ">".join(x["facts"])) for x in r.walks(fa, en, 3).filter("hop = 3").collect()}
    assert far == {("c", "1>3>4"), ("b", "2>4>3"), ("e", "1>3>9"), ("e", "2>4>9")}
    assert {(x["fact_id"], x["hop"]) for x in r.graph_edges(fa, en).collect()} == {("1", 1), ("2", 1), ("3", 2), ("4", 2)}
