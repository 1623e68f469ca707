from __future__ import annotations

import base64
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import mixing
from tidemark.llm.catalogue import QUERIES
from tidemark.llm.tokens import TOKENIZER, pieces, with_token_counts
from tidemark.sources.tables import table

DOC = "doc_id bigint, text string, source string, h string, bucket string, block string, k string"
TARGET = "mix_name string, source string, target_share double, max_repeats int, size_factor double, blocks int"


def test_permutations_are_onto():
    for size in (1, 2, 3, 7, 64, 1000, 4097):
        for key in (1, 2):
            got = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key))
            assert sorted(got) == list(range(size))
    a, b = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (1, 2))
    assert (a != b).mean() > 0.9 and (a != np.arange(1000)).mean() > 0.9


def test_pieces_count_the_same(spark):
    import tiktoken

    from tidemark.llm.tokens import PATTERN

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}, special_tokens={})
    text = "The ratio fell  from 3.26 to 5.98,\n once it's warm. 摘要列出了当天有效的全部事实。 " * 200
    want = len(enc.encode_ordinary(text))
    assert sum(len(enc.encode_ordinary(p)) for p in pieces(text, 100)) == want and "".join(pieces(text, 100)) == text
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    assert sorted(tuple(r) for r in with_token_counts(df, ["doc_id"]).collect()) == [(1, want), (2, 0), (3, 0)]


@pytest.fixture(scope="module")
def shares(spark):
    return QUERIES["p7_mix_shares"](spark, SF).collect()


def test_shares_come_as_near_as_repeats_allow(shares):
    for r in shares:
        cap = r["available_tokens"] * r["max_repeats"]
        want = min(r["wanted_tokens"], cap)
        assert abs(r["mixed_tokens"] - want) <= max(2 * mixing.BLOCK, 0.02 * want), r
        assert r["mixed_tokens"] <= cap and r["most_repeats"] <= r["max_repeats"]
    for mix in {r["mix_name"] for r in shares}:
        assert math.isclose(sum(r["actual_share"] for r in shares if r["mix_name"] == mix), 1, abs_tol=1e-9)


def test_blocks(spark, shares):
    rows = QUERIES["p7_mix_blocks"](spark, SF).cache()
    assert rows.count() == sum(r["blocks"] for r in shares)
    assert rows.select("mix_name", "shard", "slot").distinct().count() == rows.count()
    per = rows.groupBy("mix_name", "source", "block").count().agg(F.max("count")).first()[0]
    assert per <= 4
    assert rows.filter(F.expr("n_tokens <> aggregate(docs, 0L, (a, d) -> a + d.to_token - d.from_token)")).count() == 0
    assert rows.filter(f"n_tokens > {mixing.BLOCK}").count() == 0
    again = QUERIES["p7_mix_blocks"](spark, SF)
    cols = ["mix_name", "shard", "slot", "source", "block"]
    assert rows.select(cols).exceptAll(again.select(cols)).count() == 0  # the same after recomputing


def test_packing_covers_every_token_once(spark):
    counts = mixing.token_counts(table(spark, SF, "documents"))
    first = None
    for per_bucket in (20_000, 13):
        spans = mixing.packed(counts, counts.count(), 64, per_bucket).cache()
        back = spans.groupBy("source", "doc_id").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("t"), F.min("from_token").alias("a"), F.max("to_token").alias("z"))
        want = counts.filter("source is not null and n_tokens > 0")
        assert back.count() == want.count() and back.join(want, "doc_id").filter("t <> n_tokens or a <> 0 or z <> n_tokens").count() == 0
        full = spans.groupBy("source", "block").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("t"))
        assert full.filter("t > 64").count() == 0 and full.filter("t < 64").count() <= full.select("source").distinct().count()
        first = first or sorted(map(tuple, spans.collect()))
        assert sorted(map(tuple, spans.collect())) == first  # blocks do not depend on the buckets


def test_quotas_against_plain_python(spark, shares):
    """Quotas and shares recomputed from the token counts alone, without any of the operator's steps."""
    counts: dict[str, list[int]] = {}
    for r in mixing.token_counts(table(spark, SF, "documents")).collect():
        counts.setdefault(r["source"], []).append(r["n_tokens"])
    total = sum(map(sum, counts.values()))
    want = {}
    for r in table(spark, SF, "mix_targets").collect():
        source = r["source"].strip().lower()
        tokens = sum(counts.get(source, []))
        blocks = -(-tokens // mixing.BLOCK)
        size = r["target_share"] * r["size_factor"] * total
        want[r["mix_name"], source] = min(round(size * blocks / tokens), r["max_repeats"] * blocks) if tokens else 0, size, tokens
    assert {(r["mix_name"], r["source"]): r["blocks"] for r in shares} == {k: v[0] for k, v in want.items()}
    for r in shares:
        n, size, tokens = want[r["mix_name"], r["source"]]
        assert math.isclose(r["wanted_tokens"], size) and r["available_tokens"] == tokens and abs(r["mixed_tokens"] - n * mixing.BLOCK) <= mixing.BLOCK * r["max_repeats"]
    for mix in {k[0] for k in want}:
        all_ = sum(r["mixed_tokens"] for r in shares if r["mix_name"] == mix)
        assert all(math.isclose(r["actual_share"], r["mixed_tokens"] / all_) for r in shares if r["mix_name"] == mix)


def test_many_shards(spark):
    """Shards keep their size however many there are; every slot comes once, quotas are exact, each pass goes over all blocks."""
    plan = spark.createDataFrame([("m", "a", 900, 40_000), ("m", "b", 20_011, 30_000), ("m", "c", 7, 3), ("n", "a", 900, 5), ("n", "z", 0, 0)], "mix_name string, source string, blocks long, slots long")
    rows = mixing.slots(plan, shard=8).cache()
    assert {(r["mix_name"], r["source"]): r["count"] for r in rows.groupBy("mix_name", "source").count().collect()} == {("m", "a"): 40_000, ("m", "b"): 30_000, ("m", "c"): 3, ("n", "a"): 5}
    per = rows.groupBy("mix_name", "shard").count()
    assert per.filter("count > 8").count() == 0 and per.filter("mix_name = 'm'").count() == 8751
    assert rows.select("mix_name", "source", "k").distinct().count() == rows.count() == rows.select("mix_name", "source", "block", "epoch").distinct().count()
    assert rows.filter("mix_name = 'm' and source = 'a' and epoch = 3").select("block").distinct().count() == 900


def test_dirty_rows(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * 40, s, "x", "x", "x", "x") for i, s in enumerate([" A", "a", "B", None, "  ", "C"])] + [(9, None, "b", "x", "x", "x", "x"), (10, "", "b", "x", "x", "x", "x"), (None, "t", "a", "x", "x", "x", "x")], DOC)
    targets = spark.createDataFrame([("m", "A ", 0.5, 2, 0.5, 1), ("m", "b", 0.3, 1, 0.5, 1), ("m", "none", 0.2, 3, 0.5, 1), (None, "a", 1.0, 1, 1.0, 1), ("m", None, 1.0, 1, 1.0, 1)], TARGET)
    got = {r["source"]: r for r in mixing.mix_shares(docs, targets, block=8).collect()}
    assert set(got) == {"a", "b", "none"} and got["none"]["mixed_tokens"] == 0
    assert got["a"]["most_repeats"] <= 2 and got["b"]["most_repeats"] <= 1
    assert mixing.mix_shares(docs.limit(0), targets).agg(F.sum("mixed_tokens")).first()[0] == 0
    assert mixing.mix_shares(docs, targets.limit(0)).count() == 0
    assert mixing.mix_blocks(docs.limit(0), targets).count() == 0
