from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import leaks
from tidemark.sources.tables import table

DOC = "doc_id bigint, text string, hash string, win string, toks string, item_id string"


@pytest.fixture(scope="module")
def items(spark):
    return table(spark, SF, "eval_items").cache()


@pytest.fixture(scope="module")
def passages(items):
    return {r["item_id"]: r["passage"] for r in items.collect()}


def find(spark, texts: dict[int, str | None], items) -> set[tuple[int, int]]:
    df = spark.createDataFrame([(d, t, "x", "x", "x", "x") for d, t in texts.items()], DOC)
    return {tuple(r) for r in leaks.leaks(df, items).collect()}


def test_planted_stretches(spark, items, passages):
    """Whole, in part and altered passages of every item are found, each for its own item alone."""
    rnd = random.Random(3)
    texts, want = {}, set()
    for n, (item, passage) in enumerate(sorted(passages.items())):
        wide = sum(c > "　" for c in passage) * 2 > len(passage)
        if wide:
            at = rnd.randrange(0, max(1, len(passage) - 60))
            part = passage[at : at + 60]
            k = rnd.randrange(20, 40)
            part = part[:k] + part[k + 1 :]
        else:
            words = passage.split()
            own = words[18:] if words[0] == "Use" and len(words) > 42 else words
            at = rnd.randrange(0, max(1, len(own) - 24))
            part_words = own[at : at + 24]
            for k in (rnd.randrange(6, 10), rnd.randrange(14, 18)):
                if k >= len(part_words):
                    continue
                part_words[k] = rnd.choice([part_words[k][::-1] + "q", part_words[k] + " really", "**" + part_words[k].upper() + "**"])
            part = "\n> ".join([" ".join(part_words[:11]), " ".join(part_words[11:])])
        texts[n] = f"Something else stands here first. {part} And then it goes on about another matter."
        want.add((n, item))
    got = find(spark, texts, items)
    assert not got - want
    assert len(got) >= 0.95 * len(want)


def test_decoys(spark, items, passages):
    some = [p for p in passages.values() if p.startswith("Use nothing but")][0]
    p = passages[1001]
    words = p.split()
    swapped = p.replace("Zetsorelle", "Korvenal").replace("Ulmibrani", "Pelthorax").replace("Ostmavek", "Quinderol").replace("942", "17").replace("Yard", "Gate")
    texts = {
        1: " ".join(some.split()[:18]),  # common to several items
        2: "The phrase " + " ".join(words[10:16]) + " came up again.",  # short quotation
        3: "Zetsorelle, Ulmibrani Yard and Ostmavek; chat_zetsorelle",  # names
        4: swapped,  # the same wording about others
        5: None, 6: "", 7: "   ", 8: "a " * 5000,
    }
    assert find(spark, texts, items) == set()


def test_repeats_unicode_and_long_texts(spark, items, passages):
    p = passages[1001]
    texts = {1: "x y z " * 50_000 + p + " q" * 50_000, 2: p.upper().replace(" ", " \n"), 3: "​".join(p), 4: (p + " ") * 40}
    assert find(spark, texts, items) == {(i, 1001) for i in texts}


def altered(kind: str, passage: str, rnd: random.Random) -> str:
    """A stretch of the passage with alterations of one kind."""
    wide = sum(c > "\u3000" for c in passage) * 2 > len(passage)
    parts = list(passage) if wide else passage.split()
    joint, size, step = ("", 60, 17) if wide else (" ", 30, 11)
    if kind == "whole":
        return passage
    if not wide and parts[0] == "Use" and len(parts) > 42:
        parts = parts[18:]  # what precedes stands in several items
    at = rnd.randrange(0, max(1, len(parts) - size))
    part = parts[at : at + size]
    for k in range(step - 2, len(part) - 2, step):
        if kind == "changed":
            part[k] = "\u9f98" if wide else part[k][::-1] + "q"
        elif kind == "dropped":
            part[k] = ""
        elif kind == "added":
            part[k] += "\u9f98" if wide else " really"
    text = joint.join(p for p in part if p)
    if kind == "dressed":
        text = "> **" + unicodedata.normalize("NFD", text.upper()) + "**"
        text = text.replace("\u3002", "!").replace(" ", "  \n", 5).replace(",", " ;")
    return text


@pytest.mark.parametrize("kind", ["whole", "part", "changed", "dropped", "added", "dressed"])
def test_recall_by_kind(spark, items, passages, kind):
    rnd = random.Random(kind)
    texts = {n: f"Something else stands here first. {altered(kind, p, rnd)} And then it goes on about another matter." for n, (_, p) in enumerate(sorted(passages.items()))}
    want = {(n, item) for n, (item, _) in enumerate(sorted(passages.items()))}
    got = find(spark, texts, items)
    print(f"{kind}: recall {len(got & want) / len(want):.3f}")
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_equal_passages_are_reported_together(spark, passages):
    p = passages[1001]
    q = next(passages[k] for k in sorted(passages) if passages[k].isascii() and k > 1001)
    items = spark.createDataFrame([(1, p), (2, p.upper()), (3, q), (4, None), (5, " ")], "item_id bigint, passage string")
    assert find(spark, {7: "so. " + p + " end", 8: q, 9: "nothing"}, items) == {(7, 1), (7, 2), (8, 3)}
    half = spark.createDataFrame([(1, p + " " + q), (2, p + " quite another ending that goes on for a while")], "item_id bigint, passage string")
    assert find(spark, {7: p}, half) == set()  # common to both
    df = spark.createDataFrame([(7, p)], "doc_id bigint, text string")
    assert {tuple(r) for r in leaks.leaks(df, half, shared=2).collect()} == {(7, 1), (7, 2)}


def test_very_long_passage_and_one_doc_id_twice(spark):
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(3000)}" for _ in range(5000)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, passage string")
    assert find(spark, {1: " ".join(words), 2: "x " * 3000 + " ".join(words[4000:4020]) + " y" * 3000, 3: " ".join(words[::-1])}, items) == {(1, 1), (2, 1)}
    df = spark.createDataFrame([(1, " ".join(words[:50])), (1, "q " * 70 + " ".join(words[60:90])), (1, "none")], "doc_id bigint, text string")
    assert [tuple(r) for r in leaks.leaks(df, items).collect()] == [(1, 1)]


def test_bit_table_grows_with_the_seeds(spark):
    for n in (3, 40_000):
        own = spark.range(n).selectExpr("xxhash64(id) hash")
        table = leaks.bit_table(own)
        h = np.array([r[0] for r in own.collect()])
        assert len(leaks.maybe(table, h)) == n and len(table) * 64 >= min(1 << 28, 64 * n)
        other = np.array([r[0] for r in spark.range(10**9, 10**9 + 300_000).selectExpr("xxhash64(id) hash").collect()])
        assert len(leaks.maybe(table, other)) < 60


def test_empty(spark, items):
    df = spark.createDataFrame([], DOC)
    assert leaks.leaks(df, items).count() == 0
    docs = spark.createDataFrame([(1, "some text", "x", "x", "x", "x")], DOC)
    assert leaks.leaks(docs, items.limit(0)).count() == 0
    counts = leaks.leak_counts(df, items)
    assert counts.count() == items.count() and counts.agg(F.sum("documents")).first()[0] == 0
    assert leaks.leaks(docs, items.withColumn("passage", F.lit(None).cast("string"))).count() == 0


def test_own_stretch_of_seeds_that_other_items_have(spark):
    """Every seed of item 1 stands in another item, and every word in three others, but all twelve words stand in no other."""
    w = [f"w{k}" for k in range(12)]
    x = [[f"x{n}a{k}" for k in range(9)] for n in range(5)]
    rows = [(1, w), (2, w[:8] + x[0] + w[4:]), (3, x[1] + w[:7]), (4, w[5:] + x[2]), (5, x[3] + w[2:10] + x[4])]
    rows += [(6, w[:5] + x[0] + w[5:7] + x[1] + w[7:])]
    items = spark.createDataFrame([(n, " ".join(p)) for n, p in rows], "item_id bigint, passage string")
    texts = {1: " ".join(w), 2: "So it says: " + " ".join(w).upper() + ".", 3: " ".join(w[:8]), 4: " ".join(w[2:10]), 5: " ".join(w[:6] + ["and"] + w[6:])}
    assert find(spark, texts, items) == {(1, 1), (2, 1), (5, 1)}


def test_text_of_as_many_items_as_may_share_it(spark):
    p = " ".join(f"p{k}" for k in range(20))
    items = spark.createDataFrame([(n, f"{p} {' '.join(f'e{n}x{k}' for k in range(14))}") for n in range(1, 5)], "item_id bigint, passage string")
    df = spark.createDataFrame([(7, p)], "doc_id bigint, text string")
    assert {tuple(r) for r in leaks.leaks(df, items, shared=4).collect()} == {(7, n) for n in range(1, 5)}
    assert leaks.leaks(df, items, shared=3).count() == 0


def by_force(texts: dict[int, str], passages: dict[int, str], shared: int) -> set[tuple[int, int]]:
    """All items against all texts, nothing left out beforehand."""
    known = {g: leaks.tokens(p) for g, p in passages.items()}
    held: dict[int, dict[int, list[int]]] = {}
    for g, toks in known.items():
        for h, p in zip(*[x.tolist() for x in (leaks.seeds([toks])[0], leaks.seeds([toks])[2])]):
            held.setdefault(h, {}).setdefault(g, []).append(p)
    of = {t: sum(t in toks for toks in known.values()) for toks in known.values() for t in toks}
    out = set()
    for doc, text in texts.items():
        toks = leaks.tokens(text)
        h, _, at = leaks.seeds([toks])
        for g, passage in known.items():
            hits = [(d, x, False) for x, d in zip(h.tolist(), at.tolist()) if g in held.get(x, ())]
            rare = {t for t in passage if of[t] <= max(2, shared)}
            for _, on in leaks.stretches(toks, passage, rare, hits, {x: held[x][g] for _, x, _ in hits}):
                marks = [(d, p, held[x]) for x, d, p in on]
                having = [
                    k for k in known
                    if any(all(d + t in m.get(k, ()) for d, _, m in marks) or all(p + t in m.get(k, ()) for _, p, m in marks) for t in range(-100, 100))
                ]
                if len(having) <= shared:
                    out.add((doc, g))
    return out


@pytest.mark.parametrize("shared", [1, 2, 4])
def test_all_items_against_all_texts(spark, shared):
    """Passages put together from the same few phrases and words, with repeats within a passage."""
    rnd = random.Random(shared)
    phrases = [[f"t{rnd.randrange(30)}" for _ in range(rnd.randrange(3, 9))] for _ in range(7)]
    passages = {n: " ".join(sum((rnd.choice(phrases) for _ in range(rnd.randrange(2, 6))), [])) for n in range(1, 25)}
    passages |= {30: "a " * 20, 31: "a " * 30 + "b", 32: "a b " * 10}
    passages = {min(k for k in passages if passages[k].split() == p.split()): p for p in passages.values()}
    texts = {n: " ".join(sum((rnd.choice(phrases) for _ in range(rnd.randrange(2, 5))), [])) for n in range(60)}
    for n in range(60, 100):
        part = rnd.choice(list(passages.values())).split()[:34]
        part[rnd.randrange(len(part))] = rnd.choice(["", "q", "q r"])
        texts[n] = " ".join(part)
    items = spark.createDataFrame(list(passages.items()), "item_id bigint, passage string")
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = by_force(texts, passages, shared)
    assert {tuple(r) for r in leaks.leaks(df, items, shared).collect()} == want and len(want) > 5
