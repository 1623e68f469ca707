"""Evaluation passages in training texts, by spaced seeds.

A seed is the hash of the tokens under a fixed mask; places the mask leaves out may differ.  Items with equal passages are one group and are
reported together.  Texts are read once: a task keeps the places whose seed may be one of the items' (a Bloom filter sized by their number)
together with the tokens around them, in windows that are written to the shared folder.  Spark joins seeds and places alone, brings the tokens
of the windows concerned back by window, once for each window and item, and the tokens around the hits are aligned with the passage,
tolerating changed, dropped and added tokens.

Common is a stretch, never a seed: a stretch is common text where the seeds on it stand, at the same distances, in the passages of more than
``shared`` groups.  A seed of at most ``shared`` groups proves a stretch not to be common.  Where there is none, groups all of whose seeds in a
window stand in enough other groups as they stand in the document are left out before tokens are brought back (no part of them can be anything
but common), once for each pattern of seeds, however many windows have it; the stretches of the others are looked up in all passages.

Tokens are words of NFKC-folded text without markup; Han, Hiragana and Katakana count by character.
"""

from __future__ import annotations

import re as plain_re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex as re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.common import spread
from tidemark.session import shared_dir

IGNORED = re.compile(r"[­​-‏⁠﻿*_`~]")
TOKEN = re.compile(r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}ー]|[[\p{L}\p{M}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}ー]]+")
SIMPLE = plain_re.compile("[\x00-\u02ff\u0370-\u0482\u048a-\u052f\u1e00-\u20cf\u2100-\u2bff\U0001f300-\U0001faff]*\\Z")  # no marks, no wide scripts
WIDE = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
WORD_MASKS = ("1111", "11011", "110101", "101011")
CHAR_MASKS = ("11111111", "1111011101", "1101110111")
LEAST_BITS, MOST_BITS = 20, 28  # size of the bit table as a power of two; 2**28 bits are 32 MB
CHUNK = 200_000  # tokens hashed at once
AROUND = 40
MOST = 1000  # tokens in a window; longer stretches of hits are cut into overlapping windows
MIN_WORDS, MIN_CHARS = 12, 24


def tokens(text: str) -> list[str]:
    text = unicodedata.normalize("NFKC", IGNORED.sub("", unicodedata.normalize("NFKC", text)).casefold())
    return plain_re.findall(r"\w+", text) if SIMPLE.match(text) else TOKEN.findall(text)


def seeds(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hash, text, place`` of every seed of several texts at once; the mask family follows the script of the seed's first token."""
    lengths = np.array([len(t) for t in texts], np.int64)
    toks = [t for ts in texts for t in ts]
    text = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(toks)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, toks), np.uint64, len(toks))
    wide = np.fromiter((len(t) == 1 and t >= "\u2e80" and WIDE.match(t) is not None for t in toks), bool, len(toks))
    hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for family, masks in ((False, WORD_MASKS), (True, CHAR_MASKS)):
            for number, mask in enumerate(masks):
                n = len(toks) - len(mask) + 1
                if n <= 0:
                    continue
                here = np.flatnonzero((wide[:n] == family) & (text[:n] == text[len(mask) - 1 :]))
                h = np.full(len(here), 0x9E3779B97F4A7C15 + number + 10 * family, np.uint64)
                for k, bit in enumerate(mask):
                    if bit == "1":
                        h = (h ^ each[here + k]) * np.uint64(0xBF58476D1CE4E5B9)
                        h ^= h >> np.uint64(29)
                hashes.append(h.view(np.int64))
                at.append(here)
    flat = np.concatenate(at)
    return np.concatenate(hashes), text[flat], place[flat]


def item_tokens(items: DataFrame) -> DataFrame:
    """``item_id, toks, same`` of every item with a passage; ``same`` is equal for equal passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([tokens(t) for t in b.column("passage").to_pylist()], pa.list_(pa.string()))], names=["item_id", "toks"])

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "passage").dropna().mapInArrow(run, "item_id bigint, toks array<string>")
    return rows.filter("size(toks) > 0").withColumn("same", F.sha2(F.concat_ws(" ", "toks"), 256))


def groups(known: DataFrame) -> DataFrame:
    """``g, toks``: one row per group of equal passages, named by its least item."""
    return known.groupBy("same").agg(F.min(F.struct("item_id", "toks")).alias("x")).select(F.col("x.item_id").alias("g"), "x.toks")


def item_seeds(passages: DataFrame) -> DataFrame:
    """``hash, held``: every seed of the passages (g, toks) with all groups that have it and all its places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, toks in zip(b.column("g").to_pylist(), b.column("toks").to_pylist()):
                h, _, at = seeds([toks])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), g)), pa.array(at.astype(np.int32))], names=["hash", "g", "p_at"])

    each = passages.mapInArrow(run, "hash bigint, g bigint, p_at int").groupBy("hash", "g").agg(F.sort_array(F.collect_list("p_at")).alias("at"))
    return each.groupBy("hash").agg(F.collect_list(F.struct("g", "at")).alias("held"))


SHIFTS = (0, 21, 36)  # each seed sets the bits at these shifts of its hash and at their mix; all four must be set


def bit_table(own: DataFrame) -> np.ndarray:
    """The item seeds as a Bloom filter of 64 bits a seed, at least 128 KB and at most 32 MB.

    Beyond that more places than needed are kept; the join decides, so nothing is lost.  Spark sets the bits word by word; the words that have
    any come to the driver, at most 2**22.
    """
    n = max(1, own.count())
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * n - 1).bit_length()))
    probes = [F.shiftrightunsigned("hash", k) for k in SHIFTS] + [F.col("hash").bitwiseXOR(F.shiftrightunsigned("hash", 32))]
    places = own.select(F.explode(F.array(*[p.bitwiseAND(F.lit((1 << bits) - 1)) for p in probes])).alias("p"))
    words = places.select(F.shiftright("p", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("x")).groupBy("w").agg(F.bit_or("x").alias("x")).toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["w"].to_numpy()] = words["x"].to_numpy()
    return table


def maybe(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in ``h`` of the hashes that may be in the table."""
    keep, mask = np.arange(len(h)), np.uint64(len(table) * 64 - 1)
    u = h.view(np.uint64)
    for k in (*SHIFTS, None):
        x = u[keep]
        p = (((x ^ (x >> np.uint64(32))) if k is None else x >> np.uint64(k)) & mask).view(np.int64)
        keep = keep[(table[p >> 6] >> (p & 63)) & 1 == 1]
    return keep


def hit_windows(documents: DataFrame, table: np.ndarray) -> DataFrame:
    """``doc_id, toks, hits``: stretches of tokens around places whose seed may be an item's, with those seeds and places."""
    shared = documents.sparkSession.sparkContext.broadcast(table)  # at most 32 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def windows(docs: list[int], texts: list[list[str]]) -> pa.RecordBatch | None:
            out: tuple[list, list, list] = ([], [], [])
            h, text, at = seeds(texts)
            keep = maybe(known, h)
            keep = keep[np.lexsort((at[keep], text[keep]))]
            h, text, at = h[keep], text[keep], at[keep]
            first = 0
            for j in range(1, len(h) + 1):
                if j == len(h) or text[j] != text[first] or at[j] - at[j - 1] > 2 * AROUND or at[j] - at[first] > MOST:
                    toks = texts[text[first]]
                    lo, hi = max(0, at[first] - AROUND), min(len(toks), at[j - 1] + AROUND + 10)
                    out[0].append(docs[text[first]]), out[1].append(toks[lo:hi])
                    out[2].append([{"hash": int(x), "d_at": int(y - lo)} for x, y in zip(h[first:j], at[first:j])])
                    first = j
            hit = pa.list_(pa.struct([("hash", pa.int64()), ("d_at", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], hit)], names=["doc_id", "toks", "hits"]) if out[0] else None

        for b in batches:
            docs, texts, held = [], [], 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                docs.append(doc), texts.append(tokens(text))
                held += len(texts[-1])
                if held > CHUNK:
                    if (out := windows(docs, texts)) is not None:
                        yield out
                    docs, texts, held = [], [], 0
            if docs and (out := windows(docs, texts)) is not None:
                yield out

    rows = spread(documents.select("doc_id", "text").dropna(), "doc_id")
    return rows.mapInArrow(run, "doc_id bigint, toks array<string>, hits array<struct<hash: bigint, d_at: int>>")


def _walk(a: list[str], b: list[str], i: int, j: int, step: int) -> list[tuple[int, int]]:
    """Matched places from (i, j) on in one direction.  A mismatch is bridged where two tokens agree again within three."""
    out = []
    while 0 <= i < len(a) and 0 <= j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + step, j + step
            continue
        for x, y in ((1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1), (0, 2), (2, 0), (3, 3)):
            u, v = i + x * step, j + y * step
            if 0 <= u < len(a) and 0 <= v < len(b) and a[u] == b[v]:
                u2, v2 = u + step, v + step
                if not (0 <= u2 < len(a) and 0 <= v2 < len(b)) or a[u2] == b[v2]:
                    i, j = u, v
                    break
        else:
            break
    return out


def _rows(lists: pa.ListArray, *fields: str) -> Iterator[list[tuple]]:
    """The structs of each list as tuples of plain values; a list field gives a list of such tuples.  Much quicker than one by one."""
    flat = lists.flatten()
    columns = [list(_rows(c, *[f.name for f in c.type.value_type])) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False).tolist() for c in map(flat.field, fields)]
    values = list(zip(*columns))
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    for i, j in zip([0, *ends], ends):
        yield values[i:j]


def not_covered(marks: list[tuple[int, list[tuple[int, int]]]], shared: int) -> dict[int, list[int]]:
    """The groups that may have a stretch of their own among ``marks`` (place in the window, groups with places in the passage), with their marks.

    A group is left out where ``shared`` others have all of its marks at the distances of the document, hence every part of them.
    """
    whole: dict[int, int] = {}
    least: dict[int, int] = {}  # of the marks of a group, the one that the fewest groups have
    lines: dict[tuple[int, int], int] = {}
    for i, (d, held) in enumerate(marks):
        for g, p in held:
            whole[g] = whole.get(g, 0) | 1 << i
            lines[g, d - p] = lines.get((g, d - p), 0) | 1 << i
            if g not in least or len(held) < len(marks[least[g]][1]):
                least[g] = i
    covers: dict[int, set[int]] = {}
    out = {}
    for g, mine in whole.items():
        if mine not in covers:
            covers[mine] = some = set()
            d, held = marks[least[g]]
            for h, p in held:
                if mine & ~lines[h, d - p] == 0:
                    some.add(h)
                    if len(some) > shared:
                        break
        if len(covers[mine] - {g}) < shared:
            out[g] = [i for i in range(len(marks)) if mine >> i & 1]
    return out


def shared_hits(places: DataFrame, common: DataFrame, shared: int) -> DataFrame:
    """``win, g, hits`` from the seeds that more than ``shared`` groups have, where they may make a stretch that no more than those have."""
    each = places.join(common.select("hash"), "hash").groupBy("win").agg(F.sort_array(F.collect_list(F.struct("d_at", "hash"))).alias("x"))
    lists = each.select("win", F.col("x")[0]["d_at"].alias("from"), F.transform("x", lambda m: F.struct((m["d_at"] - F.col("x")[0]["d_at"]).alias("d_at"), m["hash"].alias("hash"))).alias("x"))
    lists = lists.withColumn("pattern", F.sha2(F.to_json("x"), 256))
    marks = lists.groupBy("pattern").agg(F.first("x").alias("x")).select("pattern", F.explode("x").alias("m")).select("pattern", "m.d_at", "m.hash")
    # eight places of a seed in a passage: without the rest fewer groups are left out here, so nothing is lost
    some = common.select("hash", F.flatten(F.transform("held", lambda h: F.transform(F.slice(h["at"], 1, 8), lambda p: F.struct(h["g"].alias("g"), p.alias("p_at"))))).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = pa.list_(pa.struct([("d_at", pa.int32()), ("hash", pa.int64())]))
        for b in batches:
            for pattern, rows in zip(b.column("pattern").to_pylist(), _rows(b.column("marks"), "d_at", "hash", "held")):
                left = not_covered([(d, held) for d, _, held in rows], shared)
                if left:
                    hits = [[{"d_at": rows[i][0], "hash": rows[i][1]} for i in own] for own in left.values()]
                    yield pa.RecordBatch.from_arrays([pa.array([pattern] * len(left)), pa.array(list(left), pa.int64()), pa.array(hits, hit)], names=["pattern", "g", "hits"])

    gathered = marks.join(some, "hash").groupBy("pattern").agg(F.collect_list(F.struct("d_at", "hash", "held")).alias("marks"))
    left = gathered.mapInArrow(run, "pattern string, g bigint, hits array<struct<d_at: int, hash: bigint>>")
    hits = F.transform("hits", lambda m: F.struct((m["d_at"] + F.col("from")).alias("d_at"), m["hash"].alias("hash"), F.lit(False).alias("few")))
    return left.join(lists.select("win", "from", "pattern"), "pattern").select("win", "g", hits.alias("hits"))


def stretches(doc: list[str], passage: list[str], rare: set[str], hits: list[tuple[int, int, bool]], places: dict[int, list[int]]) -> Iterator[tuple[bool, list[tuple[int, int, int]]]]:
    """Long enough stretches of the document that read like the passage around ``hits`` (place, seed, whether few groups have it).

    A stretch must reach MIN_WORDS words (MIN_CHARS characters where the passage is mostly wide script) in the document,
    agree in most tokens, and agree in at least half of the tokens that are the item's own (names, numbers), or in every token of the passage
    where none is, so that the same wording about other names makes no case.  Whether a seed of few groups is on it, and the seeds on it as (hash, d_at, p_at).
    """
    wide = sum(len(t) == 1 and WIDE.match(t) is not None for t in passage) * 2 > len(passage)
    size = (lambda ts: sum(len(t) for t in ts)) if wide else len
    least = MIN_CHARS if wide else MIN_WORDS
    here: dict[int, dict[int, bool]] = {}
    for d, h, few in hits:
        here.setdefault(d, {})[h] = few
    there: dict[int, set[int]] = {}
    for h in {h for _, h, _ in hits}:
        for p in places.get(h, ()):
            there.setdefault(p, set()).add(h)
    done: set[tuple[int, int]] = set()
    for d in sorted(here):
        for p in sorted({p for h in here[d] for p in places.get(h, ())}):
            if (d, p) in done:
                continue
            same = _walk(doc, passage, d - 1, p - 1, -1)[::-1] + _walk(doc, passage, d, p, 1)
            done.update(same)
            # trim ends where fewer than half of the tokens agree
            while len(same) > 3 and same[3][0] - same[0][0] > 7:
                same = same[1:]
            while len(same) > 3 and same[-1][0] - same[-4][0] > 7:
                same = same[:-1]
            if not same:
                continue
            (d0, p0), (d1, p1) = same[0], same[-1]
            if size(doc[d0 : d1 + 1]) < least and size(passage[p0 : p1 + 1]) < least:
                continue
            hit = {y for _, y in same}
            agree = len(same) / max(d1 - d0 + 1, p1 - p0 + 1)
            own = [k for k in range(p0, p1 + 1) if passage[k] in rare]
            must = 2 * sum(k in hit for k in own) >= len(own) if own else len(hit) == p1 - p0 + 1
            if agree >= 0.65 and must:
                on = [(h, x, y) for x, y in same for h in here.get(x, ()) if h in there.get(y, ())]
                if on:
                    yield any(here[x][h] for h, x, _ in on), on


def aligned(pairs: DataFrame, passages: DataFrame, shared: int) -> DataFrame:
    """``doc_id, g, on`` of pairs (win, doc_id, g, toks, hits) whose tokens read like the group's passage; ``on`` is null where few groups have a
    seed of the stretch, otherwise the seeds on it as (hash, d_at from the first on, p_at), a row for each stretch."""
    # a token is the passage's own where at most two groups have it, or as many as may share a text
    each = passages.select("g", F.explode(F.array_distinct("toks")).alias("tok"))
    few = each.groupBy("tok").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= max(2, shared)).select("tok")
    rare = each.join(few, "tok").groupBy(F.col("g").alias("r")).agg(F.collect_list("tok").alias("rare"))
    known = passages.select(F.col("g").alias("i"), F.col("toks").alias("passage")).join(rare, F.col("i") == F.col("r"), "left").drop("r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(1000)
        def item(g: int) -> tuple[list[str], set[str], dict[int, list[int]]]:
            passage, places = b.column("passage")[i].as_py(), {}
            h, _, at = seeds([passage])
            for x, y in zip(h.tolist(), at.tolist()):
                places.setdefault(x, []).append(y)
            return passage, set(b.column("rare")[i].as_py() or ()), places

        last, toks = None, []
        on = pa.list_(pa.struct([("hash", pa.int64()), ("d_at", pa.int32()), ("p_at", pa.int32())]))
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i, (win, doc, g, hits) in enumerate(zip(b.column("win").to_pylist(), b.column("doc_id").to_pylist(), b.column("g").to_pylist(), _rows(b.column("hits"), "d_at", "hash", "few"))):
                if win != last:  # the items of a window mostly come one after the other
                    last, toks = win, b.column("toks")[i].as_py()
                passage, rare, places = item(g)
                found: list | None = []
                for sure, at in stretches(toks, passage, rare, hits, places):
                    if sure:
                        found = None
                        break
                    found.append([{"hash": h, "d_at": d - at[0][1], "p_at": p} for h, d, p in sorted(at, key=lambda a: (a[1], a[2], a[0]))])
                for x in [None] if found is None else found:
                    out[0].append(doc), out[1].append(g), out[2].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], on)], names=["doc_id", "g", "on"])

    rows = pairs.join(known, F.col("g") == F.col("i")).select("win", "doc_id", "g", "toks", "passage", "rare", "hits")
    return rows.mapInArrow(run, "doc_id bigint, g bigint, on array<struct<hash: bigint, d_at: int, p_at: int>>")


def is_common(marks: list[tuple[int, int, dict[int, list[int]]]], shared: int) -> bool:
    """Whether more than ``shared`` groups have all ``marks`` (d_at, p_at, places by group) at the distances of the document or of the passage."""
    at = [(d, p, {g: set(q) for g, q in held.items()}) for d, p, held in marks]
    d0, p0, first = min(at, key=lambda m: len(m[2]))
    n = 0
    for g, places in first.items():
        if all(g in held for _, _, held in at):
            n += any(all(q - d0 + d in held[g] for d, _, held in at) or all(q - p0 + p in held[g] for _, p, held in at) for q in places)
            if n > shared:
                return True
    return False


def not_common(asked: DataFrame, own: DataFrame, shared: int) -> DataFrame:
    """``text`` of the stretches (text, on) that at most ``shared`` groups have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for text, marks in zip(b.column("text").to_pylist(), b.column("marks")):
                if not is_common([(m["d_at"], m["p_at"], {h["g"]: h["at"] for h in m["held"]}) for m in marks.as_py()], shared):
                    keep.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], names=["text"])

    marks = asked.select("text", F.explode("on").alias("m")).select("text", "m.hash", "m.d_at", "m.p_at").join(own, "hash")
    return marks.groupBy("text").agg(F.collect_list(F.struct("d_at", "p_at", "held")).alias("marks")).mapInArrow(run, "text string")


def leaks(documents: DataFrame, items: DataFrame, shared: int = 1) -> DataFrame:
    """``doc_id, item_id``: documents and the items that they leak.  Null and empty texts leak nothing; items without passage are not leaked.

    ``shared``: stretches that more groups of equal passages have are common text.
    """
    shared_dir(documents.sparkSession)
    known = item_tokens(items)
    passages = groups(known)
    own = item_seeds(passages).checkpoint()  # counted, turned into the bit table and joined
    windows = hit_windows(documents, bit_table(own)).withColumn("win", F.monotonically_increasing_id()).checkpoint()  # read for its places and for its tokens
    places = windows.select("win", F.explode("hits").alias("h")).select("win", "h.hash", "h.d_at")
    few = own.filter(F.size("held") <= shared).select("hash", F.col("held")["g"].alias("gs"))
    direct = places.join(few, "hash").select("win", F.explode("gs").alias("g"), F.struct("d_at", "hash", F.lit(True).alias("few")).alias("h"))
    direct = direct.groupBy("win", "g").agg(F.collect_list("h").alias("hits"))  # at most the places of a window
    both = direct.unionByName(shared_hits(places, own.filter(F.size("held") > shared), shared))
    hits = both.groupBy("win", "g").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    pairs = hits.join(windows.select("win", "doc_id", "toks"), "win")
    found = aligned(pairs, passages, shared).withColumn("text", F.sha2(F.to_json("on"), 256)).checkpoint()  # read for the stretches to look up and for the rest
    asked = found.filter("text IS NOT NULL").groupBy("text").agg(F.first("on").alias("on"))
    cases = found.filter("text IS NULL").select("doc_id", "g").unionByName(found.join(not_common(asked, own, shared), "text").select("doc_id", "g"))
    members = known.select("item_id", "same").join(known.groupBy("same").agg(F.min("item_id").alias("g")), "same").select("item_id", "g")
    return cases.join(members, "g").select("doc_id", "item_id").distinct()


def leak_counts(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item, how many documents leak it (0 where none does)."""
    n = leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id", "task_name").join(n, "item_id", "left").select("item_id", "task_name", F.coalesce("n", F.lit(0)).alias("documents"))
