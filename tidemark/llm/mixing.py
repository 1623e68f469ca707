"""Mixing sources to target shares of the tokens.

The documents of a source are packed, in pseudorandom order, into one stream of tokens that is cut into blocks of fixed length.  Each
output shard draws how many of its slots go to each source from a multinomial; slots beyond a source's quota go to sources
that fell short, so that the quotas come out exactly.  The k-th slot of a source is mapped by a pseudorandom permutation of the
source's blocks, a new one for each pass, and blocks are joined by index.  A source passes over its blocks at most max_repeats times.

A source's quota is its target share of the wanted size, or max_repeats times its tokens where that is less.  What a source lacks is not
given to others: that would move their shares further away from the targets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.common import spread

from tidemark.llm.tokens import TOKENIZER, with_token_counts
from tidemark.session import shared_dir

BLOCK = 512
SEED = 11
DOCS_PER_BUCKET = 20_000
SHARD = 1024  # slots of a shard, whatever the size of the mix
LOT = 64  # shards drawn and summed together


def _source(c: str):
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size) per key: four Feistel rounds on the next even number of bits, walked until in range."""
    index, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2).astype(float)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (_mix64(right ^ k ^ np.uint64((r + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens``, tokenized once and kept in the shared folder.  A null or blank source is null."""
    shared_dir(documents.sparkSession)
    rows = documents.filter("doc_id is not null").withColumn("source", F.nullif(_source("source"), F.lit("")))
    return with_token_counts(spread(rows.select("doc_id", "source", "text"), "doc_id"), ["doc_id", "source"], tokenizer=tokenizer).checkpoint()


def packed(counts: DataFrame, n_docs: int, block: int = BLOCK, per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """``source, block, doc_id, from_token, to_token``: which tokens of which document make up each block of a source.

    Documents of a source stand in the order of a hash.  The running position is a sum per bucket, which is a range of hashes with about
    ``per_bucket`` documents, plus the sum of the buckets before it; so a source with a third of all documents is not summed in one task, and the
    blocks do not depend on the number of buckets.
    """
    bits = max(0, math.ceil(math.log2(max(1, n_docs) / per_bucket)))
    bucket = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("bigint")
    rows = counts.filter("source is not null and n_tokens > 0").withColumn("h", F.xxhash64("doc_id", F.lit(SEED))).withColumn("bucket", bucket)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s")).select("source", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id")
    ends = rows.withColumn("upto", F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))).join(base, ["source", "bucket"])
    ends = ends.select("source", "doc_id", "n_tokens", (F.col("base") + F.col("upto")).alias("end")).withColumn("start", F.col("end") - F.col("n_tokens"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)
    each = ends.withColumn("block", F.explode(F.sequence(first, last)))
    return each.select("source", "block", "doc_id", (F.greatest("start", F.col("block") * block) - F.col("start")).alias("from_token"), (F.least("end", (F.col("block") + 1) * block) - F.col("start")).alias("to_token"))


def quotas(counts: DataFrame, targets: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """``mix_name, source, target_share, max_repeats, wanted_tokens, available_tokens, blocks, slots``, one row per target.

    ``total``: tokens of all documents.  slots is the wanted size in blocks of the source's mean size, or max_repeats times its blocks
    where that is less.
    """
    have = counts.filter("source is not null").groupBy(F.col("source").alias("s")).agg(F.sum("n_tokens").alias("have"))
    wanted = (
        targets.select("mix_name", _source("source").alias("source"), "target_share", "max_repeats", "size_factor").dropna()
        .groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("size_factor").alias("size_factor"))
    )
    rows = wanted.join(have, F.col("source") == F.col("s"), "left").withColumn("available_tokens", F.coalesce("have", F.lit(0)))
    rows = rows.withColumn("wanted_tokens", F.col("target_share") * F.col("size_factor") * F.lit(total)).withColumn("blocks", F.ceil(F.col("available_tokens") / block).cast("bigint"))
    want = F.bround(F.col("wanted_tokens") * F.col("blocks") / F.col("available_tokens")).cast("bigint")
    slots_ = F.when(F.col("available_tokens") > 0, F.least(want, F.col("max_repeats") * F.col("blocks"))).otherwise(0)
    return rows.select("mix_name", "source", "target_share", "max_repeats", "wanted_tokens", "available_tokens", "blocks", slots_.cast("bigint").alias("slots"))


def drawn_counts(plan: DataFrame, shard: int = SHARD) -> DataFrame:
    """``mix_name, lot, shard, source, drawn``: the multinomial draw of every shard; shards have ``shard`` slots, the last one of a mix what is left."""
    mixes = plan.filter("slots > 0").groupBy("mix_name").agg(F.sum("slots").alias("size"), F.array_sort(F.collect_list(F.struct("source", "slots"))).alias("shares"))
    shards = F.ceil(F.col("size") / shard)
    lots = mixes.withColumn("shards", shards).withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("shards") - 1) / LOT)))).repartition("mix_name", "lot")
    rows = lots.withColumn("shard", F.explode(F.sequence(F.col("lot") * LOT, F.least(F.col("shards"), (F.col("lot") + 1) * LOT) - 1)))
    rows = rows.select("mix_name", F.xxhash64("mix_name").alias("number"), "lot", "shard", F.least(F.lit(shard), F.col("size") - F.col("shard") * shard).alias("n"), F.col("shares.source").alias("sources"), F.col("shares.slots").alias("slots"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for mix, number, lot, at, n, sources, slots_ in b.itertuples(index=False):
                p = np.asarray(slots_, float)
                c = np.random.default_rng([SEED, number & (2**63 - 1), at]).multinomial(n, p / p.sum())
                out += [(mix, lot, at, source, int(k)) for source, k in zip(sources, c) if k]
            yield pd.DataFrame(out, columns=["mix_name", "lot", "shard", "source", "drawn"])

    return rows.mapInPandas(draw, "mix_name string, lot long, shard long, source string, drawn long")


def slots(plan: DataFrame, shard: int = SHARD) -> DataFrame:
    """``mix_name, shard, source, k, block, epoch``: every slot of every shard with the block it takes."""
    drawn = drawn_counts(plan, shard)
    # how many slots a source had before a shard: before its lot, and within it
    lots = drawn.groupBy("mix_name", "source", "lot").agg(F.sum("drawn").alias("s"))
    before = Window.partitionBy("mix_name", "source").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    base = lots.select("mix_name", "source", "lot", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    w = Window.partitionBy("mix_name", "source", "lot").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    upto = drawn.withColumn("within", F.sum("drawn").over(w)).join(base, ["mix_name", "source", "lot"]).withColumn("upto", F.col("base") + F.col("within"))
    # per mix the surplus and shortfall of each source, one row per target
    known = plan.select("mix_name", "source", F.col("slots").alias("quota"), "blocks")
    sums = known.join(lots.groupBy("mix_name", "source").agg(F.sum("s").alias("got")), ["mix_name", "source"], "left").fillna(0, ["got"])
    before = Window.partitionBy("mix_name").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    over, short = F.greatest(F.col("got") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("got"), F.lit(0))
    balance = sums.select("*", F.coalesce(F.sum(over).over(before), F.lit(0)).alias("over_at"), F.coalesce(F.sum(short).over(before), F.lit(0)).alias("short_at"), short.alias("short"))
    takers = balance.filter("short > 0").groupBy("mix_name").agg(F.collect_list(F.struct("source", "got", "short_at", "short")).alias("takers"))
    each = upto.select("mix_name", "shard", "source", F.explode(F.sequence(F.col("upto") - F.col("drawn"), F.col("upto") - 1)).alias("k"))  # at most a shard's slots
    each = each.join(balance.select("mix_name", "source", "quota", "over_at"), ["mix_name", "source"]).join(takers, "mix_name", "left")
    spare = F.col("over_at") + F.col("k") - F.col("quota")
    taker = F.filter("takers", lambda t: (t["short_at"] <= spare) & (spare < t["short_at"] + t["short"]))[0]
    each = each.withColumn("t", F.when(F.col("k") >= F.col("quota"), taker))
    each = each.select("mix_name", "shard", F.coalesce("t.source", "source").alias("source"), F.when(F.col("t").isNull(), F.col("k")).otherwise(F.col("t.got") + spare - F.col("t.short_at")).alias("k"))
    each = each.join(known.select("mix_name", "source", "blocks", F.xxhash64("mix_name", "source").alias("number")), ["mix_name", "source"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            k, size = b["k"].to_numpy(), b["blocks"].to_numpy()
            epoch = k // size
            with np.errstate(over="ignore"):
                key = _mix64(b["number"].to_numpy().astype(np.uint64) + epoch.astype(np.uint64) * np.uint64(7_919) + np.uint64(SEED))
            yield b.drop(columns=["blocks", "number"]).assign(block=permuted(k % size, size, key), epoch=epoch)

    return each.select("mix_name", "shard", "source", "k", "blocks", "number").mapInPandas(place, "mix_name string, shard long, source string, k long, block long, epoch long")


def mixed(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``mix_name, shard, source, k, block, epoch, n_tokens, docs``: the mixes as blocks joined by index, and the quotas."""
    counts = token_counts(documents, tokenizer)
    total, docs = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    plan = quotas(counts, targets, total, block).checkpoint()  # one row per target, read several times
    spans = packed(counts, docs, block).groupBy("source", "block").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n_tokens"), F.array_sort(F.collect_list(F.struct("doc_id", "from_token", "to_token"))).alias("docs"))
    return slots(plan).join(spans, ["source", "block"]), plan


def mix_shares(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """The report, one row per mix and source: ``target_share, actual_share`` (of the tokens in the mix), ``share_of_wanted`` (of the
    wanted size), ``wanted_tokens, available_tokens, mixed_tokens, blocks, max_repeats, most_repeats``.

    A source without documents, or with empty ones only, has 0.  Targets with null mix, source, share or size are left out.
    """
    rows, plan = mixed(documents, targets, tokenizer, block)
    used = rows.groupBy("mix_name", "source", "block").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c"))
    got = used.groupBy("mix_name", "source").agg(F.sum("t").alias("mixed_tokens"), F.sum("c").alias("blocks"), F.max("c").alias("most_repeats"))
    known = plan.drop("blocks", "slots")
    all_ = Window.partitionBy("mix_name")
    out = known.join(got, ["mix_name", "source"], "left").fillna(0, ["mixed_tokens", "blocks", "most_repeats"])
    return out.select(
        "mix_name", "source", "target_share",
        F.coalesce(F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(all_), F.lit(0)), F.lit(0.0)).alias("actual_share"),
        F.coalesce(F.col("mixed_tokens") * F.col("target_share") / F.nullif("wanted_tokens", F.lit(0.0)), F.lit(0.0)).alias("share_of_wanted"),
        "wanted_tokens", "available_tokens", "mixed_tokens", "blocks", "max_repeats", "most_repeats",
    )


def mix_blocks(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """The mixes: ``mix_name, shard, slot, source, block, epoch, n_tokens, docs``; slots of a shard stand in pseudorandom order."""
    rows, _ = mixed(documents, targets, tokenizer, block)
    order = Window.partitionBy("mix_name", "shard").orderBy(F.xxhash64("source", "k", F.lit(SEED)), "source", "k")
    return rows.withColumn("slot", F.row_number().over(order) - 1).select("mix_name", "shard", "slot", "source", "block", "epoch", "n_tokens", "docs")
