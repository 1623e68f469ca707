"""Continuous periods and gaps of overlapping intervals.

The aggregate of a key is a list of sorted disjoint intervals, reduced in a tree: one list per key and batch of input before the
shuffle; after it the lists of a key are merged two by two, linearly, those of like length first; a key of very many rows is
cut into stretches of time (slots) whose lists stay apart, and what the earlier slots cover is carried in.  The complement of the
lists are the gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import SECOND, micros
from tidemark.operators.skew import TARGET, hot_cuts, slotted

OPEN = 2**63 - 1
KEY = ["subject_id", "predicate"]
LISTS = "subject_id string, predicate string, slot int, froms array<bigint>, untils array<bigint>"


def validity(facts: DataFrame) -> DataFrame:
    """``subject_id (lower case), predicate, from_us, until_us`` of live facts that cover anything.

    A null valid_until is OPEN.  Facts with null subject, predicate or valid_from, or that end at or before their start, cover nothing.
    """
    rows = facts.filter(F.col("deleted_at").isNull()).select(F.lower("subject_id").alias("subject_id"), "predicate", micros("valid_from").alias("from_us"), F.when(F.col("valid_until").isNull(), F.lit(OPEN)).otherwise(micros("valid_until")).alias("until_us"))
    return rows.dropna(subset=[*KEY, "from_us"]).filter("until_us > from_us")


def _disjoint(gid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted disjoint intervals of each group; touching ones are one.  Expects any order."""
    order = np.lexsort((start, gid))
    gid, start, end = gid[order], start[order], end[order]
    reach = pd.Series(end).groupby(gid).cummax().to_numpy()
    new = np.r_[True, (gid[1:] != gid[:-1]) | (start[1:] > reach[:-1])] if len(gid) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return gid[first], start[first], reach[np.r_[first[1:], len(gid)] - 1]


def _table(keys: pa.Table, gid: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    ends = np.r_[0, np.cumsum(np.bincount(gid, minlength=keys.num_rows))].astype(np.int32)
    return keys.append_column("froms", pa.ListArray.from_arrays(ends, pa.array(start))).append_column("untils", pa.ListArray.from_arrays(ends, pa.array(end)))


def _codes(t: pa.Table) -> tuple[np.ndarray, pa.Table]:
    code = np.zeros(t.num_rows, np.int64)
    for c in [*KEY, "slot"]:
        d = t.column(c).combine_chunks().dictionary_encode()
        code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    _, first, gid = np.unique(code, return_index=True, return_inverse=True)
    return gid, t.select([*KEY, "slot"]).take(first)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            gid, keys = _codes(pa.Table.from_batches([b]))
            yield from _table(keys, *_disjoint(gid, b.column("from_us").to_numpy(), b.column("until_us").to_numpy())).to_batches()


def merge_lists(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The union of two lists of sorted disjoint intervals (froms, untils), in one pass over both; touching ones are one."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    if not len(b[0]):
        return a
    # the shorter list's places in the longer one, then one running maximum over what is already in order
    place = np.searchsorted(a[0], b[0], side="right") + np.arange(len(b[0]))
    own = np.ones(len(a[0]) + len(b[0]), bool)
    own[place] = False
    start, end = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    start[place], end[place] = b
    start[own], end[own] = a
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[first], reach[np.r_[first[1:], len(start)] - 1]


class Tree:
    """Lists of one key, merged as soon as two of like length are there, so that each interval is moved a logarithmic number of times."""

    def __init__(self) -> None:
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, froms: np.ndarray, untils: np.ndarray) -> None:
        new = (froms, untils)
        while self.lists and len(self.lists[-1][0]) <= 2 * len(new[0]):
            new = merge_lists(self.lists.pop(), new)
        self.lists.append(new)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.lists.pop()
        while self.lists:
            out = merge_lists(self.lists.pop(), out)
        return out


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists sorted by key to one list per key.  The last key of what came so far waits in a tree for more."""
    tree, waiting = Tree(), None

    def done() -> Iterator[pa.RecordBatch]:
        froms, untils = tree.whole()
        yield from _table(waiting, np.zeros(len(froms), np.int64), froms, untils).to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        gid, keys = _codes(t)
        froms, untils = t.column("froms").combine_chunks(), t.column("untils").combine_chunks()
        row = np.repeat(np.arange(t.num_rows), np.diff(froms.offsets.to_numpy()))
        key, start, end = _disjoint(gid[row], froms.flatten().to_numpy(), untils.flatten().to_numpy())
        ends = np.r_[0, np.cumsum(np.bincount(key, minlength=keys.num_rows))]
        part = lambda k: (start[ends[k] : ends[k + 1]], end[ends[k] : ends[k + 1]])
        first, last = int(gid[0]), int(gid[-1])
        if waiting is not None and waiting.to_pylist() != keys.slice(first, 1).to_pylist():
            yield from done()
        waiting = keys.slice(first, 1)
        tree.add(*part(first))
        if last != first:
            yield from done()
            between = pa.array(~np.isin(np.arange(keys.num_rows), (first, last)))
            yield from _table(keys, key, start, end).filter(between).to_batches()
            waiting = keys.slice(last, 1)
            tree.add(*part(last))
    if waiting is not None:
        yield from done()


def interval_lists(rows: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """``subject_id, predicate, slot, froms, untils``: the reduced list of each key, of hot keys one per slot (from 1 up)."""
    rows = slotted(rows, KEY, "from_us", cuts)
    lists = rows.select(*KEY, "slot", "from_us", "until_us").mapInArrow(_partial, LISTS)
    return lists.repartition(*KEY, "slot").sortWithinPartitions(*KEY, "slot").mapInArrow(_combine, LISTS)


def carried(lists: DataFrame) -> DataFrame:
    """The lists of hot keys with ``carry``: how far the earlier slots of the key cover (null in the first).

    One summary row per slot goes through the window; the join back is by key and slot, which are unique.
    """
    tops = lists.filter("slot > 0").select(*KEY, "slot", F.element_at("untils", -1).alias("reach"))
    w = Window.partitionBy(*KEY).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return lists.filter("slot > 0").join(tops.select(*KEY, "slot", F.max("reach").over(w).alias("carry")), [*KEY, "slot"])


def gaps_of(lists: DataFrame, has_hot: bool, min_gap_us: int = SECOND) -> DataFrame:
    """Complements: ``subject_id, predicate, gap_from_us, gap_until_us`` of gaps of at least ``min_gap_us``."""
    lists = lists.filter("slot = 0").withColumn("carry", F.lit(None).cast("bigint")).unionByName(carried(lists)) if has_hot else lists.withColumn("carry", F.lit(None).cast("bigint"))
    # greatest() skips nulls: without carry the first interval has no gap before it, and its null start drops out below
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice("untils", 1, F.size("untils") - 1))
    each = lists.select(*KEY, "carry", F.explode(F.arrays_zip(before.alias("b"), F.col("froms").alias("f"))).alias("x"))
    each = each.select(*KEY, F.greatest("carry", "x.b").alias("gap_from_us"), F.col("x.f").alias("gap_until_us"))
    return each.filter(F.col("gap_until_us") - F.col("gap_from_us") >= F.lit(min_gap_us))


def periods_of(lists: DataFrame, has_hot: bool) -> DataFrame:
    """Continuous periods ``subject_id, predicate, from_us, until_us`` (OPEN: without end)."""
    plain = lists.filter("slot = 0").select(*KEY, F.explode(F.arrays_zip("froms", "untils")).alias("x")).select(*KEY, F.col("x.froms").alias("from_us"), F.col("x.untils").alias("until_us"))
    if not has_hot:
        return plain
    # Within a slot all periods but the last are final; the last one ends where the next slot with a new start begins.
    own = carried(lists).withColumn("parts", F.arrays_zip("froms", "untils"))
    fresh = lambda x: F.col("carry").isNull() | (x["froms"] > F.col("carry"))
    own = own.select(*KEY, "slot", F.filter("parts", fresh).alias("starts"), F.greatest("carry", F.array_max(F.transform(F.filter("parts", lambda x: ~fresh(x)), lambda x: x["untils"]))).alias("lead_end"), F.greatest("carry", F.element_at("untils", -1)).alias("reach"))
    done = own.select(*KEY, F.explode(F.slice("starts", 1, F.greatest(F.size("starts") - 1, F.lit(0)))).alias("x")).select(*KEY, F.col("x.froms").alias("from_us"), F.col("x.untils").alias("until_us"))
    w = Window.partitionBy(*KEY).orderBy("slot")
    ahead, all_ = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = F.coalesce(F.first(F.when(F.size("starts") > 0, F.col("lead_end")), ignorenulls=True).over(ahead), F.max("reach").over(all_))
    last = own.withColumn("until_us", ends).filter(F.size("starts") > 0).select(*KEY, F.element_at("starts", -1)["froms"].alias("from_us"), "until_us")
    return plain.unionByName(done).unionByName(last)


def found(facts: DataFrame, target: int = TARGET) -> DataFrame:
    """Gaps of at least a second.  Pairs of more than ``target`` rows are cut into slots of about as many."""
    rows = validity(facts)
    cuts = hot_cuts(rows, KEY, "from_us", facts.count(), target)
    return gaps_of(interval_lists(rows, cuts), cuts is not None)


def periods(facts: DataFrame, target: int = TARGET) -> DataFrame:
    """``until_us`` is null where the period has no end."""
    rows = validity(facts)
    cuts = hot_cuts(rows, KEY, "from_us", facts.count(), target)
    return periods_of(interval_lists(rows, cuts), cuts is not None).withColumn("until_us", F.nullif("until_us", F.lit(OPEN)))
