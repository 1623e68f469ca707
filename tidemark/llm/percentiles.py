"""Mergeable percentiles by relative-rank compactors.

A sketch holds levels; an item of level h stands for 2**h values.  A level that is over its capacity sorts itself and
compacts its lower part: of each two neighbours one, picked by a coin, goes up a level.  The upper part stays, so the rank
error shrinks towards the high percentiles.  Sketches of partitions or days are merged level by level.

Each level records how many compactions it made, their schedule and the greatest value that took part.  For a value v only
compactions at or above v can shift its rank, each by at most 2**h up or down with mean zero.  The stated bound of an answer is the lesser of
their sum, which is certain, and Hoeffding's sqrt(2 ln(2/delta) * sum of squares), which fails with probability ``DELTA`` at most.

All work is done per Arrow batch over many groups at once with numpy; Spark partitions, sorts and shuffles.  Coins depend on the data
of a chunk and fixed seeds.  Where a chunk ends follows the order in which shuffle blocks arrive, so a task that is run again may
give another sketch of the same rows; each is as good as the other, and the stated bound holds for either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION = 32
DELTA = 1e-6
CHUNK = 400_000  # rows sketched at once
HELD = 2_000_000  # items a task holds before it hands its sketches on
BIG = 50_000  # values in a sketch from which on its group is merged by lanes first
LANES = 64
STATE = "n bigint, sizes array<int>, items array<bigint>, made array<bigint>, plan array<bigint>, top array<bigint>"
NONE = np.iinfo(np.int64).min


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser: coins depend on data only."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Sketches:
    """Sketches of ``groups`` groups: flat items (gid, level, value) and per group and level the three records."""

    def __init__(self, groups: int, gid: np.ndarray, level: np.ndarray, value: np.ndarray, n: np.ndarray, section: int = SECTION):
        self.g, self.section, self.n = groups, section, n.astype(np.int64)
        self.gid, self.level, self.value = gid.astype(np.int64), level.astype(np.int64), value.astype(np.int64)
        # a group of n values has no more levels than these; small groups, of which a batch may have very many, have one
        most = max(1, int(self.n.max(initial=0)) // (6 * section))
        self.levels = max(most.bit_length() + 2, int(self.level.max(initial=0)) + 2) if most > 1 or self.level.any() else 1
        self.made = np.zeros((groups, self.levels), np.int64)
        self.plan = np.zeros((groups, self.levels), np.int64)
        self.top = np.full((groups, self.levels), NONE, np.int64)

    def compact(self) -> Sketches:
        """Bring every level to its capacity, from the lowest up."""
        k = self.section
        sections = np.maximum(3, np.ceil(np.log2(np.maximum(self.n, 1) / k)).astype(np.int64))
        cap = 2 * k * sections
        for h in range(64):
            at = self.level == h
            count = np.bincount(self.gid[at], minlength=self.g)
            if not (over := count > cap).any():
                if not (self.level > h).any():
                    break
                continue
            if h + 1 >= self.levels:
                grow = lambda m, fill: np.hstack([m, np.full((self.g, 1), fill, np.int64)])
                self.made, self.plan, self.top, self.levels = grow(self.made, 0), grow(self.plan, 0), grow(self.top, NONE), self.levels + 1
            pick = np.flatnonzero(at & over[self.gid])
            pick = pick[np.lexsort((self.value[pick], self.gid[pick]))]
            g = self.gid[pick]
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            groups, counts = g[starts], np.diff(np.r_[starts, len(g)])
            plan = self.plan[groups, h]
            ones = np.zeros(len(groups), np.int64)  # trailing ones of the schedule say how many sections take part
            for bit in range(16):
                ones += (ones == bit) & ((plan >> bit) & 1 == 1)
            length = np.minimum((ones + 1) * k, cap[groups] // 2)
            take = (counts - (cap[groups] - length)) // 2 * 2
            place = np.arange(len(g)) - np.repeat(starts, counts)
            low = place < np.repeat(take, counts)
            last = self.value[pick][starts + take - 1]
            coin = (_mix(_mix(self.made[groups, h].astype(np.uint64) + np.uint64(h << 40)) ^ last.astype(np.uint64) ^ (self.value[pick][starts].astype(np.uint64) << np.uint64(20)) ^ (self.n[groups].astype(np.uint64) << np.uint64(7))) & np.uint64(1)).astype(np.int64)
            up = low & (place % 2 == np.repeat(coin, counts))
            keep = np.ones(len(self.gid), bool)
            keep[pick[low & ~up]] = False
            self.level[pick[up]] += 1
            self.gid, self.level, self.value = self.gid[keep], self.level[keep], self.value[keep]
            self.made[groups, h] += 1
            self.plan[groups, h] += 1
            self.top[groups, h] = np.maximum(self.top[groups, h], last)
        return self

    def arrays(self) -> list[pa.Array]:
        """The columns of STATE."""
        order = np.lexsort((self.value, self.level, self.gid))
        gid, level = self.gid[order], self.level[order]
        sizes = np.zeros((self.g, self.levels), np.int64)
        np.add.at(sizes, (gid, level), 1)
        height = np.maximum(1, self.levels - np.argmax(((sizes > 0) | (self.made > 0))[:, ::-1], axis=1))
        used = np.arange(self.levels) < height[:, None]
        ends = np.r_[0, np.cumsum(height)].astype(np.int32)
        per_level = lambda m, kind: pa.ListArray.from_arrays(ends, pa.array(m[used], kind))
        items = pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.bincount(gid, minlength=self.g))].astype(np.int32), pa.array(self.value[order]))
        return [pa.array(self.n), per_level(sizes, pa.int32()), items, per_level(self.made, pa.int64()), per_level(self.plan, pa.int64()), per_level(self.top, pa.int64())]


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and flat values of a list column."""
    return np.diff(col.offsets.to_numpy()), col.flatten().to_numpy(zero_copy_only=False)


def load(batch: pa.RecordBatch | pa.Table, gid: np.ndarray, groups: int) -> Sketches:
    """The merge of the batch's sketches per group; capacities are not yet restored."""
    col = lambda c: x.combine_chunks() if isinstance(x := batch.column(c), pa.ChunkedArray) else x
    heights, sizes = _lists(col("sizes"))
    _, values = _lists(col("items"))
    row = np.repeat(np.arange(len(heights)), heights)
    level = np.arange(len(sizes)) - np.repeat(np.cumsum(heights) - heights, heights)
    n = np.zeros(groups, np.int64)
    np.add.at(n, gid, col("n").to_numpy())
    s = Sketches(groups, np.repeat(gid[row], sizes), np.repeat(level, sizes), values, n)
    if (short := int(level.max(initial=0)) + 1 - s.levels) > 0:
        s.made, s.plan, s.top = (np.hstack([m, np.full((groups, short), fill, np.int64)]) for m, fill in ((s.made, 0), (s.plan, 0), (s.top, NONE)))
        s.levels += short
    np.add.at(s.made, (gid[row], level), _lists(col("made"))[1])
    np.bitwise_or.at(s.plan, (gid[row], level), _lists(col("plan"))[1])
    np.maximum.at(s.top, (gid[row], level), _lists(col("top"))[1])
    return s


def _groups(t: pa.Table, by: list[str]) -> tuple[np.ndarray, pa.Table]:
    """Group number of each row, and the groups' keys in that order (nulls are a value)."""
    code = np.zeros(t.num_rows, np.int64)
    for c in by:
        d = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    _, first, gid = np.unique(code, return_index=True, return_inverse=True)
    return gid, t.select(by).take(first)


def _merged(t: pa.Table, by: list[str]) -> pa.Table:
    gid, keys = _groups(t, by)
    s = load(t, gid, keys.num_rows).compact()
    return pa.Table.from_arrays([c.combine_chunks() for c in keys.columns] + s.arrays(), names=by + [f.split()[0] for f in STATE.split(", ")])


def sketch(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sketches per group and input partition, the map-side half.  ``value`` is an integer column without nulls.

    Rows are sketched in chunks of a fixed number.  Chunks are merged as they come; when the groups of a task hold more than HELD items,
    their sketches are handed on and it starts anew, so that neither a hot group nor very many groups are held as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.Table:
            t = pa.Table.from_batches(held)
            gid, keys = _groups(t, by)
            s = Sketches(keys.num_rows, gid, np.zeros(len(gid)), t.column(value).combine_chunks().cast(pa.int64()).to_numpy(zero_copy_only=False), np.bincount(gid, minlength=keys.num_rows))
            s.compact()
            return pa.Table.from_arrays([c.combine_chunks() for c in keys.columns] + s.arrays(), names=by + [f.split()[0] for f in STATE.split(", ")])

        held, size, kept = [], 0, None

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, kept
            kept = flush() if kept is None else _merged(pa.concat_tables([kept, flush()]), by)
            held, size = [], 0
            if kept.num_rows + pc.sum(pc.list_value_length(kept.column("items"))).as_py() > HELD:
                yield from kept.to_batches(max_chunksize=10_000)
                kept = None

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CHUNK:
                yield from settle()
        if size:
            yield from settle()
        if kept is not None:
            yield from kept.to_batches(max_chunksize=10_000)

    rows = rows.select(*by, value)
    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema[: len(by)])}, {STATE}")


def merge(sketches: DataFrame, by: list[str], lanes: int = 1) -> DataFrame:
    """One sketch per group of ``by`` from any number of sketches: shuffled and sorted by group, merged as they stream by.

    With ``lanes``, a reduction tree: sketches of BIG and more values are first merged within lanes, which are shares of the input
    partitions, so that the many sketches of a hot group do not all reach one task.
    """
    names = by + [f.split()[0] for f in STATE.split(", ")]
    if lanes > 1:
        lane = F.when(F.col("n") >= BIG, F.pmod(F.spark_partition_id(), F.lit(lanes))).otherwise(F.lit(-1))
        return merge(merge(sketches.select(*names, lane.alias("__lane")), [*by, "__lane"]), by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last group of what came so far may go on
        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            m = _merged(t, by)
            last = [c[-1].as_py() for c in t.select(by).columns]
            open_ = np.ones(m.num_rows, bool)
            for c, v in zip(by, last):
                open_ &= np.array([x == v for x in m.column(c).to_pylist()])
            rest = m.filter(pa.array(open_))
            yield from m.filter(pa.array(~open_)).to_batches()
        if rest is not None:
            yield from rest.to_batches()

    rows = sketches.select(*names).repartition(*by).sortWithinPartitions(*by)
    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema[: len(by)])}, {STATE}")


def quantiles(sketches: DataFrame, by: list[str], qs: list[float]) -> DataFrame:
    """Per sketch and q: ``n``, ``value`` (of rank ceil(q n)), ``rank_error``, the bound on its rank as a share of n, and ``tail_error``, the
    same bound as a share of the (1 - q) n values above, which is what relative-rank compactors keep small at high percentiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.num_rows
            s = load(b, np.arange(rows), rows)
            order = np.lexsort((s.value, s.gid))
            gid, value = s.gid[order], s.value[order]
            run_w = np.cumsum(np.int64(1) << s.level[order])
            base = np.r_[0, np.cumsum(s.n)][:-1]
            out = []
            for q in qs:
                rank = np.clip(np.ceil(q * s.n - 1e-9).astype(np.int64), 1, None)
                v = value[np.minimum(np.searchsorted(run_w, base + rank), len(value) - 1)]
                hit = np.where(s.top >= v[:, None], s.made, 0).astype(float)
                w = 2.0 ** np.arange(s.levels)
                bound = np.minimum((hit * w).sum(1), np.sqrt(2 * math.log(2 / DELTA) * (hit * w * w).sum(1)))
                out.append((np.full(rows, q), s.n, v, bound / np.maximum(s.n, 1), bound / np.maximum(np.floor((1 - q) * s.n), 1)))
            pick = np.tile(np.arange(rows), len(qs))
            keys = [b.column(c).take(pa.array(pick)) for c in by]
            yield pa.RecordBatch.from_arrays(keys + [pa.array(np.concatenate(x)) for x in zip(*out)], names=by + ["q", "n", "value", "rank_error", "tail_error"])

    rows = sketches.select(*by, *[f.split()[0] for f in STATE.split(", ")])
    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema[: len(by)])}, q double, n bigint, value bigint, rank_error double, tail_error double")


QS = [0.5, 0.9, 0.95, 0.99]


def measurements(log: DataFrame) -> DataFrame:
    """``namespace, primary_class, day, latency_total_ms`` of every measurement: not null, not negative, each id once.

    Ids compare without letter case; among unequal rows of an id the least counts; a row without id counts by itself.
    Null namespaces, classes and days are groups.
    """
    rows = log.filter("latency_total_ms >= 0").select(F.lower("id").alias("__id"), F.col("created_at").cast("date").alias("day"), "namespace", "primary_class", "latency_total_ms")
    once = rows.filter("__id is not null").groupBy("__id").agg(F.min(F.struct("day", "namespace", "primary_class", "latency_total_ms")).alias("r")).select("r.*")
    return once.unionByName(rows.filter("__id is null").drop("__id"))


def daily_sketches(log: DataFrame) -> DataFrame:
    """The pieces: one sketch per namespace, class and day."""
    by = ["namespace", "primary_class", "day"]
    return merge(sketch(measurements(log), by, "latency_total_ms"), by, LANES)


def latency_percentiles(log: DataFrame, qs: list[float] = QS) -> DataFrame:
    """``namespace, primary_class, q, n, value, rank_error, tail_error`` from the daily sketches put together."""
    by = ["namespace", "primary_class"]
    return quantiles(merge(daily_sketches(log), by), by, qs)


def daily_and_overall(log: DataFrame, qs: list[float] = QS) -> DataFrame:
    """``namespace, primary_class, day, q, n, value, rank_error, tail_error``: the answers of every daily piece and, with day 'all', of the pieces
    put together.  The pieces are made once; both answers read the same shuffle.  A null created_at is the day 'none'."""
    by = ["namespace", "primary_class"]
    daily = daily_sketches(log)
    each = quantiles(daily, [*by, "day"], qs).withColumn("day", F.coalesce(F.col("day").cast("string"), F.lit("none")))
    return each.unionByName(quantiles(merge(daily, by), by, qs).withColumn("day", F.lit("all")))


LIMITS = {0.5: 0.01, 0.9: 0.005, 0.95: 0.003, 0.99: 0.001}  # what a stated bound may be, as a share of n


def bound_check(log: DataFrame, qs: list[float] = QS) -> DataFrame:
    """Per group and q, whether the exact rank of the answer lies within the stated bound of q n, and whether that bound is itself within LIMITS."""
    by = ["namespace", "primary_class"]
    answers = latency_percentiles(log, qs).groupBy(*[F.col(c).alias(f"a_{c}") for c in by]).agg(F.collect_list(F.struct("q", "n", "value", "rank_error")).alias("answers"))
    same = F.col("namespace").eqNullSafe(F.col("a_namespace")) & F.col("primary_class").eqNullSafe(F.col("a_primary_class"))
    values = measurements(log).groupBy(*by, "latency_total_ms").agg(F.count(F.lit(1)).alias("c"))
    each = values.join(answers, same).select(*by, "latency_total_ms", "c", F.explode("answers").alias("a"))
    v = F.col("latency_total_ms")
    ranks = each.groupBy(*by, "a").agg(F.sum("c").alias("m"), F.sum(F.when(v < F.col("a.value"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(v <= F.col("a.value"), F.col("c")).otherwise(0)).alias("upto"))
    want, slack = F.ceil(F.col("a.q") * F.col("m") - 1e-9), F.col("a.rank_error") * F.col("m") + 1e-6
    ok = (F.col("a.n") == F.col("m")) & (F.col("below") < want + slack) & (F.col("upto") >= want - slack)
    tight = F.col("a.rank_error") <= F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv])[F.col("a.q")]
    return ranks.select(*by, F.col("a.q").alias("q"), F.col("m").alias("n"), ok.alias("within_bound"), tight.alias("tight"))
