"""Event-time periods under late and out-of-order arrival.

Every source has a low watermark: the greatest event time it has shown (never ahead of the arrival itself) less
a bound, or what its punctuations assert, whichever is further.  A period closes when every source has passed its end; a source
that has been silent for the idle timeout is not waited for.  Records after the closing and within the cut-off correct the
period, later ones are diverted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import DAY, HOUR, day_text, floor_to, micros
from tidemark.session import shared_dir

FOREVER = 2**62


def arrivals(df: DataFrame, id_col: str, event: str, arrival: str, group: str, source: str, live: Column | None = None) -> DataFrame:
    """One row per id at its earliest arrival: ``source, grp, event_us, arrival_us``.

    Ids compare without letter case.  Rows without id, event time or arrival time name no record and are left out; a null
    source is a source of its own (''); a null group stays a group.  Copies of an id at one arrival time: the least row.
    """
    if live is not None:
        df = df.filter(live)
    return (
        df.select(F.lower(id_col).alias("__id"), micros(arrival).alias("arrival_us"), micros(event).alias("event_us"), F.col(group).alias("grp"), F.coalesce(F.col(source), F.lit("")).alias("source"))
        .dropna(subset=["__id", "arrival_us", "event_us"])
        .groupBy("__id")
        .agg(F.min(F.struct("arrival_us", "event_us", "grp", "source")).alias("r"))
        .select("r.source", "r.grp", "r.event_us", "r.arrival_us")
    )


def progress(records: DataFrame, bound_us: int = 0, period_us: int = DAY, bucket_us: int = HOUR) -> DataFrame:
    """``source, k, b, period_us, first_us, last_us``: the records reduced to all that closings ask of them, in one pass.

    One row per source, period of the mark (k), bucket of the arrival (b) and period of the event, with the first and last arrival; a source
    with a third of all rows costs no more than any other.  The table is small and read several times, so it is kept in the shared folder.
    """
    shared_dir(records.sparkSession)
    mark = F.least("event_us", "arrival_us") - F.lit(bound_us)
    by = ["source", floor_to(mark, period_us).alias("k"), floor_to(F.col("arrival_us"), bucket_us).alias("b"), floor_to(F.col("event_us"), period_us).alias("period_us")]
    return records.groupBy(*by).agg(F.min("arrival_us").alias("first_us"), F.max("arrival_us").alias("last_us")).checkpoint()


def mark_passes(seen: DataFrame) -> DataFrame:
    """``source, k, pass_us``: when the low watermark of a source was first shown to lie in the period beginning at k.

    The mark reaches an end with the first arrival whose own event time, less the bound, does.  Ends are multiples of the period, so the
    earliest arrival per source and period of the mark is exact.
    """
    return seen.groupBy("source", "k").agg(F.min("first_us").alias("pass_us"))


def silences(seen: DataFrame, idle_us: int) -> DataFrame:
    """``source, at_us, next_us``: consecutive arrivals of a source that are more than ``idle_us`` apart; next_us is FOREVER after the last.

    Buckets are no longer than the timeout, so none hides a silence.
    """
    buckets = seen.groupBy("source", "b").agg(F.max("last_us").alias("at_us"), F.min("first_us").alias("first_us"))
    w = Window.partitionBy("source").orderBy("at_us")
    return buckets.select("source", "at_us", F.coalesce(F.lead("first_us").over(w), F.lit(FOREVER)).alias("next_us")).filter(F.col("next_us") - F.col("at_us") > F.lit(idle_us))


def calendar_punctuations(records: DataFrame, period_us: int = DAY, delay_us: int = 0) -> DataFrame:
    """``source, asserted_us, at_us``: every source asserts, ``delay_us`` after the end of each period of ``records``, that it is through with it.

    One row per source and period, as a stream of punctuations carries them; the periods are a calendar, one array of days.
    """
    return _calendar(progress(records, 0, period_us), period_us, delay_us)


def _calendar(seen: DataFrame, period_us: int, delay_us: int) -> DataFrame:
    ends = seen.select(F.collect_set(F.col("period_us") + F.lit(period_us))).scalar()
    return seen.select("source").distinct().select("source", F.explode(ends).alias("asserted_us")).withColumn("at_us", F.col("asserted_us") + F.lit(delay_us))


def closings(records: DataFrame, period_us: int = DAY, bound_us: int | None = None, punctuations: DataFrame | None = None, idle_us: int | None = None, bucket_us: int = HOUR) -> DataFrame:
    """``period_us, closed_us`` of every period in ``records``; null while a source holds it open.

    ``bound_us``: how far events may run behind the newest of their source (null: no watermark from records).
    ``punctuations``: rows (source, asserted_us, at_us): at at_us the source says it is through with everything before asserted_us.
    ``idle_us``: silence after which a source is passed over (null: never).

    A source passes an end E at min(mark, max(silence, E)): the earliest time its mark or a punctuation reached E, or E itself once it is
    silent.  Both times are constant between two marks of the source and never less for a later end, so the steps of all sources can be
    pooled: the closing of E is the greatest over all steps that begin before E.  As min(a, max(b, E)) = max(min(a, b), min(a, E)), two
    running maxima over the steps, one row per period, suffice; no source is held against every period.
    """
    seen = progress(records, bound_us or 0, period_us, min(bucket_us, idle_us or bucket_us))
    if punctuations is not None:  # only the words of sources that have records count
        punctuations = punctuations.select("source", "asserted_us", "at_us").dropna().join(seen.select("source").distinct(), "source", "left_semi")
    return _closings(seen, period_us, bound_us is not None, punctuations, idle_us)


def _closings(seen: DataFrame, period_us: int, marked: bool, punctuations: DataFrame | None, idle_us: int | None) -> DataFrame:
    end, forever = F.col("period_us") + F.lit(period_us), F.lit(FOREVER)
    none = F.lit(None).cast("bigint")
    streams = []
    if marked:
        streams.append(mark_passes(seen).select("source", "k", "pass_us", none.alias("idle_us")))
    if idle_us is not None:
        # a silence [at + idle, next) passes every end before its own end, hence k = next - 1
        streams.append(silences(seen, idle_us).select("source", (F.col("next_us") - 1).alias("k"), none.alias("pass_us"), (F.col("at_us") + F.lit(idle_us)).alias("idle_us")))
    if not streams:  # a source without any word holds all open: its row at k = -FOREVER is passed by nothing
        streams.append(seen.select("source").distinct().select("source", (-forever).alias("k"), none.alias("pass_us"), none.alias("idle_us")))
    if punctuations is not None:
        streams.append(punctuations.select("source", floor_to(F.col("asserted_us"), period_us).alias("k"), F.col("at_us").alias("pass_us"), none.alias("idle_us")))
    rows = streams[0]
    for more in streams[1:]:
        rows = rows.unionByName(more)
    # The streams of a source are merged by k and read backwards: a step is what is still to come at or after k; it holds for ends after the k before,
    # and after the last one nothing passes.
    w = Window.partitionBy("source").orderBy(F.desc("k"))
    back, before, after = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), F.lead("k").over(w), F.lag("k").over(w)
    steps = rows.select(F.coalesce(before, -forever).alias("after_us"), F.coalesce(F.min("pass_us").over(back), forever).alias("a"), F.coalesce(F.min("idle_us").over(back), forever).alias("b"), "k", after.alias("next_k"))
    step = lambda at, x, y: F.struct(at.alias("after_us"), x.alias("a"), y.alias("b"))
    own = step(F.col("after_us"), F.col("a"), F.col("b"))
    pooled = steps.select(F.explode(F.when(F.col("next_k").isNull(), F.array(own, step(F.col("k"), forever, forever))).otherwise(F.array(own))).alias("x")).select("x.*")
    # an end E lies after a step's begin where floor(begin) + period <= E; steps are counted per period before anything is ordered
    at = F.when(F.col("after_us") <= -forever, -forever).when(F.col("after_us") >= forever - 1, forever).otherwise(floor_to(F.col("after_us"), period_us) + F.lit(period_us))
    begin = pooled.groupBy(at.alias("e")).agg(F.max(F.least("a", "b")).alias("both"), F.max("a").alias("mark")).withColumn("period_us", none)
    periods = seen.select("period_us").distinct()
    calendar = begin.unionByName(periods.select(end.alias("e"), none.alias("both"), none.alias("mark"), "period_us"))
    up = Window.orderBy("e").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # one row a day, a calendar
    done = calendar.withColumn("closed_us", F.greatest(F.max("both").over(up), F.least(F.col("e"), F.max("mark").over(up)))).filter("period_us is not null")
    return done.select("period_us", F.when(F.col("closed_us") < forever, F.col("closed_us")).alias("closed_us"))


def classify(records: DataFrame, closed: DataFrame, period_us: int = DAY, cutoff_us: int = 3 * DAY) -> DataFrame:
    """Each record with its ``period_us`` and ``state``: on_time, correction (closing <= arrival < closing + cut-off) or diverted."""
    late = F.col("arrival_us") - F.col("closed_us")
    state = F.when(late.isNull() | (late < 0), "on_time").when(late < F.lit(cutoff_us), "correction").otherwise("diverted")
    return records.withColumn("period_us", floor_to(F.col("event_us"), period_us)).join(closed, "period_us", "left").withColumn("state", state)


def revisions(classified: DataFrame) -> DataFrame:
    """``grp, period_us, report_us, added``: what each report day adds to a period; report_us is null for the first report,
    made at the closing.  Pre-aggregated by Spark before its shuffle; diverted records add nothing."""
    report = F.when(F.col("state") == "correction", floor_to(F.col("arrival_us"), DAY))
    return classified.filter("state <> 'diverted'").groupBy("grp", "period_us", report.alias("report_us")).agg(F.count(F.lit(1)).alias("added"))


BOUND, IDLE = 6 * HOUR, 12 * HOUR


def _records(episodes: DataFrame) -> DataFrame:
    return arrivals(episodes, "id", "occurred_at", "ingested_at", "namespace", "source", F.col("deleted_at").isNull())


def _by_calendar(records: DataFrame) -> DataFrame:
    """Records with their state under the punctuations of each source at every midnight, its watermark and the idle timeout.

    A mark reaches an end only after it, so where every source punctuates at the end itself, that is when the period closes.
    """
    seen = progress(records, BOUND)
    return classify(records, _closings(seen, DAY, True, _calendar(seen, DAY, 0), IDLE))


def found(episodes: DataFrame) -> DataFrame:
    """``namespace, period, report_day`` of every corrected period: calendar punctuations, 72 hours of cut-off."""
    return revisions(_by_calendar(_records(episodes))).filter("report_us is not null").select(F.col("grp").alias("namespace"), day_text("period_us").alias("period"), day_text("report_us").alias("report_day"))


def corrected_counts(episodes: DataFrame) -> DataFrame:
    """Per namespace and period, one row per report: episodes added and the corrected count so far."""
    w = Window.partitionBy("grp", "period_us").orderBy(F.asc_nulls_first("report_us"))
    return revisions(_by_calendar(_records(episodes))).select(
        F.col("grp").alias("namespace"), day_text("period_us").alias("period"), day_text("report_us").alias("report_day"),
        "added", F.sum("added").over(w).alias("episodes"),
    )


def diverted_counts(episodes: DataFrame) -> DataFrame:
    """Per namespace and period, the episodes that came after the cut-off: the side output."""
    late = _by_calendar(_records(episodes)).filter("state = 'diverted'")
    return late.groupBy("grp", "period_us").agg(F.count(F.lit(1)).alias("diverted"), F.max("arrival_us").alias("last_arrival_us")).select(
        F.col("grp").alias("namespace"), day_text("period_us").alias("period"), "diverted", "last_arrival_us")


def watermark_counts(episodes: DataFrame, bound_us: int = BOUND, idle_us: int = IDLE) -> DataFrame:
    """The same by watermarks from the records: per namespace and period the closing and on-time, corrected and diverted counts."""
    records = _records(episodes)
    rows = classify(records, closings(records, bound_us=bound_us, idle_us=idle_us))
    of = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return rows.groupBy("grp", "period_us").agg(F.max("closed_us").alias("closed_us"), of("on_time"), of("correction"), of("diverted")).select(
        F.col("grp").alias("namespace"), day_text("period_us").alias("period"), "closed_us", "on_time", "correction", "diverted")
