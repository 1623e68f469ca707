"""Queries of the general problems 1, 2, 3 and 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import deliveries, intervals, late_events, references
from tidemark.sources.tables import table


def _refs(op):
    return lambda s, d: op(table(s, d, "loom_facts"), table(s, d, "loom_entities"), table(s, d, "loom_episodes"))


def _of(name, op):
    return lambda s, d: op(table(s, d, name))


STORED_UNTIL = "2025-06-15 00:00:00"


def new_batches(s, d):
    """Messages delivered from STORED_UNTIL on that were not delivered before."""
    t = table(s, d, "loom_new_episodes")
    at = F.lit(STORED_UNTIL).cast("timestamp_ntz")
    return deliveries.new_messages(t.filter(F.col("delivered_at") >= at), t.filter(F.col("delivered_at") < at)).select("delivery_id", "batch_id")


QUERIES = {
    "p1_found": _of("loom_episodes", late_events.found),
    "p1_corrected_counts": _of("loom_episodes", late_events.corrected_counts),
    "p1_diverted": _of("loom_episodes", late_events.diverted_counts),
    "p1_watermark_counts": _of("loom_episodes", late_events.watermark_counts),
    "p2_found": _refs(references.found),
    "p2_by_table_and_day": _refs(references.by_table_and_day),
    "p3_found": _of("loom_new_episodes", deliveries.found),
    "p3_kept_per_batch": _of("loom_new_episodes", deliveries.kept_per_batch),
    "p3_new_batches": new_batches,
    "p5_found": _of("loom_facts", intervals.found),
    "p5_periods": _of("loom_facts", intervals.periods),
}

_EP = """
WITH e AS (
  SELECT lower(id) AS id, arg_min(namespace, ingested_at) AS namespace, arg_min(occurred_at, ingested_at) AS occ, min(ingested_at) AS arr
  FROM loom_episodes WHERE deleted_at IS NULL AND id IS NOT NULL AND occurred_at IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1),
c AS (SELECT namespace, date_trunc('day', occ)::DATE AS day, arr, arr - (date_trunc('day', occ) + INTERVAL 1 DAY) AS late FROM e),
s AS (SELECT *, CASE WHEN late < INTERVAL 0 SECOND THEN 'on_time' WHEN late < INTERVAL 72 HOUR THEN 'correction' ELSE 'diverted' END AS state FROM c)
"""
_REFS = """
WITH f AS (SELECT * FROM loom_facts WHERE deleted_at IS NULL),
r AS (
  SELECT id AS fact_id, 'subject_id' AS field, 'loom_entities' AS ref_table, lower(subject_id) AS ref_id, created_at AS made FROM f
  UNION ALL SELECT id, 'object_id', 'loom_entities', lower(object_id), created_at FROM f
  UNION ALL SELECT id, 'superseded_by', 'loom_facts', lower(superseded_by), created_at FROM f
  UNION ALL SELECT id, 'source_episodes', 'loom_episodes', lower(unnest(source_episodes)), created_at FROM f),
p AS (
  SELECT 'loom_entities' AS ref_table, lower(id) AS ref_id, deleted_at IS NULL AS live, created_at AS rec FROM loom_entities
  UNION ALL SELECT 'loom_episodes', lower(id), deleted_at IS NULL, ingested_at FROM loom_episodes
  UNION ALL SELECT 'loom_facts', lower(id), deleted_at IS NULL, NULL FROM loom_facts),
k AS (SELECT ref_table, ref_id, bool_or(live) AS live, min(rec) FILTER (WHERE live) AS rec FROM p GROUP BY 1, 2),
o AS (
  SELECT DISTINCT r.*, CASE WHEN k.live IS NULL THEN 'missing' WHEN NOT k.live THEN 'deleted' WHEN k.rec > r.made THEN 'late' END AS state
  FROM r LEFT JOIN k USING (ref_table, ref_id) WHERE r.ref_id IS NOT NULL)
"""
_MSG = r"""
WITH m AS (
  SELECT delivery_id, batch_id, delivered_at, namespace, source,
    coalesce('e:' || nullif(regexp_replace(source_event_id, '^\s+|\s+$', '', 'g'), ''),
             'h:' || coalesce(regexp_replace(lower(content_hash), '^sha256:', ''), sha256(content)), 'd:' || delivery_id::VARCHAR) AS ident
  FROM loom_new_episodes),
k AS (SELECT *, row_number() OVER (PARTITION BY namespace, source, ident ORDER BY delivered_at NULLS LAST, delivery_id) AS rn FROM m)
"""
_COVER = """
WITH v AS (
  SELECT lower(subject_id) AS subject_id, predicate, epoch_us(valid_from) AS a, coalesce(epoch_us(valid_until), 9223372036854775807) AS b
  FROM loom_facts WHERE deleted_at IS NULL AND subject_id IS NOT NULL AND predicate IS NOT NULL AND valid_from IS NOT NULL),
w AS (SELECT *, max(b) OVER (PARTITION BY subject_id, predicate ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v WHERE b > a)
"""
ORACLES = {
    "p1_found": _EP + "SELECT DISTINCT namespace, strftime(day, '%Y-%m-%d') AS period, strftime(arr, '%Y-%m-%d') AS report_day FROM s WHERE state = 'correction'",
    "p1_corrected_counts": _EP + """
        , g AS (SELECT namespace, day, CASE WHEN state = 'correction' THEN arr::DATE END AS rep, count(*) AS added FROM s WHERE state <> 'diverted' GROUP BY ALL)
        SELECT namespace, strftime(day, '%Y-%m-%d') AS period, strftime(rep, '%Y-%m-%d') AS report_day, added,
          (sum(added) OVER (PARTITION BY namespace, day ORDER BY rep NULLS FIRST))::BIGINT AS episodes FROM g""",
    "p1_diverted": _EP + "SELECT namespace, strftime(day, '%Y-%m-%d') AS period, count(*) AS diverted, epoch_us(max(arr)) AS last_arrival_us FROM s WHERE state = 'diverted' GROUP BY namespace, day",
    "p1_watermark_counts": """
        WITH e AS (
          SELECT lower(id) AS id, arg_min(namespace, ingested_at) AS namespace, epoch_us(arg_min(occurred_at, ingested_at)) AS ev, epoch_us(min(ingested_at)) AS ar, arg_min(coalesce(source, ''), ingested_at) AS source
          FROM loom_episodes WHERE deleted_at IS NULL AND id IS NOT NULL AND occurred_at IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1),
        r AS (SELECT *, ev - (ev % 86400000000 + 86400000000) % 86400000000 AS per FROM e),
        sp AS (SELECT source, per, per + 86400000000 AS fin FROM (SELECT DISTINCT source FROM r), (SELECT DISTINCT per FROM r)),
        m AS (SELECT sp.source, sp.per, min(ar) AS t FROM sp JOIN r ON r.source = sp.source AND least(ev, ar) - 6 * 3600000000 >= fin GROUP BY 1, 2),
        z AS (SELECT source, ar AS seen, coalesce(lead(ar) OVER (PARTITION BY source ORDER BY ar), 4611686018427387904) AS nxt FROM r),
        q AS (SELECT sp.source, sp.per, min(greatest(seen + 12 * 3600000000, fin)) AS t FROM sp JOIN z ON z.source = sp.source AND nxt - seen > 12 * 3600000000 AND nxt > fin GROUP BY 1, 2),
        x AS (SELECT sp.per, CASE WHEN m.t IS NULL THEN q.t WHEN q.t IS NULL THEN m.t ELSE least(m.t, q.t) END AS t FROM sp LEFT JOIN m USING (source, per) LEFT JOIN q USING (source, per)),
        c AS (SELECT per, CASE WHEN count(t) = count(*) THEN max(t) END AS closed_us FROM x GROUP BY 1),
        s AS (SELECT namespace, per, closed_us, CASE WHEN closed_us IS NULL OR ar < closed_us THEN 'on_time' WHEN ar - closed_us < 72 * 3600000000 THEN 'correction' ELSE 'diverted' END AS state FROM r JOIN c USING (per))
        SELECT namespace, strftime(make_timestamp(per), '%Y-%m-%d') AS period, closed_us, count(*) FILTER (WHERE state = 'on_time') AS on_time,
          count(*) FILTER (WHERE state = 'correction') AS correction, count(*) FILTER (WHERE state = 'diverted') AS diverted FROM s GROUP BY namespace, per, closed_us""",
    "p2_found": _REFS + "SELECT DISTINCT fact_id, field, ref_id FROM o WHERE state IS NOT NULL",
    "p2_by_table_and_day": _REFS + """SELECT ref_table, strftime(made, '%Y-%m-%d') AS day, state, count(*) AS orphans
        FROM (SELECT DISTINCT fact_id, field, ref_table, ref_id, made, state FROM o) WHERE state IS NOT NULL GROUP BY ALL""",
    "p3_found": _MSG + "SELECT delivery_id FROM k WHERE rn > 1",
    "p3_kept_per_batch": _MSG + "SELECT batch_id, count(*) AS deliveries, count(*) FILTER (WHERE rn = 1) AS kept FROM k GROUP BY 1",
    "p3_new_batches": _MSG + f"SELECT delivery_id, batch_id FROM k WHERE rn = 1 AND delivered_at >= TIMESTAMP '{STORED_UNTIL}'",
    "p5_found": _COVER + "SELECT subject_id, predicate, reach AS gap_from_us, a AS gap_until_us FROM w WHERE a - reach >= 1000000",
    "p5_periods": _COVER + """
        , i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, predicate ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM w)
        SELECT subject_id, predicate, min(a) AS from_us, nullif(max(b), 9223372036854775807) AS until_us FROM i GROUP BY subject_id, predicate, island""",
}
