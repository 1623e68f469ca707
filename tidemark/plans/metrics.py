"""Queries of the metrics, with SQL."""

from __future__ import annotations

from tidemark.operators import metrics as m
from tidemark.sources.tables import table

EP, EN, FA, AU, PR = "loom_episodes", "loom_entities", "loom_facts", "loom_audit_log", "loom_predicates"


def of(op, *names, **options):
    return lambda s, d: op(*[table(s, d, n) for n in names], **options)


QUERIES = {
    "episodes_by_source": of(m.episodes_by, EP, key="source"),
    "episodes_by_namespace": of(m.episodes_by, EP, key="namespace"),
    "entities_by_type": of(m.entities_by_type, EN),
    "pipeline_health": of(m.pipeline_health, EP, EN, FA),
    "current_vs_superseded": of(m.current_vs_superseded, FA),
    "latest_model": of(m.latest_model, EP),
    "daily_precision": of(m.daily_precision, AU),
    "latency_percentiles": of(m.exact_percentiles, AU),
    "extraction_by_model": of(m.extraction_by_model, EP),
    "resolution_method_counts": of(m.metric_totals, EP),
    "custom_predicate_growth": of(m.custom_predicate_growth, FA, PR),
    "confidence_buckets": of(m.confidence_buckets, AU),
    "class_distribution": of(m.class_distribution, AU),
    "parser_health": of(m.parser_health, EP),
    "ingestion_distribution": of(m.ingestion_distribution, EP),
    "seed_only_namespaces": of(m.seed_only_namespaces, EP),
    "queue_counters": of(m.queue_counters, EP),
    "completions_per_minute": of(m.completions_per_minute, EP),
    "stage_p50_last_60": of(m.stage_medians, AU),
    "kpi_nearest_rank": of(m.nearest_rank, AU),
    "fact_clusters": of(m.fact_clusters, FA),
    "extraction_metrics": of(m.extraction_metrics, FA, PR),
    "candidate_occurrences": of(m.candidate_occurrences, FA, PR),
    "predicate_usage": of(m.predicate_usage, FA, PR),
    "packs_with_counts": of(m.packs_with_counts, FA, PR),
    "condition_summary": of(m.format_summary, AU),
    "compilations_page": of(m.latest_compilations, AU),
    "namespaces_union_distinct": of(m.namespaces, EP, EN, FA, AU),
}

E_ = "WITH e AS (SELECT DISTINCT ON (lower(id)) * FROM loom_episodes WHERE deleted_at IS NULL ORDER BY lower(id), ingested_at NULLS LAST)\n"
N_ = "n AS (SELECT DISTINCT ON (lower(id)) * FROM loom_entities WHERE deleted_at IS NULL ORDER BY lower(id))\n"
F_ = "f AS (SELECT DISTINCT ON (lower(id)) * FROM loom_facts WHERE deleted_at IS NULL ORDER BY lower(id))\n"
A_ = "WITH a AS (SELECT DISTINCT ON (lower(id)) * FROM loom_audit_log ORDER BY lower(id))\n"
_PREC = "avg(CASE WHEN candidates_found > 0 THEN candidates_selected::DOUBLE / candidates_found ELSE 0 END)"
_STAGES = ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS {c.replace('latency', 'p50')}" for c in ("latency_total_ms", "latency_classify_ms", "latency_retrieve_ms", "latency_rank_ms", "latency_compile_ms"))
ORACLES = {
    "episodes_by_source": E_ + "SELECT source, count(*) AS episodes FROM e GROUP BY 1",
    "episodes_by_namespace": E_ + "SELECT namespace, count(*) AS episodes FROM e GROUP BY 1",
    "entities_by_type": "WITH " + N_ + "SELECT entity_type, count(*) AS entities FROM n GROUP BY 1",
    "pipeline_health": E_ + ", " + N_ + ", " + F_ + """
        , a AS (SELECT namespace, count(*) AS episodes, count(*) FILTER (WHERE processed) AS processed FROM e GROUP BY 1)
        , b AS (SELECT namespace, count(*) AS entities FROM n GROUP BY 1)
        , c AS (SELECT namespace, count(*) FILTER (WHERE valid_until IS NULL) AS current, count(*) FILTER (WHERE superseded_by IS NOT NULL) AS superseded FROM f GROUP BY 1)
        SELECT namespace, coalesce(episodes, 0) AS episodes, coalesce(processed, 0) AS processed, coalesce(episodes, 0) - coalesce(processed, 0) AS queue_depth,
          coalesce(entities, 0) AS entities, coalesce(current, 0) AS current, coalesce(superseded, 0) AS superseded
        FROM a FULL JOIN b USING (namespace) FULL JOIN c USING (namespace)""",
    "current_vs_superseded": "WITH " + F_ + """SELECT namespace, count(*) FILTER (WHERE valid_until IS NULL) AS current, count(*) FILTER (WHERE valid_until IS NOT NULL) AS ended,
        count(*) FILTER (WHERE superseded_by IS NOT NULL) AS replaced, count(*) FILTER (WHERE evidence_status = 'superseded') AS marked FROM f GROUP BY 1""",
    "latest_model": """WITH e AS (SELECT * FROM loom_episodes WHERE deleted_at IS NULL),
        x AS (SELECT DISTINCT ON (namespace) namespace, extraction_model FROM e WHERE extraction_model IS NOT NULL ORDER BY namespace, ingested_at DESC, extraction_model DESC),
        y AS (SELECT DISTINCT ON (namespace) namespace, classification_model FROM e WHERE classification_model IS NOT NULL ORDER BY namespace, ingested_at DESC, classification_model DESC)
        SELECT namespace, extraction_model, classification_model FROM (SELECT DISTINCT namespace FROM e) LEFT JOIN x USING (namespace) LEFT JOIN y USING (namespace)""",
    "daily_precision": A_ + f"SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS compilations, round({_PREC}, 6) AS precision FROM a GROUP BY 1",
    "latency_percentiles": A_ + """SELECT namespace, count(*) AS n, round(quantile_cont(latency_total_ms, 0.5), 6) AS p50, round(quantile_cont(latency_total_ms, 0.95), 6) AS p95,
        round(quantile_cont(latency_total_ms, 0.99), 6) AS p99 FROM a WHERE latency_total_ms >= 0 GROUP BY 1""",
    "extraction_by_model": E_ + """SELECT coalesce(extraction_model, 'unknown') AS model, count(*) AS episodes, sum((extraction_metrics->>'$.extracted')::BIGINT)::BIGINT AS extracted,
        sum((extraction_metrics->>'$.facts_extracted')::BIGINT)::BIGINT AS facts, round(avg((extraction_metrics->>'$.processing_time_ms')::BIGINT), 4) AS avg_ms
        FROM e WHERE extraction_metrics IS NOT NULL GROUP BY 1""",
    "resolution_method_counts": E_ + ", x AS (" + " UNION ALL ".join(f"SELECT namespace, '{c}' AS field, (extraction_metrics->>'$.{c}')::BIGINT AS v FROM e WHERE extraction_metrics IS NOT NULL" for c in ("extracted", "facts_extracted", "processing_time_ms")) + ") SELECT namespace, field, sum(v)::BIGINT AS total FROM x GROUP BY 1, 2",
    "custom_predicate_growth": "WITH " + F_ + "SELECT strftime(created_at, '%Y-%m-%d') AS day, predicate, count(*) AS facts FROM f WHERE created_at IS NOT NULL AND predicate IS NOT NULL AND NOT EXISTS (SELECT 1 FROM loom_predicates p WHERE p.predicate = f.predicate) GROUP BY 1, 2",
    "confidence_buckets": A_ + """SELECT primary_class, CASE WHEN primary_confidence < 0.2 THEN '0.0-0.2' WHEN primary_confidence < 0.4 THEN '0.2-0.4' WHEN primary_confidence < 0.6 THEN '0.4-0.6'
        WHEN primary_confidence < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bucket, count(*) AS n FROM a GROUP BY 1, 2""",
    "class_distribution": A_ + "SELECT namespace, primary_class, count(*) AS n FROM a GROUP BY 1, 2",
    "parser_health": E_ + "SELECT parser_version, parser_source_schema, count(*) AS episodes, strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') AS last_ingested FROM e WHERE ingestion_mode = 'vendor_import' GROUP BY 1, 2",
    "ingestion_distribution": E_ + ", c AS (SELECT namespace, ingestion_mode, count(*) AS episodes FROM e GROUP BY 1, 2) SELECT *, round(100.0::DOUBLE * episodes / (sum(episodes) OVER (PARTITION BY namespace))::DOUBLE, 4) AS pct FROM c",
    "seed_only_namespaces": E_ + "SELECT namespace, count(*) AS episodes FROM e GROUP BY 1 HAVING bool_and(ingestion_mode = 'user_authored_seed')",
    "queue_counters": E_ + "SELECT namespace, " + ", ".join(f"count(*) FILTER (WHERE processing_status = '{v}') AS {v}" for v in ("pending", "processing", "completed", "failed")) + " FROM e GROUP BY 1",
    "completions_per_minute": E_ + "SELECT strftime(processing_last_attempt, '%Y-%m-%d %H:%M') AS minute, count(*) AS completions FROM e WHERE processing_status = 'completed' AND processing_last_attempt IS NOT NULL GROUP BY 1",
    "stage_p50_last_60": A_ + f", r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, id DESC) AS rn FROM a) SELECT namespace, {_STAGES} FROM r WHERE rn <= 60 GROUP BY 1",
    "kpi_nearest_rank": A_ + """, r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, id DESC) AS rn FROM a),
        l AS (SELECT namespace, list_sort(list(latency_total_ms) FILTER (WHERE latency_total_ms IS NOT NULL)) AS l, list_sort(list(compiled_tokens) FILTER (WHERE compiled_tokens IS NOT NULL)) AS t FROM r WHERE rn <= 50 GROUP BY 1)
        SELECT namespace, l[least(len(l) - 1, floor(len(l) * 0.5))::INT + 1] AS p50, l[least(len(l) - 1, floor(len(l) * 0.95))::INT + 1] AS p95, t[least(len(t) - 1, floor(len(t) * 0.5))::INT + 1] AS median_tokens FROM l""",
    "fact_clusters": "WITH " + F_ + """SELECT namespace, lower(subject_id) AS subject_id, count(*) AS facts, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates
        FROM f WHERE superseded_by IS NULL GROUP BY 1, 2 HAVING count(*) >= 10""",
    "extraction_metrics": "WITH " + F_ + """, x AS (SELECT DISTINCT id, predicate, evidence_strength, lower(unnest(source_episodes)) AS episode_id FROM f)
        SELECT episode_id, count(*) AS facts, count(*) FILTER (WHERE evidence_strength = 'explicit') AS explicit, count(*) FILTER (WHERE evidence_strength = 'implied') AS implied,
          count(*) FILTER (WHERE coalesce(predicate IN (SELECT predicate FROM loom_predicates WHERE predicate IS NOT NULL), false)) AS canonical, count(*) FILTER (WHERE NOT coalesce(predicate IN (SELECT predicate FROM loom_predicates WHERE predicate IS NOT NULL), false)) AS custom
        FROM x WHERE episode_id IS NOT NULL GROUP BY 1""",
    "candidate_occurrences": "WITH " + F_ + "SELECT predicate, count(*) AS occurrences, array_to_string(list_sort(list(id))[1:3], ',') AS examples FROM f WHERE predicate IS NOT NULL AND NOT EXISTS (SELECT 1 FROM loom_predicates p WHERE p.predicate = f.predicate) GROUP BY 1",
    "predicate_usage": "WITH " + F_ + "SELECT p.predicate, category, pack, count(f.id) AS uses FROM loom_predicates p LEFT JOIN f USING (predicate) GROUP BY 1, 2, 3",
    "packs_with_counts": "WITH " + F_ + "SELECT pack, count(DISTINCT p.predicate) AS predicates, count(f.id) AS uses FROM loom_predicates p LEFT JOIN f USING (predicate) GROUP BY 1",
    "condition_summary": A_ + f"""SELECT output_format, coalesce(target_model, 'none') AS target_model, count(*) AS n, round({_PREC}, 6) AS precision, round(avg(compiled_tokens), 6) AS tokens,
        round(avg(latency_total_ms) FILTER (WHERE latency_total_ms >= 0), 6) AS latency FROM a GROUP BY 1, 2""",
    "compilations_page": A_ + ", r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, id DESC) AS rank FROM a) SELECT namespace, rank::INT AS rank, id, primary_class, compiled_tokens FROM r WHERE rank <= 5",
    "namespaces_union_distinct": "SELECT namespace, count(*) AS tables FROM (" + " UNION ALL ".join(f"SELECT DISTINCT namespace FROM {t}" for t in (EP, EN, FA, AU)) + ") GROUP BY 1",
}
