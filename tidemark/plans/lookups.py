"""Queries of lookups, loads and candidates, with SQL."""

from __future__ import annotations

from tidemark.operators import candidates as c
from tidemark.operators import lookups as k
from tidemark.operators import retrieval as r
from tidemark.plans.memory import FN_, NEW, _ALIAS
from tidemark.plans.metrics import A_, AU, E_, EN, EP, FA, N_, PR, of
from tidemark.plans.problems import _MSG
from tidemark.plans.retrieval import _COS, _WAYS, _XML, DO, EM, IT

QUERIES = {
    "optional_filter_entities": of(k.filtered_entities, EN, entity_type="service", part="vault"),
    "optional_filter_facts": of(k.filtered_facts, FA, status="user_asserted"),
    "optional_filter_none": of(k.filtered_facts, FA),
    "point_lookup": of(k.fact_points, FA),
    "tri_state_filter": of(k.not_done, EP),
    "predicate_packs_any": of(k.predicates_of_packs, PR, packs=["audit", "none"]),
    "candidates_over_threshold": of(k.review_candidates, FA, PR),
    "recent_errors": of(k.recent_errors, EP),
    "strip_code_fences": of(k.unfenced, DO),
    "hallucination_guard": of(k.cited_outside, FA),
    "cluster_fact_lines": of(k.cluster_lines, FA, EN),
    "task_class_from_name": of(k.task_classes, IT),
    "entity_insert_if_absent": of(k.new_entities, EN),
    "fact_state_upsert": of(k.fact_state, FA),
    "learn_status": of(k.learn_status, NEW, EP),
    "resolve_pass2_alias": of(k.resolve_mentions, EN),
    "content_hash_deliveries": of(k.delivery_hashes, NEW),
    "dedup_by_content_hash_deliveries": of(k.delivery_repeats, NEW, keys=["namespace", "content_hash"]),
    "dedup_by_source_event_deliveries": of(k.delivery_repeats, NEW, keys=["namespace", "source", "source_event_id"]),
    "seed_exists_deliveries": of(k.stored_before, NEW),
    "log_conflict": of(r.conflicts, EM, least=0.25, gap=0.05),
    "episode_scores": of(k.episode_scores, EP),
    "audit_page": of(k.audit_page, AU),
    "compilations_per_minute": of(k.compilations_per_minute, AU),
    "today_precision": of(k.today_precision, AU),
    "retrieval_union": of(c.union_counts, FA, EN, EP),
    "candidate_dedup": of(c.repeats, FA, EN, EP),
    "rank_candidates": of(c.ranked, FA, EN, EP),
    "compile_package": of(c.packages, FA, EN, EP),
    "build_audit_entry": of(c.audit_entries, FA, EN, EP),
}

_CAND = """WITH m AS (SELECT predicate, id FROM (SELECT DISTINCT ON (lower(id)) * FROM loom_facts WHERE deleted_at IS NULL ORDER BY lower(id)) WHERE predicate IS NOT NULL AND predicate NOT IN (SELECT predicate FROM loom_predicates WHERE predicate IS NOT NULL))
    , q AS (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY id) AS rn FROM m)"""
_AGAIN = """WITH r AS (SELECT delivery_id::VARCHAR AS id, first_value(delivery_id::VARCHAR) OVER (PARTITION BY {k} ORDER BY delivered_at NULLS LAST, delivery_id::VARCHAR) AS first_id FROM loom_new_episodes WHERE {nn}) SELECT id, first_id FROM r WHERE id <> first_id"""
_DECAY = "coalesce(exp(-greatest(floor((1751328000 - epoch_us(occurred_at) // 1000000) / 3600.0::DOUBLE) / 24.0::DOUBLE, 0.0::DOUBLE) * ln(2.0::DOUBLE) / 30), 0)"
_AUTH = "CASE evidence_status WHEN 'user_asserted' THEN 1.0 WHEN 'observed' THEN 0.8 WHEN 'promoted' THEN 0.7 WHEN 'extracted' THEN 0.6 WHEN 'inferred' THEN 0.4 WHEN 'deprecated' THEN 0.2 WHEN 'superseded' THEN 0.1 ELSE 0.5 END"
_FOUND = _WAYS + f""", seed AS (SELECT namespace, seed FROM way WHERE hop = 0)
    , g AS (SELECT seed, lower(f.id) AS id, coalesce((properties->>'$.confidence')::DOUBLE, 0.5) AS c, ({_AUTH})::DOUBLE AS au, source_episodes FROM seed JOIN f ON f.namespace = seed.namespace AND (f.subject_id = seed OR f.object_id = seed) WHERE valid_until IS NULL)
    , ep AS (SELECT DISTINCT ON (lower(id)) lower(id) AS id, occurred_at FROM loom_episodes WHERE deleted_at IS NULL ORDER BY lower(id), ingested_at NULLS LAST)
    , ci AS (SELECT DISTINCT seed, lower(x) AS id FROM (SELECT seed, unnest(source_episodes) AS x FROM g) WHERE x IS NOT NULL)
    , found AS (SELECT seed, 0 AS profile, 'fact' AS kind, id, c AS relevance, 0.6::DOUBLE AS recency, 0.6::DOUBLE + 0.3::DOUBLE * au AS stability FROM g
        UNION ALL SELECT seed, 1, 'graph', fs[-1], CASE hop WHEN 1 THEN 0.9 ELSE 0.7 END::DOUBLE, CASE hop WHEN 1 THEN 0.8 ELSE 0.6 END::DOUBLE, CASE hop WHEN 1 THEN 0.7 ELSE 0.5 END::DOUBLE FROM way WHERE hop > 0
        UNION ALL SELECT seed, 2, 'episode', ci.id, 0.5::DOUBLE, round({_DECAY}, 5), 0.8::DOUBLE FROM ci JOIN ep ON ep.id = ci.id)
    , sc AS (SELECT *, round(0.5::DOUBLE * relevance + 0.25::DOUBLE * recency + 0.25::DOUBLE * stability, 7) AS score FROM found WHERE id NOT IN (SELECT lower(id) FROM f WHERE evidence_status = 'user_asserted'))
    , dd AS (SELECT *, row_number() OVER (PARTITION BY seed, id ORDER BY profile, score DESC) AS dn FROM sc)
    , rk AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, profile, id) AS rank FROM dd WHERE dn = 1)"""

ORACLES = {
    "optional_filter_entities": "WITH " + N_ + "SELECT id, name, entity_type, namespace FROM n WHERE entity_type = 'service' AND name ILIKE '%vault%'",
    "optional_filter_facts": FN_ + "SELECT id, namespace, subject_id, predicate, object_id FROM f WHERE evidence_status = 'user_asserted'",
    "optional_filter_none": FN_ + "SELECT id, namespace, subject_id, predicate, object_id FROM f",
    "point_lookup": "SELECT DISTINCT ON (lower(id)) id, namespace, predicate FROM loom_facts WHERE lower(id) IN (SELECT lower(superseded_by) FROM loom_facts WHERE deleted_at IS NULL AND superseded_by IS NOT NULL) ORDER BY lower(id)",
    "tri_state_filter": E_ + "SELECT id, namespace FROM e WHERE processed = false OR processed IS NULL",
    "predicate_packs_any": "SELECT predicate, pack, category FROM loom_predicates WHERE pack = ANY(['audit', 'none'])",
    "candidates_over_threshold": _CAND + " SELECT predicate, count(*) AS occurrences, string_agg(id, ',' ORDER BY id) FILTER (WHERE rn <= 3) AS examples FROM q GROUP BY 1 HAVING count(*) >= 5",
    "recent_errors": """WITH x AS (SELECT lower(id) AS id, namespace, processing_last_attempt AS t, processing_last_error AS error, row_number() OVER (PARTITION BY lower(id) ORDER BY processing_last_attempt DESC NULLS LAST, namespace DESC NULLS LAST, processing_last_error DESC) AS k FROM loom_episodes WHERE deleted_at IS NULL AND processing_last_error IS NOT NULL AND id IS NOT NULL)
        , y AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY t DESC NULLS LAST, id) AS rank FROM x WHERE k = 1) SELECT namespace, rank::INT AS rank, id, error FROM y WHERE rank <= 10""",
    "strip_code_fences": r"""WITH t AS (SELECT doc_id, regexp_replace(text || chr(10) || '```', '^\s+|\s+$', '', 'g') AS body FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
        , s AS (SELECT doc_id, regexp_replace(left(body, length(body) - 3), '^\s+|\s+$', '', 'g') AS t FROM t) SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM s""",
    "hallucination_guard": FN_ + """, m AS (SELECT namespace, subject_id, count(*) AS members FROM f WHERE subject_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
        , ci AS (SELECT DISTINCT namespace, subject_id, superseded_by AS c FROM f WHERE superseded_by IS NOT NULL), x AS (SELECT ci.*, EXISTS (SELECT 1 FROM f WHERE f.namespace = ci.namespace AND f.subject_id = ci.subject_id AND lower(f.id) = ci.c) AS inside FROM ci)
        SELECT m.namespace, m.subject_id, members, count(*) AS cited, count(*) FILTER (WHERE NOT inside) AS strangers, count(*) FILTER (WHERE NOT inside) = 0 AS accepted FROM m JOIN x ON x.namespace = m.namespace AND x.subject_id = m.subject_id GROUP BY 1, 2, 3""",
    "cluster_fact_lines": FN_ + ", " + N_ + """, o AS (SELECT * FROM f WHERE superseded_by IS NULL AND subject_id IS NOT NULL), b AS (SELECT namespace, subject_id FROM o GROUP BY 1, 2 HAVING count(*) >= 10)
        SELECT o.namespace, o.subject_id, concat('- [', lower(o.id), '] ', s.name, ' ', predicate, ' ', t.name, ' (evidence: ', coalesce(evidence_status, 'none'), ')') AS line FROM o JOIN b ON b.namespace = o.namespace AND b.subject_id = o.subject_id JOIN n s ON lower(s.id) = o.subject_id JOIN n t ON lower(t.id) = o.object_id""",
    "task_class_from_name": "SELECT item_id, task_name, CASE WHEN task_name LIKE 'debug\\_%' ESCAPE '\\' THEN 'debug' WHEN task_name LIKE 'arch\\_%' ESCAPE '\\' THEN 'architecture' WHEN task_name LIKE 'compliance\\_%' ESCAPE '\\' THEN 'compliance' WHEN task_name LIKE 'writing\\_%' ESCAPE '\\' THEN 'writing' ELSE 'chat' END AS task_class FROM eval_items",
    "entity_insert_if_absent": "WITH " + N_ + ", " + _ALIAS + """, x AS (SELECT entity_id || '#' || alias AS id, alias AS name, entity_type, namespace, row_number() OVER (PARTITION BY lower(alias), lower(entity_type), lower(namespace) ORDER BY entity_id || '#' || alias) AS rn FROM al WHERE alias IS NOT NULL)
        SELECT id, name, entity_type, namespace FROM x WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM n WHERE lower(n.name) = lower(x.name) AND lower(n.entity_type) IS NOT DISTINCT FROM lower(x.entity_type) AND lower(n.namespace) IS NOT DISTINCT FROM lower(x.namespace))""",
    "fact_state_upsert": FN_ + """, p AS (SELECT subject_id, created_at < TIMESTAMP '2025-06-15 00:00:00' AS old, (properties->>'$.confidence')::DOUBLE AS c, epoch_us(created_at) AS us FROM f WHERE subject_id IS NOT NULL AND created_at IS NOT NULL)
        SELECT subject_id, coalesce(max(c) FILTER (WHERE NOT old), max(c) FILTER (WHERE old)) AS confidence, CASE WHEN count(*) FILTER (WHERE NOT old) > 0 THEN count(*) FILTER (WHERE NOT old) ELSE count(*) END AS facts, max(us) AS last_us FROM p GROUP BY 1""",
    "learn_status": _MSG + r""", h AS (SELECT delivery_id, namespace, source, source_event_id, coalesce(regexp_replace(lower(content_hash), '^sha256:', ''), sha256(content)) AS h FROM loom_new_episodes)
        , st AS (SELECT delivery_id FROM h WHERE EXISTS (SELECT 1 FROM loom_episodes e WHERE e.namespace = h.namespace AND regexp_replace(lower(e.content_hash), '^sha256:', '') = h.h) OR EXISTS (SELECT 1 FROM loom_episodes e WHERE e.namespace = h.namespace AND e.source = h.source AND e.source_event_id = h.source_event_id))
        SELECT delivery_id, CASE WHEN bool_and(rn > 1) OR delivery_id IN (SELECT delivery_id FROM st) THEN 'duplicate' ELSE 'queued' END AS status FROM k WHERE delivery_id IS NOT NULL GROUP BY 1""",
    "resolve_pass2_alias": "WITH " + N_ + ", " + _ALIAS + """, d AS (SELECT lower(id) AS mention_id, upper(name) AS name, entity_type, namespace, list_append(coalesce(json_extract_string(properties, '$.aliases[*]'), []), name) AS aliases FROM n WHERE id IS NOT NULL)
        , fw AS (SELECT mention_id, entity_id FROM d JOIN al ON al.alias = d.name AND al.entity_type = d.entity_type AND al.namespace = d.namespace)
        , nm AS (SELECT lower(name) AS k, entity_type, namespace, min(lower(id)) AS entity_id FROM n GROUP BY 1, 2, 3)
        , bk AS (SELECT mention_id, nm.entity_id FROM (SELECT mention_id, entity_type, namespace, unnest(aliases) AS a FROM d) x JOIN nm ON nm.k = lower(x.a) AND nm.entity_type = x.entity_type AND nm.namespace = x.namespace)
        , hit AS (SELECT mention_id, min(entity_id) AS entity_id FROM (SELECT * FROM fw UNION SELECT * FROM bk) GROUP BY 1 HAVING count(*) = 1)
        SELECT mention_id, hit.entity_id, 0.95::DOUBLE AS confidence, NOT EXISTS (SELECT 1 FROM al WHERE al.entity_id = hit.entity_id AND lower(al.alias) = lower(d.name)) AS append FROM hit JOIN d USING (mention_id)""",
    "content_hash_deliveries": "SELECT delivery_id::VARCHAR AS id, sha256(content) AS sha FROM loom_new_episodes WHERE sha256(content) IS DISTINCT FROM regexp_replace(lower(content_hash), '^sha256:', '')",
    "dedup_by_content_hash_deliveries": _AGAIN.format(k="namespace, content_hash", nn="namespace IS NOT NULL AND content_hash IS NOT NULL"),
    "dedup_by_source_event_deliveries": _AGAIN.format(k="namespace, source, source_event_id", nn="namespace IS NOT NULL AND source IS NOT NULL AND source_event_id IS NOT NULL"),
    "seed_exists_deliveries": r"""WITH d AS (SELECT *, delivered_at >= TIMESTAMP '2025-06-15 00:00:00' AS new, regexp_replace(lower(content_hash), '^sha256:', '') AS bare FROM loom_new_episodes), o AS (SELECT * FROM d WHERE NOT new)
        SELECT delivery_id, 'content_hash' AS matched FROM d WHERE new AND EXISTS (SELECT 1 FROM o WHERE o.namespace = d.namespace AND o.bare = coalesce(d.bare, sha256(d.content)))
        UNION ALL SELECT delivery_id, 'source_event_id' FROM d WHERE new AND EXISTS (SELECT 1 FROM o WHERE o.namespace = d.namespace AND o.source = d.source AND o.source_event_id = d.source_event_id)""",
    "log_conflict": _COS + """, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE ql = vl), t AS (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM k WHERE rank <= 10)
        SELECT query_id, '[' || string_agg(printf('{"id":%d,"score":%.6f,"method":"semantic"}', vec_id, similarity), ',' ORDER BY rank) || ']' AS candidates FROM t WHERE best >= 0.25 AND similarity > best - 0.05 GROUP BY 1 HAVING count(*) > 1""",
    "episode_scores": E_ + f"SELECT id, greatest(20, least(200, coalesce(strlen(content) // 4, 0)))::INT AS tokens, round({_DECAY}, 5) AS recency, round(0.8::DOUBLE * CASE ingestion_mode WHEN 'live_mcp_capture' THEN 1.0 WHEN 'user_authored_seed' THEN 0.8 WHEN 'vendor_import' THEN 0.6 ELSE 1.0 END::DOUBLE, 5) AS provenance FROM e",
    "audit_page": A_ + ", q AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC NULLS LAST, id DESC) AS rank FROM a) SELECT namespace, rank::INT AS rank, id, task_class FROM q WHERE rank BETWEEN 6 AND 10",
    "compilations_per_minute": A_ + "SELECT strftime(date_trunc('minute', created_at), '%Y-%m-%d %H:%M') AS minute, count(*) AS compilations FROM a WHERE created_at IS NOT NULL GROUP BY 1",
    "today_precision": A_ + """, p AS (SELECT namespace, strftime(created_at, '%Y-%m-%d') AS day, CASE WHEN candidates_found > 0 THEN candidates_selected / candidates_found::DOUBLE ELSE 0.0::DOUBLE END AS p FROM a WHERE created_at IS NOT NULL), d AS (SELECT namespace, day, sum(p) AS s, count(*) AS c FROM p GROUP BY 1, 2)
        SELECT namespace, max(day) AS day, round(arg_max(s / c, day), 6) AS today, round(sum(s) / sum(c), 6) AS mean FROM d GROUP BY 1""",
    "retrieval_union": _FOUND + " SELECT seed, profile, kind, count(*) AS found, max(relevance) AS best FROM found GROUP BY 1, 2, 3",
    "candidate_dedup": _FOUND + " SELECT seed, kind, count(*) FILTER (WHERE dn = 1) AS kept, count(*) FILTER (WHERE dn > 1) AS rejected FROM dd GROUP BY 1, 2",
    "rank_candidates": _FOUND + " SELECT seed, rank::INT AS rank, kind, id, score FROM rk",
    "compile_package": _FOUND + f""", te AS (SELECT DISTINCT ON (lower(id)) lower(id) AS id, occurred_at, source, content FROM loom_episodes WHERE deleted_at IS NULL ORDER BY lower(id), ingested_at NULLS LAST)
        , u AS (SELECT rk.seed, rk.rank, rk.kind, rk.id, sum(CASE kind WHEN 'fact' THEN 50 WHEN 'graph' THEN 30 ELSE greatest(20, least(200, coalesce(strlen(content) // 4, 0))) END) OVER (PARTITION BY seed ORDER BY rank) AS upto FROM rk LEFT JOIN te ON te.id = rk.id)
        , el AS (SELECT seed, rank, 'facts' AS part, concat('<fact subject="', {_XML("coalesce(s.name, '')")}, '" predicate="', {_XML("coalesce(predicate, '')")}, '" object="', {_XML("coalesce(o.name, '')")}, '" evidence="', coalesce(evidence_status, ''), '" observed="', coalesce(strftime(valid_from, '%Y-%m-%d'), ''), '"/>') AS x
            FROM u JOIN f ON lower(f.id) = u.id LEFT JOIN n s ON lower(s.id) = f.subject_id LEFT JOIN n o ON lower(o.id) = f.object_id WHERE kind <> 'episode' AND upto <= 500
          UNION ALL SELECT seed, rank, 'episodes', concat('<episode date="', coalesce(strftime(occurred_at, '%Y-%m-%d'), ''), '" source="', {_XML("coalesce(source, '')")}, '" id="', u.id, '">', {_XML("coalesce(content, '')")}, '</episode>') FROM u JOIN te ON te.id = u.id WHERE kind = 'episode' AND upto <= 500)
        SELECT seed, '<context>' || chr(10) || coalesce('<knowledge>' || chr(10) || string_agg(x, chr(10) ORDER BY rank) FILTER (WHERE part = 'facts') || chr(10) || '</knowledge>' || chr(10), '')
          || coalesce('<episodes>' || chr(10) || string_agg(x, chr(10) ORDER BY rank) FILTER (WHERE part = 'episodes') || chr(10) || '</episodes>' || chr(10), '') || '</context>' AS context, (20 + sum(strlen(x) // 4))::BIGINT AS tokens FROM el GROUP BY 1""",
    "build_audit_entry": _FOUND + """, u AS (SELECT seed, CASE kind WHEN 'fact' THEN 50 WHEN 'graph' THEN 30 ELSE 100 END AS cost, sum(CASE kind WHEN 'fact' THEN 50 WHEN 'graph' THEN 30 ELSE 100 END) OVER (PARTITION BY seed ORDER BY rank) AS upto FROM rk)
        SELECT seed, count(*) AS found, count(*) FILTER (WHERE upto <= 500) AS selected, count(*) FILTER (WHERE upto > 500) AS rejected, coalesce(sum(cost) FILTER (WHERE upto <= 500), 0)::BIGINT AS tokens FROM u GROUP BY 1""",
}
