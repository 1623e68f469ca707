"""Queries of retrieval, ranking and windows, with SQL."""

from __future__ import annotations

from tidemark.operators import ranking as k
from tidemark.operators import retrieval as r
from tidemark.operators import windows as w
from tidemark.sources import exports as ex
from tidemark.plans.memory import FN_, _MODES
from tidemark.plans.metrics import A_, AU, E_, EN, EP, F_, FA, N_, PR, of

EM, EV, DO, IT = "embeddings", "events", "documents", "eval_items"

QUERIES = {
    "knn_entities": of(r.knn, EM),
    "resolve_pass3_semantic": of(r.resolve_semantic, EM, least=0.35),
    "episode_recall": of(r.episode_recall, DO, EM),
    "query_terms": of(r.query_terms, AU),
    "keyword_entity_match": of(r.keyword_entities, AU, EN),
    "fact_lookup": of(r.fact_lookup, AU, FA, EN),
    "merge_profiles": of(r.merge_profiles, AU),
    "predicate_prompt_block": of(r.predicate_blocks, FA, PR),
    "traverse": of(r.traverse, FA, EN),
    "traverse_paths": of(r.walk_rows, FA, EN),
    "entity_graph": of(r.graph_edges, FA, EN),
    "graph_neighborhood": of(r.neighborhood, FA, EN),
    "score_dimensions": of(k.fact_scores, FA, EP),
    "apply_weights": of(k.apply_weights, AU),
    "greedy_budget_pack": of(k.greedy_pack, AU),
    "keyword_precheck": of(k.classify, AU),
    "parse_classes": of(k.parse_classes, AU),
    "salience_on_access": of(k.salience, FA, EN),
    "demote_budget_overflow": of(k.budget_overflow, FA, EN),
    "hot_snapshot": of(k.hot_snapshot, FA, EN),
    "compile_structured": of(k.compile_structured, FA, EN),
    "compile_compact": of(k.compile_compact, FA, EN),
    "freshness": of(k.freshness, EP),
    "latency_thresholds": of(k.latency_levels, AU),
    "entity_match_fraction": of(k.entity_match, IT),
    "running_compilations": of(k.running_share, AU),
    "session_chunker": of(ex.text_chunks, DO),
    "event_tumbling": of(w.tumbling, EV),
    "event_sliding": of(w.sliding, EV),
    "event_sessions": of(w.sessions, EV),
    "ring_buffer": of(w.last_points, EV),
}

_COS = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, q.label AS ql, v.label AS vl, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)"""
_EDGES = FN_ + ", " + N_ + """, alive AS (SELECT lower(id) AS b FROM n)
    , ed AS (SELECT namespace, subject_id AS a, object_id AS b FROM f WHERE valid_until IS NULL AND subject_id <> object_id UNION ALL SELECT namespace, object_id, subject_id FROM f WHERE valid_until IS NULL AND subject_id <> object_id)
    , seed AS (SELECT lower(id) AS seed, namespace FROM n WHERE ('0x' || right(lower(id), 4))::BIGINT % 50 = 0)
    , one AS (SELECT s.namespace, s.seed, ed.b AS mid FROM seed s JOIN ed ON ed.namespace = s.namespace AND ed.a = s.seed WHERE ed.b IN (SELECT b FROM alive))
    , two AS (SELECT one.seed, ed.b AS entity_id FROM one JOIN ed ON ed.namespace = one.namespace AND ed.a = one.mid WHERE ed.b <> one.seed AND ed.b IN (SELECT b FROM alive))
    , tr AS (SELECT seed, mid AS entity_id, 1 AS hop, count(*) AS paths FROM one GROUP BY 1, 2 UNION ALL SELECT seed, entity_id, 2, count(*) FROM two GROUP BY 1, 2)"""
_WAYS = FN_.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + N_ + """, alive AS (SELECT lower(id) AS b FROM n)
    , ed AS (SELECT namespace, subject_id AS a, object_id AS b, lower(id) AS fact_id FROM f WHERE valid_until IS NULL UNION ALL SELECT namespace, object_id, subject_id, lower(id) FROM f WHERE valid_until IS NULL)
    , way AS (SELECT namespace, lower(id) AS seed, lower(id) AS entity_id, 0 AS hop, [lower(id)] AS path, []::VARCHAR[] AS fs FROM n WHERE ('0x' || right(lower(id), 4))::BIGINT % 50 = 0
        UNION ALL SELECT way.namespace, seed, ed.b, hop + 1, list_append(path, ed.b), list_append(fs, fact_id) FROM way JOIN ed ON ed.namespace = way.namespace AND ed.a = way.entity_id
        WHERE hop < 2 AND NOT list_contains(path, ed.b) AND ed.b IN (SELECT b FROM alive))"""
# Constants are stated here once more, so that the SQL does not repeat a wrong one of an operator.
_AUTH = "CASE evidence_status WHEN 'user_asserted' THEN 1.0::DOUBLE WHEN 'observed' THEN 0.8::DOUBLE WHEN 'promoted' THEN 0.7::DOUBLE WHEN 'extracted' THEN 0.6::DOUBLE WHEN 'inferred' THEN 0.4::DOUBLE WHEN 'deprecated' THEN 0.2::DOUBLE WHEN 'superseded' THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END"
_WEIGHT_ROWS = {"episodic": "1.0 0.5 1.0 0.3 0.4", "semantic": "0.7 1.0 0.8 1.0 1.0", "procedural": "0.8 0.3 0.0 0.6 0.3"}  # debug, architecture, compliance, writing, chat
_W = lambda kind: "CASE primary_class " + " ".join(f"WHEN '{c}' THEN {v}::DOUBLE" for c, v in zip(("debug", "architecture", "compliance", "writing", "chat"), _WEIGHT_ROWS[kind].split())) + " ELSE 1.0::DOUBLE END"
_ITEMS = A_ + """, j AS (SELECT id, primary_class, compiled_tokens, list_concat(coalesce(from_json(selected_items, '[{"type":"VARCHAR","score":"DOUBLE"}]'), []), coalesce(from_json(rejected_items, '[{"type":"VARCHAR","score":"DOUBLE"}]'), [])) AS items FROM a)"""
_COST = "CASE x.t WHEN 'fact' THEN 50 WHEN 'graph' THEN 30 WHEN 'procedure' THEN 40 ELSE 100 END"
_AS_OF = "TIMESTAMP '2025-07-01 00:00:00'"
_XML = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_TOP = FN_ + ", " + N_ + """, t AS (SELECT f.*, s.name AS subject, o.name AS object FROM f JOIN n s ON lower(s.id) = subject_id JOIN n o ON lower(o.id) = object_id WHERE valid_until IS NULL)
    , x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY valid_from DESC NULLS LAST, id) AS rank FROM t) WHERE rank <= 20)"""
_SAL = FN_ + ", " + N_ + """, g AS (SELECT e, count(*) AS c FROM (SELECT subject_id AS e FROM f UNION ALL SELECT object_id FROM f) GROUP BY 1)
    , sal AS (SELECT lower(n.id) AS entity_id, namespace, coalesce(c, 0) AS accesses, round(1 - 0.5::DOUBLE * pow(0.9::DOUBLE, coalesce(c, 0)), 6) AS salience FROM n LEFT JOIN g ON g.e = lower(n.id) WHERE n.id IS NOT NULL)"""
_PROF = lambda c: f"CASE {c} WHEN 'debug' THEN ['graph_neighborhood', 'episode_recall'] WHEN 'architecture' THEN ['fact_lookup', 'graph_neighborhood'] WHEN 'compliance' THEN ['episode_recall', 'fact_lookup'] WHEN 'writing' THEN ['fact_lookup'] WHEN 'chat' THEN ['fact_lookup'] ELSE [] END"
_WORDS = {
    "debug": "error|bug|crash|fail|exception|stack trace|debug|troubleshoot|broken|fix", "architecture": "architecture|design|component|system|diagram|module|structure|pattern|microservice",
    "compliance": "compliance|audit|regulation|policy|governance|control|evidence|finding|risk", "writing": "write|document|draft|generate|create doc|readme|specification",
}
_HIT = """t AS (SELECT DISTINCT namespace, term FROM (SELECT namespace, unnest(regexp_split_to_array(lower(query_text), '\\s+')) AS term FROM loom_audit_log WHERE query_text IS NOT NULL) WHERE strlen(term) >= 3)
    , h AS (SELECT t.namespace, term, lower(id) AS e, row_number() OVER (PARTITION BY t.namespace, term ORDER BY name, lower(id)) AS rn FROM t JOIN n ON n.namespace = t.namespace AND contains(lower(name), term))"""
ORACLES = {
    "fact_lookup": FN_ + ", " + N_ + ", " + _HIT + """, ends AS (SELECT namespace, id, coalesce((properties->>'$.confidence')::DOUBLE, 0.5) AS c, unnest(list_distinct([subject_id, object_id])) AS e FROM f WHERE valid_until IS NULL)
        , g AS (SELECT h.namespace, h.term, ends.id AS fact_id, max(c) AS c, count(*) AS cnt FROM h JOIN ends ON ends.namespace = h.namespace AND ends.e = h.e GROUP BY 1, 2, 3)
        , s AS (SELECT namespace, term, fact_id, round(least(1.0::DOUBLE, c + least(0.1::DOUBLE, 0.05::DOUBLE * cnt)), 6) AS score FROM g)
        , q AS (SELECT *, row_number() OVER (PARTITION BY namespace, term ORDER BY score DESC, fact_id) AS rank FROM s) SELECT namespace, term, fact_id, score, rank::INT AS rank FROM q WHERE rank <= 20""",
    "merge_profiles": A_ + f""", p AS (SELECT *, list_concat({_PROF("primary_class")}, list_filter({_PROF("secondary_class")}, lambda x: NOT list_contains({_PROF("primary_class")}, x)))[1:3] AS pl FROM a)
        SELECT primary_class, coalesce(secondary_class, 'none') AS secondary, array_to_string(pl, ',') AS planned, count(*) AS n, count(*) FILTER (WHERE array_to_string(pl, ',') = array_to_string(coalesce(profiles_executed, []), ',')) AS as_planned FROM p GROUP BY 1, 2, 3""",
    "predicate_prompt_block": "WITH " + F_ + """, u AS (SELECT predicate, count(*) AS uses FROM f GROUP BY 1), w AS (SELECT pack, category, p.predicate || ' (' || coalesce(uses, 0) || ')' AS word FROM loom_predicates p LEFT JOIN u USING (predicate) WHERE p.predicate IS NOT NULL)
        , l AS (SELECT pack, category || ': ' || array_to_string(list_sort(list(word)), ', ') AS line FROM w GROUP BY pack, category) SELECT pack, array_to_string(list_sort(list(line)), chr(10)) AS block FROM l GROUP BY pack""",
    "knn_entities": _COS + ", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, similarity, rank::INT AS rank FROM k WHERE rank <= 10",
    "resolve_pass3_semantic": _COS + """, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE ql = vl), t AS (SELECT * FROM k WHERE rank <= 10)
        , b AS (SELECT t.*, coalesce((SELECT similarity FROM t u WHERE u.query_id = t.query_id AND u.rank = 2), 0) AS second, (SELECT count(*) FROM t u WHERE u.query_id = t.query_id AND u.similarity > t.similarity - 0.03) AS near FROM t WHERE rank = 1)
        , d AS (SELECT *, CASE WHEN similarity < 0.35 THEN 'new' WHEN round(similarity - second, 6) >= 0.03 THEN 'merge' ELSE 'conflict' END AS method FROM b)
        SELECT query_id, method, CASE WHEN method = 'merge' THEN vec_id END AS target, similarity, CASE WHEN method = 'conflict' THEN near ELSE 0 END AS candidates FROM d""",
    "episode_recall": _COS + f""", k AS (SELECT s.*, d.created_at, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s JOIN (SELECT doc_id, min(created_at) AS created_at FROM documents GROUP BY 1) d ON d.doc_id = s.vec_id)
        SELECT query_id, vec_id AS doc_id, rank::INT AS rank, round(least(1.0, 0.7 * similarity + 0.3 * coalesce(exp(-greatest(floor((epoch_us({_AS_OF}) // 1000000 - epoch_us(created_at) // 1000000) / 3600.0::DOUBLE) / 24.0::DOUBLE, 0.0::DOUBLE) * ln(2.0::DOUBLE) / 30), 0)), 5) AS score FROM k WHERE rank <= 10""",
    "query_terms": "SELECT DISTINCT namespace, term FROM (SELECT namespace, unnest(regexp_split_to_array(lower(query_text), '\\s+')) AS term FROM loom_audit_log WHERE query_text IS NOT NULL) WHERE strlen(term) >= 3",
    "keyword_entity_match": "WITH " + N_ + """, t AS (SELECT DISTINCT namespace, term FROM (SELECT namespace, unnest(regexp_split_to_array(lower(query_text), '\\s+')) AS term FROM loom_audit_log WHERE query_text IS NOT NULL) WHERE strlen(term) >= 3)
        , h AS (SELECT t.namespace, term, name, lower(id) AS entity_id, row_number() OVER (PARTITION BY t.namespace, term ORDER BY name, lower(id)) AS rank FROM t JOIN n ON n.namespace = t.namespace AND contains(lower(name), term)) SELECT namespace, term, name, entity_id, rank::INT AS rank FROM h WHERE rank <= 5""",
    "traverse": _EDGES + " SELECT seed, entity_id, hop, paths FROM tr",
    "traverse_paths": _WAYS + " SELECT seed, entity_id, hop, array_to_string(path, '>') AS path, array_to_string(fs, '>') AS facts FROM way WHERE hop > 0",
    "entity_graph": _WAYS + """, x AS (SELECT seed, unnest(fs) AS fact_id, unnest(range(1, len(fs) + 1)) AS h FROM way), y AS (SELECT seed, fact_id, min(h)::INT AS hop FROM x GROUP BY 1, 2)
        SELECT seed, fact_id, subject_id, predicate, object_id, hop FROM y JOIN f ON lower(f.id) = fact_id""",
    "graph_neighborhood": _EDGES + """, u AS (SELECT *, sum(CASE WHEN hop = 1 THEN paths ELSE 0 END) OVER (PARTITION BY seed) AS ones FROM tr), b AS (SELECT seed, entity_id, min(hop) AS hop FROM u WHERE hop = 1 OR ones < 3 GROUP BY 1, 2)
        SELECT seed, entity_id, hop, (CASE WHEN hop = 1 THEN 0.9 ELSE 0.7 END)::DOUBLE AS score FROM b""",
    "score_dimensions": E_ + ", " + F_ + f""", p AS (SELECT lower(id) AS e, {_MODES} AS m FROM e), rr AS (SELECT id, unnest(source_episodes) AS e FROM f), bm AS (SELECT rr.id, min(m) AS m FROM rr JOIN p ON p.e = lower(rr.e) GROUP BY 1)
        , d AS (SELECT f.id, greatest(0.0, least(1.0, coalesce((properties->>'$.confidence')::DOUBLE, 0.5))) AS relevance, greatest(0.0, least(1.0, (CASE WHEN valid_until IS NULL THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END) + 0.3 * {_AUTH} + 0.1)) AS stability,
            greatest(0.0, least(1.0, (0.5 * least(coalesce(len(source_episodes), 0) / 5.0::DOUBLE, 1.0) + 0.5 * {_AUTH}) * (CASE m WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.8::DOUBLE WHEN 3 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END))) AS provenance FROM f LEFT JOIN bm USING (id))
        SELECT id, round(relevance, 5)::DOUBLE AS relevance, round(stability, 5)::DOUBLE AS stability, round(provenance, 5)::DOUBLE AS provenance, round(0.40::DOUBLE * relevance + 0.25::DOUBLE * 0.6 + 0.20::DOUBLE * stability + 0.15::DOUBLE * provenance, 5) AS final FROM d""",
    "apply_weights": _ITEMS + f""", x AS (SELECT primary_class, unnest(items) AS i FROM j), y AS (SELECT primary_class, i.type AS type, i.score AS score, CASE i.type WHEN 'episode' THEN {_W("episodic")} WHEN 'procedure' THEN {_W("procedural")} ELSE {_W("semantic")} END AS w FROM x)
        SELECT primary_class, type, count(*) AS candidates, count(*) FILTER (WHERE w = 0) AS dropped, round(avg(CASE WHEN w > 0 THEN score * w END), 5) AS mean_weighted FROM y GROUP BY 1, 2""",
    "greedy_budget_pack": _ITEMS + f""", l AS (SELECT id, floor(compiled_tokens * 0.25::DOUBLE)::BIGINT AS budget, list_sort(list_transform(items, lambda x, i: {{'s': -x.score, 'i': i, 't': x.type}})) AS r FROM j WHERE len(items) > 0)
        , z AS (SELECT id, list_reduce(r, lambda acc, x: CASE WHEN acc.tokens + {_COST} <= budget THEN {{'kept': acc.kept + 1, 'tokens': acc.tokens + {_COST}, 'skipped': acc.skipped}} ELSE {{'kept': acc.kept, 'tokens': acc.tokens, 'skipped': acc.skipped + 1}} END, {{'kept': 0, 'tokens': 0, 'skipped': 0}}) AS q FROM l)
        SELECT id, q.kept AS kept, q.tokens AS tokens, q.skipped AS skipped FROM z""",
    "keyword_precheck": A_ + "SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(query_text), '{x}') THEN '{c}'" for c, x in _WORDS.items()) + " END AS guess, primary_class, count(*) AS n FROM a GROUP BY 1, 2",
    "parse_classes": A_ + """, b AS (SELECT *, coalesce(primary_confidence, 0) AS c1 FROM a)
        SELECT CASE WHEN c1 < 0.1 THEN 'chat' ELSE primary_class END AS first, coalesce(CASE WHEN c1 >= 0.1 AND round(c1 - secondary_confidence, 6) < 0.3 THEN secondary_class END, 'none') AS second, count(*) AS n FROM b GROUP BY 1, 2""",
    "salience_on_access": _SAL + " SELECT * FROM sal",
    "demote_budget_overflow": _SAL + ", q AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY salience DESC, entity_id DESC) AS rn FROM sal) SELECT entity_id, namespace FROM q WHERE (rn - 1) * 20 + 20 > 500",
    "hot_snapshot": _SAL + """, q AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY accesses DESC, entity_id) AS rn FROM sal)
        SELECT namespace, '[' || string_agg('{"id":"' || entity_id || '","n":' || accesses || '}', ',' ORDER BY rn) || ']' AS entities, (count(*) * 20)::INT AS tokens FROM q WHERE rn <= 10 GROUP BY 1""",
    "compile_structured": _TOP + f""", b AS (SELECT subject_id AS entity_id, '<knowledge of="' || {_XML('subject')} || '">' || chr(10) || string_agg('  <fact subject="' || {_XML('subject')} || '" predicate="' || {_XML('predicate')} || '" object="' || {_XML('object')} || '" since="' || strftime(valid_from, '%Y-%m-%d') || '"/>', chr(10) ORDER BY rank) || chr(10) || '</knowledge>' AS context FROM x GROUP BY subject_id, subject)
        SELECT entity_id, context, greatest(1, strlen(context) // 4)::INT AS tokens FROM b""",
    "compile_compact": _TOP + """ SELECT subject_id AS entity_id, '[' || string_agg('{"s":' || to_json(subject)::VARCHAR || ',"p":' || to_json(predicate)::VARCHAR || ',"o":' || to_json(object)::VARCHAR || '}', ',' ORDER BY rank) || ']' AS context FROM x GROUP BY 1""",
    "freshness": f"""WITH l AS (SELECT namespace, source, max(ingested_at) AS t FROM loom_episodes WHERE deleted_at IS NULL GROUP BY 1, 2), s AS (SELECT *, greatest(0, epoch_us({_AS_OF}) // 1000000 - epoch_us(t) // 1000000) AS s FROM l)
        SELECT namespace, source, CASE WHEN s <= 86400 THEN 'fresh' WHEN s <= 604800 THEN 'aging' ELSE 'stale' END AS freshness, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm ago' WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'h ago' WHEN s < 604800 THEN (s // 86400)::VARCHAR || 'd ago' WHEN s < 5184000 THEN (s // 604800)::VARCHAR || ' weeks ago' WHEN s < 31536000 THEN (s // 2592000)::VARCHAR || ' months ago' ELSE strftime(t, '%Y-%m-%d') END AS age FROM s""",
    "latency_thresholds": A_ + "SELECT namespace, CASE WHEN latency_total_ms >= 1000 THEN 'critical' WHEN latency_total_ms >= 500 THEN 'warn' ELSE 'ok' END AS level, count(*) AS n FROM a WHERE latency_total_ms >= 0 GROUP BY 1, 2",
    "entity_match_fraction": "SELECT item_id, (CASE WHEN len(coalesce(expected_entities, [])) > 0 THEN round(len(list_filter(expected_entities, lambda n: contains(lower(concat_ws(' ', query, passage)), lower(n)))) / len(expected_entities)::DOUBLE, 6) ELSE 0.0 END)::DOUBLE AS fraction FROM eval_items",
    "running_compilations": A_ + ", d AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM a WHERE created_at IS NOT NULL GROUP BY 1) SELECT day, n, (sum(n) OVER (ORDER BY day))::BIGINT AS so_far FROM d",
    "session_chunker": """WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(text, chr(10)) AS l FROM documents WHERE doc_kind = 'session' AND text <> '')
        , c AS (SELECT *, list_reduce(l, lambda acc, x: CASE WHEN len(acc.c) > 0 AND acc.size + 1 + strlen(x) > 4096 THEN {'size': strlen(x), 'c': list_append(acc.c, acc.c[-1] + 1)} ELSE {'size': acc.size + 1 + strlen(x), 'c': list_append(acc.c, coalesce(acc.c[-1], 0))} END, {'size': -1::BIGINT, 'c': []::INT[]}) AS q FROM d)
        , u AS (SELECT doc_id, r, unnest(l) AS line, unnest(q.c) AS chunk, unnest(range(1, len(l) + 1)) AS pos FROM c)
        SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY pos) AS text, count(*)::INT AS lines FROM u GROUP BY doc_id, r, chunk""",
    "event_tumbling": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "event_sliding": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (h) HOUR, '%Y-%m-%d %H:%M') AS start, count(*) AS events FROM events, range(0, 6) AS t(h) WHERE ts IS NOT NULL GROUP BY 1",
    "event_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM s GROUP BY user_id, k""",
    "ring_buffer": "WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank, event_id, value FROM events) SELECT event_type, rank::INT AS rank, event_id, value FROM r WHERE rank <= 60",
}
