"""Queries of facts, entities and episodes, with SQL."""

from __future__ import annotations

from tidemark.operators import memory as m
from tidemark.plans.metrics import E_, EN, EP, F_, FA, N_, PR, of
from tidemark.sources.tables import table

NEW = "loom_new_episodes"


def deleted_rows(s, d):
    out = [m.deleted(table(s, d, t), t) for t in (EN, FA, EP)]
    return out[0].unionByName(out[1]).unionByName(out[2])


QUERIES = {
    "deleted_rows": deleted_rows,
    "current_facts": of(m.current_facts, FA),
    "validity_interval_as_of": of(m.facts_as_of, FA),
    "duplicate_fact_rank": of(m.duplicate_facts, FA),
    "supersede_facts": of(m.supersede, FA),
    "fact_subject_object_names": of(m.fact_names, FA, EN),
    "facts_by_entity": of(m.entity_degree, FA, EN),
    "facts_by_entity_current": of(m.entity_facts, FA, EN),
    "facts_by_entity_historical": of(m.entity_facts, FA, EN, historical=True),
    "recall_current": of(m.recall, FA, EN),
    "recall_historical": of(m.recall, FA, EN, historical=True),
    "entity_type_validation": of(m.valid_types, EN),
    "best_mode_lateral": of(m.best_mode, FA, EP),
    "semi_join_in": of(m.superseding_facts, FA),
    "anti_join_not_in": of(m.uncited_episodes, EP, FA),
    "seed_exists": of(m.already_stored, NEW, EP),
    "upsert_episodes": of(m.upsert_episodes, NEW, EP),
    "content_hash": of(m.hash_check, EP),
    "dedup_by_content_hash": of(m.repeats, EP, keys=["namespace", "content_hash"]),
    "dedup_by_source_event": of(m.repeats, EP, keys=["namespace", "source", "source_event_id"]),
    "validate_episodes": of(m.invalid_episodes, EP),
    "alias_set_merge": of(m.alias_set_merge, EN),
    "resolve_entity": of(m.resolve_aliases, EN),
    "entity_provenance_append": of(m.provenance, EN, FA),
    "namespace_reference_check": of(m.namespace_mismatch, FA, EN),
    "predicate_inverses": of(m.missing_inverses, FA, PR),
    "supersession_chain_roots": of(m.chain_roots, FA),
    "detect_patterns": of(m.repeated_predicates, FA),
    "workflow_chains": of(m.workflow_chains, FA),
    "confidence_step": of(m.procedure_confidence, FA),
}

FN_ = "WITH f0 AS (SELECT DISTINCT ON (lower(id)) * FROM loom_facts WHERE deleted_at IS NULL ORDER BY lower(id)), f AS (SELECT * REPLACE (lower(subject_id) AS subject_id, lower(object_id) AS object_id, lower(superseded_by) AS superseded_by) FROM f0)\n"
_MODES = "CASE ingestion_mode WHEN 'live_mcp_capture' THEN 1 WHEN 'user_authored_seed' THEN 2 WHEN 'vendor_import' THEN 3 END"
_ALIAS = "al AS (SELECT lower(id) AS entity_id, name, entity_type, namespace, unnest(list_distinct(json_extract_string(properties, '$.aliases[*]'))) AS alias FROM n)"
_REPEAT = """WITH e AS (SELECT DISTINCT ON (lower(id)) * FROM loom_episodes ORDER BY lower(id), ingested_at NULLS LAST),
    r AS (SELECT id, first_value(id) OVER (PARTITION BY {k} ORDER BY ingested_at NULLS LAST, id) AS first_id FROM e WHERE {nn}) SELECT id, first_id FROM r WHERE id <> first_id"""
_HISTORY = "WITH f AS (SELECT DISTINCT ON (lower(id)) lower(id) AS fact_id, namespace, lower(subject_id) AS subject_id, predicate, lower(object_id) AS object_id, CASE WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN valid_until IS NOT NULL THEN 'closed' ELSE 'current' END AS state FROM loom_facts ORDER BY lower(id), deleted_at NULLS FIRST), "
_NAMES = ", k AS (SELECT namespace, lower(name) AS name, min(lower(id)) AS e FROM n WHERE name IS NOT NULL GROUP BY 1, 2)"
_BY_ID = "SELECT lower(n.id) AS entity_id, f.namespace, fact_id, subject_id, predicate, object_id, state FROM n JOIN f ON f.namespace = n.namespace AND (f.subject_id = lower(n.id) OR f.object_id = lower(n.id))"
_BY_NAME = "SELECT k.namespace, k.name, k.e AS entity_id, fact_id, subject_id, predicate, object_id, state FROM k JOIN f ON f.namespace = k.namespace AND (f.subject_id = k.e OR f.object_id = k.e)"
ORACLES = {
    "facts_by_entity_current": _HISTORY + N_ + _BY_ID + " WHERE state = 'current'",
    "facts_by_entity_historical": _HISTORY + N_ + _BY_ID,
    "recall_current": _HISTORY + N_ + _NAMES + _BY_NAME + " WHERE state = 'current'",
    "recall_historical": _HISTORY + N_ + _NAMES + _BY_NAME,
    "entity_type_validation": "WITH " + N_ + "SELECT lower(id) AS entity_id, name, entity_type, namespace FROM n WHERE lower(entity_type) IN ('person', 'organization', 'project', 'service', 'technology', 'pattern', 'environment', 'document', 'metric', 'decision')",
    "deleted_rows": " UNION ALL ".join(f"SELECT '{t}' AS source_table, id, namespace, strftime(deleted_at, '%Y-%m-%d') AS day FROM (SELECT DISTINCT ON (lower(id)) * FROM {t} WHERE deleted_at IS NOT NULL ORDER BY lower(id))" for t in (EN, FA, EP)),
    "current_facts": FN_ + "SELECT id, namespace, subject_id, predicate, object_id FROM f WHERE valid_until IS NULL",
    "validity_interval_as_of": FN_ + f"SELECT id, subject_id, predicate, object_id FROM f WHERE valid_from <= TIMESTAMP '2025-07-01 00:00:00' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2025-07-01 00:00:00')",
    "duplicate_fact_rank": FN_ + ", r AS (SELECT id, row_number() OVER (PARTITION BY namespace, subject_id, predicate, object_id, source_episodes ORDER BY created_at NULLS LAST, id) AS rank FROM f) SELECT id, rank::INT AS rank FROM r WHERE rank > 1",
    "supersede_facts": FN_ + """
        , k AS (SELECT *, epoch_us(valid_from) AS us, row_number() OVER (PARTITION BY namespace, subject_id, predicate, valid_from ORDER BY id) AS rn FROM f WHERE valid_from IS NOT NULL AND namespace IS NOT NULL AND subject_id IS NOT NULL AND predicate IS NOT NULL AND object_id IS NOT NULL)
        , w AS (SELECT namespace, subject_id, predicate, us, id AS w_id, object_id AS w_obj FROM k WHERE rn = 1)
        , o AS (SELECT k.id, k.us, k.namespace, k.subject_id, k.predicate, k.object_id, w.w_id, w.w_obj FROM k JOIN w USING (namespace, subject_id, predicate, us))
        , later AS (SELECT o.id, arg_min(w.w_id, w.us) AS w_id, min(w.us) AS us FROM o JOIN w ON o.namespace = w.namespace AND o.subject_id = w.subject_id AND o.predicate = w.predicate AND w.us > o.us AND w.w_obj <> o.object_id GROUP BY 1)
        SELECT o.id, CASE WHEN o.w_obj <> o.object_id THEN o.w_id ELSE l.w_id END AS replaced_by, CASE WHEN o.w_obj <> o.object_id THEN o.us ELSE l.us END AS closes_us
        FROM o LEFT JOIN later l USING (id) WHERE o.w_obj <> o.object_id OR l.w_id IS NOT NULL""",
    "fact_subject_object_names": FN_ + ", " + N_ + "SELECT f.id, f.namespace, s.name AS subject, predicate, o.name AS object FROM f JOIN n s ON lower(s.id) = subject_id JOIN n o ON lower(o.id) = object_id WHERE valid_until IS NULL",
    "facts_by_entity": FN_ + ", " + N_ + """, x AS (SELECT subject_id AS e, 1 AS s, valid_until IS NULL AS c FROM f UNION ALL SELECT object_id, 0, valid_until IS NULL FROM f)
        , g AS (SELECT e, sum(s)::BIGINT AS as_subject, sum(1 - s)::BIGINT AS as_object, count(*) FILTER (WHERE c) AS current FROM x GROUP BY 1)
        SELECT lower(n.id) AS entity_id, entity_type, coalesce(as_subject, 0) AS as_subject, coalesce(as_object, 0) AS as_object, coalesce(current, 0) AS current FROM n LEFT JOIN g ON g.e = lower(n.id)""",
    "best_mode_lateral": E_ + ", " + F_ + f""", p AS (SELECT lower(id) AS e, {_MODES} AS m FROM e)
        , r AS (SELECT id, unnest(source_episodes) AS e FROM f), b AS (SELECT r.id, min(m) AS m FROM r JOIN p ON p.e = lower(r.e) GROUP BY 1)
        SELECT f.id, CASE m WHEN 1 THEN 'live_mcp_capture' WHEN 2 THEN 'user_authored_seed' WHEN 3 THEN 'vendor_import' END AS mode FROM f LEFT JOIN b USING (id)""",
    "semi_join_in": FN_ + "SELECT lower(id) AS id FROM f WHERE lower(id) IN (SELECT superseded_by FROM f WHERE superseded_by IS NOT NULL)",
    "anti_join_not_in": E_ + ", c AS (SELECT DISTINCT lower(x) AS id FROM (SELECT unnest(source_episodes) AS x FROM loom_facts WHERE deleted_at IS NULL) WHERE x IS NOT NULL) SELECT lower(e.id) AS id, namespace FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = lower(e.id))",
    "seed_exists": """WITH d AS (SELECT *, coalesce(regexp_replace(lower(content_hash), '^sha256:', ''), sha256(content)) AS h FROM loom_new_episodes), e AS (SELECT *, regexp_replace(lower(content_hash), '^sha256:', '') AS h FROM loom_episodes)
        SELECT delivery_id, 'content_hash' AS matched FROM d WHERE EXISTS (SELECT 1 FROM e WHERE e.namespace = d.namespace AND e.h = d.h)
        UNION ALL SELECT delivery_id, 'source_event_id' FROM d WHERE EXISTS (SELECT 1 FROM e WHERE e.namespace = d.namespace AND e.source = d.source AND e.source_event_id = d.source_event_id)""",
    "upsert_episodes": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY namespace, source, source_event_id ORDER BY delivered_at NULLS LAST, delivery_id) AS rn FROM loom_new_episodes),
        x AS (SELECT *, source_event_id IS NOT NULL AND rn = 1 AND NOT EXISTS (SELECT 1 FROM loom_episodes e WHERE e.namespace = r.namespace AND e.source = r.source AND e.source_event_id = r.source_event_id) AS new FROM r)
        SELECT batch_id, count(*) FILTER (WHERE new) AS inserted, count(*) FILTER (WHERE source_event_id IS NOT NULL AND NOT new) AS existing, count(*) FILTER (WHERE source_event_id IS NULL) AS without_id FROM x GROUP BY 1""",
    "content_hash": E_ + "SELECT id, sha256(content) AS sha FROM e WHERE sha256(content) IS DISTINCT FROM regexp_replace(lower(content_hash), '^sha256:', '')",
    "dedup_by_content_hash": _REPEAT.format(k="namespace, content_hash", nn="namespace IS NOT NULL AND content_hash IS NOT NULL"),
    "dedup_by_source_event": _REPEAT.format(k="namespace, source, source_event_id", nn="namespace IS NOT NULL AND source IS NOT NULL AND source_event_id IS NOT NULL"),
    "validate_episodes": E_ + """
        SELECT id, 'blank_content' AS rule FROM e WHERE coalesce(trim(content) = '', true) UNION ALL SELECT id, 'blank_source' FROM e WHERE coalesce(trim(source) = '', true)
        UNION ALL SELECT id, 'blank_namespace' FROM e WHERE coalesce(trim(namespace) = '', true)
        UNION ALL SELECT id, 'unknown_mode' FROM e WHERE coalesce(ingestion_mode NOT IN ('live_mcp_capture', 'user_authored_seed', 'vendor_import'), true)
        UNION ALL SELECT id, 'vendor_without_parser' FROM e WHERE ingestion_mode = 'vendor_import' AND (parser_version IS NULL OR parser_source_schema IS NULL)
        UNION ALL SELECT id, 'parser_without_vendor' FROM e WHERE ingestion_mode <> 'vendor_import' AND (parser_version IS NOT NULL OR parser_source_schema IS NOT NULL)
        UNION ALL SELECT id, 'ingested_before_it_happened' FROM e WHERE ingested_at < occurred_at""",
    "alias_set_merge": "WITH " + N_ + """, x AS (SELECT lower(name) AS key, entity_type, namespace, unnest(list_concat([name], coalesce(json_extract_string(properties, '$.aliases[*]'), []))) AS a FROM n)
        SELECT key, entity_type, namespace, coalesce(array_to_string(list_sort(list(DISTINCT a) FILTER (WHERE a IS NOT NULL)), '|'), '') AS aliases FROM x GROUP BY 1, 2, 3""",
    "resolve_entity": "WITH " + N_ + ", " + _ALIAS + """
        , nm AS (SELECT lower(name) AS k, entity_type, namespace, min(lower(id)) AS exact_id FROM n GROUP BY 1, 2, 3)
        , fm AS (SELECT alias, entity_type, namespace, min(entity_id) AS alias_id FROM al GROUP BY 1, 2, 3 HAVING count(DISTINCT entity_id) = 1)
        SELECT al.entity_id || '#' || al.alias AS mention_id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN alias_id IS NOT NULL THEN 'alias' ELSE 'new' END AS method,
          (CASE WHEN exact_id IS NOT NULL THEN 1.0 WHEN alias_id IS NOT NULL THEN 0.95 ELSE 0.0 END)::DOUBLE AS confidence, coalesce(exact_id, alias_id) AS entity_id
        FROM al LEFT JOIN nm ON nm.k = lower(al.alias) AND nm.entity_type = al.entity_type AND nm.namespace = al.namespace
        LEFT JOIN fm ON fm.alias = al.alias AND fm.entity_type = al.entity_type AND fm.namespace = al.namespace""",
    "entity_provenance_append": FN_ + """, k AS (SELECT DISTINCT lower(id) AS id FROM loom_entities WHERE deleted_at IS NULL)
        , p AS (SELECT lower(id) AS entity_id, lower(unnest(source_episodes)) AS e FROM loom_entities WHERE deleted_at IS NULL
                UNION SELECT subject_id, lower(unnest(source_episodes)) FROM f UNION SELECT object_id, lower(unnest(source_episodes)) FROM f)
        SELECT entity_id, count(DISTINCT e) AS episodes FROM p WHERE e IS NOT NULL AND entity_id IN (SELECT id FROM k) GROUP BY 1""",
    "namespace_reference_check": FN_ + ", " + N_ + """, x AS (SELECT id, 'subject_id' AS field, namespace, subject_id AS e FROM f UNION ALL SELECT id, 'object_id', namespace, object_id FROM f)
        SELECT x.id, field, x.namespace, n.namespace AS other FROM x JOIN n ON lower(n.id) = x.e WHERE x.namespace <> n.namespace""",
    "predicate_inverses": FN_ + """, c AS (SELECT DISTINCT namespace, subject_id, predicate, object_id FROM f WHERE valid_until IS NULL)
        SELECT c.predicate, p.inverse, count(*) AS facts, count(b.predicate) AS with_inverse FROM c JOIN loom_predicates p ON p.predicate = c.predicate AND p.inverse IS NOT NULL
        LEFT JOIN c b ON b.namespace = c.namespace AND b.subject_id = c.object_id AND b.object_id = c.subject_id AND b.predicate = p.inverse GROUP BY 1, 2""",
    "supersession_chain_roots": FN_.replace("WITH ", "WITH RECURSIVE ", 1) + """, l AS (SELECT lower(id) AS id, superseded_by AS nxt FROM f)
        , v AS (SELECT l.id, l.nxt FROM l WHERE nxt IN (SELECT id FROM l))
        , w AS (SELECT id, nxt AS pos, 1::BIGINT AS hops, [id] AS path FROM v
                UNION ALL SELECT w.id, v.nxt, w.hops + 1, list_append(w.path, w.pos) FROM w JOIN v ON v.id = w.pos WHERE NOT list_contains(w.path, w.pos))
        , tail AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops DESC) AS rn FROM w)
        SELECT id, CASE WHEN NOT list_contains(path, pos) THEN pos END AS root, CASE WHEN NOT list_contains(path, pos) THEN hops END AS hops FROM tail WHERE rn = 1""",
    "detect_patterns": FN_ + """, x AS (SELECT DISTINCT id, subject_id, predicate, object_id, lower(unnest(source_episodes)) AS episode_id FROM f)
        SELECT episode_id, predicate, count(*) AS uses, count(DISTINCT subject_id) AS subjects, count(DISTINCT object_id) AS objects FROM x WHERE episode_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""",
    "workflow_chains": FN_ + "SELECT a.namespace, a.predicate, count(*) AS chains, count(DISTINCT a.object_id) AS middles FROM f a JOIN f b ON a.namespace = b.namespace AND a.predicate = b.predicate AND a.object_id = b.subject_id GROUP BY 1, 2",
    "confidence_step": FN_ + """, x AS (SELECT namespace, predicate, lower(unnest(source_episodes)) AS e FROM f), g AS (SELECT namespace, predicate, count(DISTINCT e) AS observations FROM x WHERE e IS NOT NULL GROUP BY 1, 2)
        SELECT *, round(1 - 0.7::DOUBLE * pow(0.85::DOUBLE, observations - 1), 6) AS confidence, (1 - 0.7::DOUBLE * pow(0.85::DOUBLE, observations - 1)) >= 0.8 AND observations >= 3 AS promoted FROM g""",
}
