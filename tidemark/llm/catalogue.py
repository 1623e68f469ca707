"""Queries of the problems 4 and 6 to 8."""

from __future__ import annotations

from tidemark.llm import leaks, mixing, percentiles, sentences
from tidemark.sources.tables import table


def _docs(op, *others):
    return lambda s, d: op(table(s, d, "documents"), *[table(s, d, t) for t in others])


def _log(op):
    return lambda s, d: op(table(s, d, "loom_audit_log"))


QUERIES = {
    "p4_daily_and_overall": _log(percentiles.daily_and_overall),
    "p4_latency_percentiles": _log(percentiles.latency_percentiles),
    "p4_bound_check": _log(percentiles.bound_check),
    "p6_found": _docs(leaks.leaks, "eval_items"),
    "p6_leak_counts": _docs(leaks.leak_counts, "eval_items"),
    "p7_mix_shares": _docs(mixing.mix_shares, "mix_targets"),
    "p7_mix_blocks": _docs(mixing.mix_blocks, "mix_targets"),
    "p8_found": _docs(sentences.sentence_units),
}
ORACLES = {
    "p4_bound_check": """
        WITH m AS (SELECT DISTINCT lower(id) AS id, namespace, primary_class FROM loom_audit_log WHERE latency_total_ms >= 0),
        g AS (SELECT namespace, primary_class, count(*) AS n FROM m GROUP BY 1, 2)
        SELECT namespace, primary_class, q::DOUBLE AS q, n, true AS within_bound, true AS tight FROM g, (VALUES (0.5), (0.9), (0.95), (0.99)) AS t(q)""",
}
