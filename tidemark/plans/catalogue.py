"""All core queries by name."""

from __future__ import annotations

from tidemark.plans import lookups, memory, metrics, problems, retrieval

QUERIES = {**problems.QUERIES, **metrics.QUERIES, **memory.QUERIES, **retrieval.QUERIES, **lookups.QUERIES}
ORACLES = {**problems.ORACLES, **metrics.ORACLES, **memory.ORACLES, **retrieval.ORACLES, **lookups.ORACLES}
FLAGSHIP = "p5_periods"
