"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import queries_class, queries_join, queries_scan, queries_text, queries_vectors

MODULES = (queries_text, queries_class, queries_join, queries_scan, queries_vectors)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
