"""All registered queries of the core."""
from __future__ import annotations

from . import record_queries, text_queries, training_queries

QUERIES = {**text_queries.QUERIES, **record_queries.QUERIES, **training_queries.QUERIES}
ORACLES: dict[str, str] = {**text_queries.ORACLES, **record_queries.ORACLES}
