"""All queries of the subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

from strandline.llm import event_queries, text_queries, vector_queries

MODULES = [event_queries, text_queries, vector_queries]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
