"""All core queries and their SQL, by name."""

from __future__ import annotations

from edgeloom.plans import api, etl, quality, verb_queries, views

FLAGSHIP = "unreachable"
QUERIES = {**quality.QUERIES, **verb_queries.QUERIES, **views.QUERIES, **api.QUERIES, **etl.QUERIES}
SQL = {**quality.SQL, **verb_queries.SQL, **views.SQL, **api.SQL, **etl.SQL}
