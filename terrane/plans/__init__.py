"""Queries that apply the library's operators to the tables at hand, each with the same in DuckDB's SQL where SQL can express it."""

from terrane.plans import queries_compliance, queries_events, queries_fields, queries_reports, queries_routes, queries_spatial

_MODULES = (queries_reports, queries_compliance, queries_spatial, queries_events, queries_fields, queries_routes)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
