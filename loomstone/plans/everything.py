"""All queries of the engine's own operators and their SQL, by name."""

from __future__ import annotations

from . import catalogue, ingest, small

assert small.query is catalogue.query is ingest.query  # their queries are in the same tables
QUERIES, SQL = catalogue.QUERIES, catalogue.SQL
