"""Registered queries of the redaction operators, each with its DuckDB counterpart."""

from __future__ import annotations

from . import box_queries, frame_queries, job_queries, score_queries

PARTS = (box_queries, score_queries, job_queries, frame_queries)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
