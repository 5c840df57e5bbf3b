"""All label queries and their SQL."""

from __future__ import annotations

from tagsmith import queries_beyond, queries_images, queries_lines, queries_ocr, queries_requests  # noqa: F401  register their queries
from tagsmith.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
