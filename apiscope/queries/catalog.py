"""All registered queries."""

from __future__ import annotations

from . import (response_queries, source_queries, stream_queries, table_queries,  # noqa: F401
               text_queries, url_queries)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
