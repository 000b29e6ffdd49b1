"""All queries of the reference operators, and their SQL."""

from __future__ import annotations

from . import board_queries, core_queries, document_queries, source_queries, strategy_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES
