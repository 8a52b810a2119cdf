"""Registered queries and their SQL: one pair for each operator."""

from __future__ import annotations

from . import queries_events, queries_fleet, queries_reports, queries_text

QUERIES: dict = {}
SQL: dict = {}
for _module in (queries_events, queries_fleet, queries_reports, queries_text):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
