"""Registered queries and their SQL twins."""

from __future__ import annotations

from quillon.plans import driver_files, driver_tables

QUERIES = driver_tables.QUERIES | driver_files.QUERIES
ORACLE_SQL = driver_tables.ORACLE_SQL | driver_files.ORACLE_SQL
