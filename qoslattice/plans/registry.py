"""Queries by name, and their SQL twins."""

from __future__ import annotations

from . import dossiers, endpoints, insight, lattice, loading, stores

MODULES = (lattice, endpoints, insight, loading, stores, dossiers)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
