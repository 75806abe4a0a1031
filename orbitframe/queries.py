"""The registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from orbitframe.registry import certified, files, functions, interactions, proofs, reports, selection, series, structure, surfaces

MODULES = (certified, proofs, selection, structure, series, functions, interactions, surfaces, reports, files)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
