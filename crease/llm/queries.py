"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from crease.llm import canonical, matching, mixing, names, packing, residue

MODULES = (names, canonical, matching, packing, mixing, residue)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in getattr(m, "SQL", {}).items()}
