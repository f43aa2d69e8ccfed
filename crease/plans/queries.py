"""The registered queries of the core and their SQL."""

from __future__ import annotations

from crease.operators import auction, dimensions, drift, facts, features, identity, leagues, models, nested, packed, relations, texts, units, validation
from crease.streaming import live

MODULES = (units, drift, packed, nested, facts, features, leagues, dimensions, identity, auction, models, relations, texts, validation, live)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in getattr(m, "SQL", {}).items()}
