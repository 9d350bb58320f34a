"""All queries of the core and the SQL that checks them."""

from __future__ import annotations

from sheafwork.plans import cells, edges, grid, instants, layout, pages, quotes, texts, units

_MODULES = (instants, units, texts, quotes, layout, cells, grid, pages, edges)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
