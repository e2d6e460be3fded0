"""Registry of named queries and their SQL oracles.

Each catalog module registers ``name -> fn(spark, sf_dir) -> DataFrame`` and,
where a SQL form exists, the equivalent DuckDB SQL over the driver's tables.
Output columns carry the same aliases on both sides; doubles are rounded to 6
places on both sides; lists are sorted and joined into strings.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so that it registers its queries."""
    import importlib
    import pkgutil

    import seedweave.plans as plans

    for mod in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if mod.startswith("catalog_"):
            importlib.import_module(f"seedweave.plans.{mod}")
