"""Independent DuckDB statements for every SQL-expressible query (``ORACLES``: query name -> SQL)."""

from __future__ import annotations


def all_oracles() -> dict[str, str]:
    import importlib
    import pkgutil


    out: dict[str, str] = {}
    for info in pkgutil.iter_modules(__path__):
        mod = importlib.import_module(f"oracles.{info.name}")
        out.update(getattr(mod, "ORACLES", {}))
    return out
