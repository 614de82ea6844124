"""Registered queries: each module builds them from operators over the given tables."""

from __future__ import annotations

import importlib

MODULES = ("corpus", "features", "ultra", "brands", "rules", "findings", "evaluation", "enrichment", "streams", "models")


def load_all():
    from lurewatch.plans.registry import QUERIES

    for m in MODULES:
        importlib.import_module(f"lurewatch.plans.{m}")
    return dict(QUERIES)
