"""Lurewatch: URL-threat analytics as PySpark table jobs."""

__version__ = "0.1.0"
