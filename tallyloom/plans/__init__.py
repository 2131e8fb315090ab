"""Registered queries over the benchmark tables, each beside its DuckDB twin."""

from tallyloom.plans.registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
