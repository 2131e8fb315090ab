"""One registry of runnable queries: Spark builder, oracle SQL and the survey rows it covers."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "influence",
    "matrices",
    "records",
    "joins",
    "lossstats",
    "evalmetrics",
    "textmetrics",
    "predictor",
    "sources",
    "streams",
)


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    def add(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), build, sql)
        return build

    return add


def load_all() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"tallyloom.plans.{module}")
    return REGISTRY
