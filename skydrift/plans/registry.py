"""Where the catalogue modules put their queries and SQL checks."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MODULES = ["bands", "preparation", "pairs", "vectors", "labels", "datasets", "experiments", "probing", "files", "streams", "composites", "whole_reports"]


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under a name, with its SQL where there is one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"skydrift.plans.catalog.{m}")
