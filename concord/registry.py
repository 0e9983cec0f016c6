"""All queries of the library by name, with their SQL for comparison where SQL can express them."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concord import plans

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    names = sorted((m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.endswith("_queries")), reverse=True)
    return [importlib.import_module(f"{plans.__name__}.{n}") for n in names]


def queries() -> dict[str, Query]:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.ORACLE.items()}
