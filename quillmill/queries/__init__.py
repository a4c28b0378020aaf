"""The registered queries of the library and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package; each has queries() and oracle_sql().
MODULES = ("bibliometrics", "corpus", "networks", "records", "texts")

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").queries()
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").oracle_sql()
    return out
