"""All named queries outside the training-data subpackage, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyline.plans import assembly_queries, core, further_queries, identity_queries, ledger_queries, page_queries, repair_queries, review_queries, scalar_queries, small_queries, source_queries, view_queries

_MODULES = [core, ledger_queries, repair_queries, view_queries, scalar_queries, review_queries, page_queries, identity_queries, assembly_queries, source_queries, further_queries, small_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _MODULES:
        out |= module.ORACLE_SQL
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.QUERIES["p4_found"](spark, sf_dir)
