"""Registered queries over the driver tables and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import ORACLES, QUERIES, Query


def _load() -> None:
    from . import extraction, notices, pages, programs, runs  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return all_queries()["verify_reports"](spark, folder)
