"""All queries of the package by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Model
from . import mining
from .reports import REPORTS, Report


def _run(report: Report) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report.plan(Model(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _run(r) for name, r in REPORTS.items()}
ORACLES: dict[str, str] = {name: r.sql() for name, r in REPORTS.items()}
QUERIES |= mining.QUERIES
ORACLES |= mining.ORACLES
