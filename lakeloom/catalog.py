"""Every commerce query by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.functions import samples
from lakeloom.operators import board, filters, names, reconcile, runs, transform, units
from lakeloom.plans import ingest, ledger, listings, monitor, orders, reports, reviews, scoring, stock_alerts, trends, upkeep, upstream
from lakeloom.sources import readers, uploads
from lakeloom.streaming import alerts, ordered, resume

FLAGSHIP = "reconcile_diff"
MODULES = (reports, filters, reconcile, names, board, transform, runs, units, scoring, trends, ledger, readers, uploads, alerts, ordered, resume, monitor, orders, ingest, stock_alerts, upstream, reviews, listings, upkeep, samples)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
