"""All queries of the reference's operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexmill.plans import (  # noqa: F401
    aggregates,
    bodies,
    candidates,
    drafts,
    extra,
    graphs,
    joins,
    ledgers,
    pages,
    reviews,
    scalars,
    similarity,
    sources,
    windows,
)
from lexmill.plans.base import ORACLES, QUERIES, Tables
from lexmill.operators.dedup import duplicate_report

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir: str) -> DataFrame:
    """Exact duplicates, and each source's signal tier."""
    return duplicate_report(Tables(spark, sf_dir).sources())
