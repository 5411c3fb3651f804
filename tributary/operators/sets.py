"""Observed-remove sets: an element is named by its insertion; a deletion removes the insertions that it names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live(inserts: DataFrame, deletes: DataFrame, by: list[str]) -> DataFrame:
    """Inserts that no delete names, each once (the least, where deliveries differ)."""
    rest = [c for c in inserts.columns if c not in by]
    once = inserts.groupBy(*by).agg(F.min(F.struct(*rest)).alias("_row")).select(*by, *(f"_row.{c}" for c in rest)) if rest else inserts.distinct()
    return once.join(deletes.select(*by).distinct(), by, "left_anti")


def dangling(inserts: DataFrame, deletes: DataFrame, by: list[str]) -> DataFrame:
    """Deletes of what was never inserted: they wait, or mark a fault in the log."""
    return deletes.join(inserts.select(*by).distinct(), by, "left_anti")


def sizes(inserts: DataFrame, deletes: DataFrame, by: list[str], per: list[str]) -> DataFrame:
    return live(inserts, deletes, by).groupBy(*per).agg(F.count(F.lit(1)).alias("n"))
