"""Interval operators: tables of half-open runs [start, end) by key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 64


def sorted_join(df: DataFrame) -> DataFrame:
    """The table marked for sort-merge joins: one of runs or operations packs so well that files of a few MB, which Spark would broadcast,
    are hundreds of MB in the driver."""
    return df.hint("merge")


def coalesce_runs(runs: DataFrame, keys: Sequence[str], values: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """Neighbouring runs of equal values joined: each island's least start and greatest end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    joins = F.lag(end).over(w) == F.col(start)
    for v in values:
        joins = joins & F.lag(v).over(w).eqNullSafe(F.col(v))
    flagged = runs.withColumn("_new", F.when(joins, 0).otherwise(1))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("_island", island).groupBy(*keys, *values, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def coalesce_descending(runs: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Runs that arrive in `order`, each joined to the one before where it ends at that one's start, as backspaces do: (*keys, start, end, pieces)."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag("start").over(w) == F.col("end"), 0).otherwise(1)
    islands = runs.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("pieces")).drop("_island")


def explode_runs(runs: DataFrame, unit: str = "lv", start: str = "start", end: str = "end") -> DataFrame:
    """A row for each operation."""
    return runs.filter(F.col(start) < F.col(end)).withColumn(unit, F.explode(F.sequence(F.col(start), F.col(end) - 1)))


def take_max(runs: DataFrame, most: int, start: str = "start", end: str = "end") -> DataFrame:
    """Runs cut into pieces of `most` operations at most, from their starts."""
    cut = F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(most).cast("long")))
    return runs.filter(F.col(start) < F.col(end)).withColumn("_at", cut).withColumn(end, F.least(F.col(end), F.col("_at") + most)).withColumn(start, F.col("_at")).drop("_at")


def clip(runs: DataFrame, low: Column, high: Column, start: str = "start", end: str = "end") -> DataFrame:
    """The parts of runs within [low, high); runs that only touch it are left out."""
    inside = runs.filter((F.col(start) < high) & (F.col(end) > low))
    return inside.withColumns({start: F.greatest(F.col(start), low), end: F.least(F.col(end), high)})


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins that a run lies in."""
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def intersect_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int = BIN) -> DataFrame:
    """Interval join: the intersections of runs of a and b with equal keys, with the other columns of both.

    Runs meet by equality of a bin of `width` operations, so the join is a hash or merge join on (keys, bin) with a
    range condition, not a nested loop; a pair counts in the bin where the intersection starts.
    """
    x = a.filter("start < end").select(*a.columns, F.explode(bins(F.col("start"), F.col("end"), width)).alias("_bin"))
    y = b.filter("start < end").select(*(F.col(c).alias({"start": "_s", "end": "_e"}.get(c, c)) for c in b.columns), F.explode(bins(F.col("start"), F.col("end"), width)).alias("_bin"))
    met = x.join(sorted_join(y), [*keys, "_bin"]).filter((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")))
    cut = met.withColumns({"start": F.greatest("start", "_s"), "end": F.least("end", "_e")}).filter(F.floor(F.col("start") / width) == F.col("_bin"))
    return cut.drop("_bin", "_s", "_e")


def zip_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int = BIN) -> DataFrame:
    """Aligned interval join of two gapless covers of the same operations: cut at every boundary of either."""
    return intersect_runs(a, b, keys, width)


def lookup(points: DataFrame, runs: DataFrame, keys: Sequence[str], point: str = "lv", width: int = BIN, how: str = "inner") -> DataFrame:
    """Points with the run that holds them and their offset in it."""
    named = lambda c: F.col(c).alias(f"_y_{c}")
    y = runs.filter("start < end").withColumn("_bin", F.explode(bins(F.col("start"), F.col("end"), width))).select(*map(named, [*runs.columns, "_bin"]))
    x = points.withColumn("_bin", F.floor(F.col(point) / width))
    on = (F.col("_y_start") <= F.col(point)) & (F.col(point) < F.col("_y_end"))
    for k in [*keys, "_bin"]:
        on = on & (F.col(k) == F.col(f"_y_{k}"))
    met = x.join(sorted_join(y), on, how)
    return met.select(*points.columns, *(F.col(f"_y_{c}").alias(c) for c in runs.columns if c not in keys), (F.col(point) - F.col("_y_start")).alias("offset"))


def gaps(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The gaps between successive runs of a key."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("_from", before).filter(F.col("_from") < F.col("start")).select(*keys, F.col("_from").alias("start"), F.col("start").alias("end"))


def runs_and_gaps(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs and the gaps between them: (*keys, start, end, is_gap)."""
    held = runs.select(*keys, "start", "end", F.lit(False).alias("is_gap"))
    return held.union(gaps(runs, keys).withColumn("is_gap", F.lit(True)))


def next_run(points: DataFrame, runs: DataFrame, keys: Sequence[str], point: str = "lv") -> DataFrame:
    """For each point the start of the first run that ends after it, or null: a union of both, ordered, and the least start that follows."""
    rows = points.select(*keys, F.col(point).alias("_at"), F.lit(0).alias("_run"), F.col(point), F.lit(None).cast("long").alias("_start"))
    rows = rows.union(runs.select(*keys, F.col("end").alias("_at"), F.lit(1).alias("_run"), F.lit(None).cast("long"), F.col("start")))
    # at one place a run that ends there comes before the point
    w = Window.partitionBy(*keys).orderBy("_at", F.desc("_run")).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("next_start", F.first("_start", ignorenulls=True).over(w)).filter("_run = 0").select(*keys, point, "next_start")


def overlaps(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs that begin before an earlier one of their key ends: none in a sound table."""
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_before", F.max("end").over(w)).filter(F.col("_before") > F.col("start")).drop("_before")


def lv_at_offset(start: Column, end: Column, fwd: Column, offset: Column) -> Column:
    """The operation at an offset of a run that may run backwards."""
    return F.when(fwd, start + offset).otherwise(end - offset - 1)
