"""Deltas between logs: what a peer lacks, and ingesting what it sends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import differences
from .ids import to_remote
from .runs import gaps, intersect_runs, lookup


def ops_since(ops: DataFrame, runs: DataFrame, agents: DataFrame, known: DataFrame) -> DataFrame:
    """known (doc, q, a, b): a what the peer has, b the tip. The operations in b's history but not a's, by remote id."""
    fresh = differences(runs, known, ("b",)).select("doc", "start", "end")
    return to_remote(lookup(ops, fresh, ["doc"]).select(*ops.columns), agents)


def missing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Their operations (doc, agent, seq, ...) that we lack."""
    return theirs.join(ours.select("doc", "agent", "seq"), ["doc", "agent", "seq"], "left_anti")


def ingest(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Both logs' operations (doc, agent, seq, order, ...): ours as they are, then theirs that are new, numbered on by `order`, their causal order. Ingesting again changes nothing."""
    fresh = missing(ours, theirs.dropDuplicates(["doc", "agent", "seq"]))
    length = ours.groupBy("doc").agg((F.max("lv") + 1).alias("_n"))
    numbered = fresh.join(length, "doc", "left").withColumn("lv", F.coalesce("_n", F.lit(0)) + F.row_number().over(Window.partitionBy("doc").orderBy("order", "agent", "seq")) - 1)
    return ours.unionByName(numbered.drop("_n").select(*ours.columns))


def trim_known(theirs: DataFrame, known: DataFrame) -> DataFrame:
    """Their runs (doc, agent, start, end) without what we know (doc, agent, start, end): the parts we lack."""
    both = intersect_runs(theirs.withColumns({"t_start": F.col("start")}), known.select("doc", "agent", "start", "end"), ["doc", "agent"])
    marks = theirs.select("doc", "agent", F.col("start").alias("t_start"), F.explode(F.array("start", "end")).alias("start"))
    rows = both.select("doc", "agent", "t_start", "start", "end").union(marks.select("doc", "agent", "t_start", "start", F.col("start").alias("end")))
    return gaps(rows, ["doc", "agent", "t_start"]).select("doc", "agent", "start", "end")


def same_log(a: DataFrame, b: DataFrame, columns: list[str]) -> bool:
    """Whether two logs have the same operations, whatever their order: compare remote ids, never the logs' own numbers."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
