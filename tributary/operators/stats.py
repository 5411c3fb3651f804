"""Statistics and soundness of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import ask, tip_versions
from .runs import intersect_runs


def log_stats(runs: DataFrame, agents: DataFrame) -> DataFrame:
    """(doc, n_ops, n_runs, n_merges, n_roots, n_agents, n_agent_runs)."""
    of_runs = runs.groupBy("doc").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_ops"),
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.size("parents") >= 2).alias("n_merges"),
        F.count_if(F.size("parents") == 0).alias("n_roots"),
    )
    return of_runs.join(agents.groupBy("doc").agg(F.countDistinct("agent").alias("n_agents"), F.count(F.lit(1)).alias("n_agent_runs")), "doc")


def op_shapes(text: DataFrame) -> DataFrame:
    """(kind, shape, ops, characters): shape is single, forward or backward."""
    shape = F.when(F.col("n") == 1, "single").when(F.col("fwd"), "forward").otherwise("backward")
    return text.groupBy("kind", shape.alias("shape")).agg(F.count(F.lit(1)).alias("ops"), F.sum("n").alias("characters"))


def text_stats(text: DataFrame) -> DataFrame:
    """(doc, inserted, deleted, keystrokes, content_bytes)."""
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    return text.groupBy("doc").agg(n("Ins").alias("inserted"), n("Del").alias("deleted"), F.sum("n").alias("keystrokes"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).cast("long").alias("content_bytes"))


def many_rooted(runs: DataFrame) -> DataFrame:
    """(doc, n_roots) of documents whose history has several roots."""
    return runs.filter(F.size("parents") == 0).groupBy("doc").agg(F.count(F.lit(1)).alias("n_roots")).filter("n_roots > 1")


def order_violations(runs: DataFrame, agents: DataFrame) -> DataFrame:
    """(doc, agent, lv): first operations of an agent's runs that don't have the agent's previous operation in their history."""
    before = F.lag(F.col("lv_end") - 1).over(Window.partitionBy("doc", "agent").orderBy("lv_start"))
    asked = agents.withColumn("before", before).filter("before IS NOT NULL").select("doc", "agent", "lv_start", "before")
    return ask(runs, asked, lambda h, q: [(q["doc"], q["agent"], q["lv_start"])] if not h.contains(h.parents_of(int(q["lv_start"])), int(q["before"])) else [], "doc long, agent string, lv long")


def filled_times(ops: DataFrame, times: DataFrame) -> DataFrame:
    """ops (doc, agent, seq) with the time known for the operation or else the agent's last one before it."""
    w = Window.partitionBy("doc", "agent").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return ops.join(times, ["doc", "agent", "seq"], "left").withColumn("time", F.last("time", ignorenulls=True).over(w))


def repeated(runs: DataFrame, times: int) -> DataFrame:
    """The log `times` over, each copy's roots on the tips of the copy before: (doc, copy, start, end, parents)."""
    length = runs.groupBy("doc").agg(F.max("end").alias("_n"))
    copies = runs.join(length, "doc").join(tip_versions(runs).withColumnRenamed("version", "_tips"), "doc").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    shift = F.col("copy") * F.col("_n")
    on = F.when((F.size("parents") == 0) & (F.col("copy") > 0), F.transform("_tips", lambda p: p + shift - F.col("_n"))).otherwise(F.transform("parents", lambda p: p + shift))
    return copies.select("doc", "copy", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), on.alias("parents"))


def edit_costs(text: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (doc, q, start, end) to (doc, q, cost): how many runs of edits the operations touch."""
    ops = text.select("doc", F.col("lv").alias("start"), (F.col("lv") + F.col("n")).alias("end"))
    return intersect_runs(ops, asked.select("doc", "q", "start", "end"), ["doc"]).groupBy("doc", "q").agg(F.count(F.lit(1)).alias("cost"))
