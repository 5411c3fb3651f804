"""Names of operations: (agent, seq) and the log's own numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import coalesce_runs, gaps, intersect_runs, lookup


def agent_runs(ops: DataFrame) -> DataFrame:
    """ops (doc, lv, agent, seq) to agents (doc, lv_start, lv_end, agent, seq_start)."""
    units = ops.select("doc", "agent", F.col("lv").alias("start"), (F.col("lv") + 1).alias("end"), (F.col("lv") - F.col("seq")).alias("shift"))
    return coalesce_runs(units, ["doc", "agent", "shift"]).select("doc", F.col("start").alias("lv_start"), F.col("end").alias("lv_end"), "agent", (F.col("start") - F.col("shift")).alias("seq_start"))


def agent_dictionary(ops: DataFrame) -> DataFrame:
    """(doc, agent, agent_id): agents numbered by their first operation."""
    first = ops.groupBy("doc", "agent").agg(F.min("lv").alias("lv"))
    return first.select("doc", "agent", (F.row_number().over(Window.partitionBy("doc").orderBy("lv")) - 1).cast("long").alias("agent_id"))


def is_agent_name(name: Column) -> Column:
    """Names have fewer than 50 bytes and aren't ROOT."""
    return name.isNotNull() & (F.octet_length(name) < 50) & (name != "ROOT")


def _by_lv(agents: DataFrame) -> DataFrame:
    return agents.select("doc", F.col("lv_start").alias("start"), F.col("lv_end").alias("end"), "agent", "seq_start")


def _by_seq(agents: DataFrame) -> DataFrame:
    return agents.select("doc", "agent", F.col("seq_start").alias("start"), (F.col("seq_start") + F.col("lv_end") - F.col("lv_start")).alias("end"), "lv_start")


def to_remote(points: DataFrame, agents: DataFrame) -> DataFrame:
    """(doc, lv, ...) with agent and seq."""
    return lookup(points, _by_lv(agents), ["doc"]).withColumn("seq", F.col("seq_start") + F.col("offset")).drop("start", "end", "seq_start", "offset")


def to_local(points: DataFrame, agents: DataFrame) -> DataFrame:
    """(doc, agent, seq, ...) with lv and error: null, unknown_agent or seq_in_future."""
    known = agents.select("doc", "agent", F.lit(True).alias("known")).distinct()
    found = lookup(points, _by_seq(agents), ["doc", "agent"], "seq", how="left").join(known, ["doc", "agent"], "left")
    error = F.when(F.col("start").isNotNull(), None).when(F.col("known"), "seq_in_future").otherwise("unknown_agent")
    return found.withColumns({"lv": F.col("lv_start") + F.col("offset"), "error": error}).drop("start", "end", "lv_start", "offset", "known")


def remote_version(versions: DataFrame, agents: DataFrame) -> DataFrame:
    """(doc, version) with the version as an array of (agent, seq) in order of the operations."""
    at = versions.select("doc", "version").distinct()
    named = to_remote(at.select("doc", "version", F.explode("version").alias("lv")), agents)
    lists = named.groupBy("doc", "version").agg(F.transform(F.array_sort(F.collect_list(F.struct("lv", "agent", "seq"))), lambda x: F.struct(x["agent"].alias("agent"), x["seq"].alias("seq"))).alias("remote"))
    return versions.join(lists, ["doc", "version"], "left").select(*versions.columns, F.coalesce("remote", F.array().cast("array<struct<agent:string,seq:bigint>>")).alias("remote"))


def sampled_version(tips: DataFrame, agents: DataFrame, count: int) -> DataFrame:
    """(doc, lv, agent, seq): a document's tips (doc, lv), and operations ever sparser towards its beginning, about `count` in all.

    Of n operations those at n - 1, n - f, n - f^2, ..., f chosen so that as many as are wanted reach the beginning, 1.1 at least.
    """
    size = agents.groupBy("doc").agg(F.max("lv_end").alias("n")).join(tips.groupBy("doc").agg((F.lit(count) - F.count(F.lit(1))).alias("more")), "doc")
    factor = F.greatest(F.lit(1.1), F.pow(F.col("n").cast("double"), 1 / F.col("more")))
    steps = F.ceil(F.log(F.col("n").cast("double")) / F.log(factor) - 1e-9).cast("int") - 1
    back = F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), lambda k: F.floor(F.pow(factor, k) + 1e-9))
    older = size.filter("more > 0").select("doc", F.explode(F.array_distinct(F.transform(back, lambda b: F.col("n") - b))).alias("lv"))
    return to_remote(tips.select("doc", "lv").union(older).distinct(), agents)


def next_seq(agents: DataFrame) -> DataFrame:
    """(doc, agent, next_seq): where each agent goes on; also the flat version summary."""
    return agents.groupBy("doc", "agent").agg(F.max(F.col("seq_start") + F.col("lv_end") - F.col("lv_start")).alias("next_seq"))


def summary(agents: DataFrame) -> DataFrame:
    """(doc, agent, start, end): the known ranges of each agent's numbers, joined."""
    return coalesce_runs(_by_seq(agents).drop("lv_start"), ["doc", "agent"])


def in_summary(points: DataFrame, known: DataFrame) -> DataFrame:
    """The points (doc, agent, seq) that a summary has."""
    return lookup(points, known, ["doc", "agent"], "seq").select(*points.columns)


def intersect_summary(agents: DataFrame, theirs: DataFrame) -> DataFrame:
    """Each range of their summary cut by what the log knows: (doc, agent, start, end, lv), lv null where the log knows nothing."""
    ours = _by_seq(agents).withColumn("base", F.col("start"))
    both = intersect_runs(theirs.select("doc", "agent", "start", "end", F.col("start").alias("t_start"), F.col("end").alias("t_end")), ours, ["doc", "agent"])
    known = both.select("doc", "agent", "start", "end", (F.col("lv_start") + F.col("start") - F.col("base")).alias("lv"))
    # their range's edges as empty runs make the parts before, between and after what is known gaps
    edges = theirs.select("doc", "agent", F.col("start").alias("t_start"), F.explode(F.array(F.col("start"), F.col("end"))).alias("start"))
    marks = both.select("doc", "agent", "t_start", "start", "end").union(edges.select("doc", "agent", "t_start", "start", F.col("start").alias("end")))
    rest = gaps(marks, ["doc", "agent", "t_start"]).select("doc", "agent", "start", "end", F.lit(None).cast("long").alias("lv"))
    return known.union(rest)


def tie_break(agent: Column, seq: Column, js: bool = False) -> Column:
    """What the winner of concurrent writes has most of: the name, then the higher (or, for js, the lower) number."""
    return F.struct(agent.alias("agent"), (-seq if js else seq).alias("seq"))
