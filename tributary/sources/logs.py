"""Reading and writing logs: JSON traces of several shapes, Parquet layout, JSON exports and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINEAR = "startContent string, endContent string, txns array<struct<time:string, patches:array<array<string>>>>"
CONFORMANCE = "txns array<struct<span:array<long>, parents:array<long>, agent:string, seqStart:long, ops:array<array<string>>>>, endContent string"
TABLES = ("runs", "agents", "text")


def read_linear_traces(spark: SparkSession, path: str) -> DataFrame:
    """One JSON trace a line (gzip too) to (doc, txn, patch, pos, del, ins); doc is the line's digest."""
    lines = spark.read.schema(LINEAR).json(path).withColumn("doc", F.xxhash64(F.to_json(F.struct("startContent", "endContent", "txns"))))
    patches = lines.select("doc", F.posexplode("txns").alias("txn", "t")).select("doc", F.col("txn").cast("long").alias("txn"), F.posexplode("t.patches").alias("patch", "p"))
    return patches.select("doc", "txn", F.col("patch").cast("long").alias("patch"), F.col("p")[0].cast("long").alias("pos"), F.col("p")[1].cast("long").alias("del"), F.col("p")[2].alias("ins"))


def patches_to_text(patches: DataFrame) -> DataFrame:
    """Patches in order to text operations (doc, lv, n, kind, pos, content, fwd): a patch deletes, then inserts."""
    parts = F.array(
        F.struct(F.lit("Del").alias("kind"), F.col("del").alias("n"), F.lit(None).cast("string").alias("content")),
        F.struct(F.lit("Ins").alias("kind"), F.length("ins").cast("long").alias("n"), F.col("ins").alias("content")),
    )
    rows = patches.select("doc", "txn", "patch", "pos", F.posexplode(parts).alias("half", "o")).filter("o.n > 0")
    w = Window.partitionBy("doc").orderBy("txn", "patch", "half")
    return rows.select("doc", (F.sum("o.n").over(w) - F.col("o.n")).alias("lv"), F.col("o.n").alias("n"), F.col("o.kind").alias("kind"), "pos", F.col("o.content").alias("content"), F.lit(True).alias("fwd"))


def read_conformance(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Concurrent histories, one JSON object a line, to the tables runs, agents and text, and `ends` (doc, content)."""
    lines = spark.read.schema(CONFORMANCE).json(path).withColumn("doc", F.xxhash64(F.to_json(F.struct("txns", "endContent"))))
    txns = lines.select("doc", F.explode("txns").alias("t"))
    start, end = F.col("t.span")[0], F.col("t.span")[1]
    runs = txns.select("doc", start.alias("start"), end.alias("end"), F.array_sort("t.parents").alias("parents"))
    agents = txns.select("doc", start.alias("lv_start"), end.alias("lv_end"), F.col("t.agent").alias("agent"), F.col("t.seqStart").alias("seq_start"))
    patches = txns.select("doc", start.alias("txn"), F.posexplode("t.ops").alias("patch", "p")).select("doc", "txn", F.col("patch").cast("long").alias("patch"), F.col("p")[0].cast("long").alias("pos"), F.col("p")[1].cast("long").alias("del"), F.col("p")[2].alias("ins"))
    return {"runs": runs, "agents": agents, "text": patches_to_text(patches), "ends": lines.select("doc", F.col("endContent").alias("content"))}


def export_conformance(runs: DataFrame, agents: DataFrame, text: DataFrame, ends: DataFrame) -> DataFrame:
    """The inverse: (doc, json). Runs must be cut so that each has one agent."""
    op = F.struct("lv", F.to_json(F.array("pos", F.when(F.col("kind") == "Del", F.col("n")).otherwise(0))).alias("head"), F.coalesce("content", F.lit("")).alias("ins"))
    whole = text.join(runs.select("doc", "start", "end"), "doc").filter((F.col("lv") >= F.col("start")) & (F.col("lv") < F.col("end"))).groupBy("doc", "start").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    rows = runs.join(agents.select("doc", F.col("lv_start").alias("start"), "agent", "seq_start"), ["doc", "start"]).join(whole, ["doc", "start"], "left")
    quoted = lambda x: F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    ops = F.transform(F.coalesce("ops", F.array().cast("array<struct<lv:bigint,head:string,ins:string>>")), lambda o: F.concat(F.substring(o["head"], F.lit(1), F.length(o["head"]) - 1), F.lit(","), quoted(o["ins"]), F.lit("]")))
    txn = F.concat(F.lit('{"span":'), F.to_json(F.array("start", "end")), F.lit(',"parents":'), F.to_json("parents"), F.lit(',"agent":'), quoted(F.col("agent")), F.lit(',"seqStart":'), F.col("seq_start").cast("string"), F.lit(',"ops":['), F.array_join(ops, ","), F.lit("]}"))
    txns = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", txn.alias("j")))).alias("t"))
    return txns.join(ends, "doc").select("doc", F.concat(F.lit('{"txns":['), F.array_join(F.transform("t", lambda x: x["j"]), ","), F.lit('],"endContent":'), quoted(F.col("content")), F.lit("}")).alias("json"))


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines [agent, seq, RFC 3339 time] to (agent, seq, time)."""
    rows = spark.read.text(path).select(F.from_json("value", "array<string>").alias("x"))
    return rows.select(F.col("x")[0].alias("agent"), F.col("x")[1].cast("long").alias("seq"), F.to_timestamp(F.col("x")[2]).alias("time"))


def write_log(tables: dict[str, DataFrame], path: str, content: bool = True) -> None:
    """The tables as Parquet, clustered by document; without content, the inserted and deleted text is left out."""
    for name in TABLES:
        df = tables[name]
        if name == "text" and not content:
            df = df.withColumn("content", F.lit(None).cast("string"))
        df.repartition("doc").sortWithinPartitions("doc", df.columns[1]).write.mode("overwrite").parquet(f"{path}/{name}")


def read_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def delta_json(ops: DataFrame, columns: list[str]) -> DataFrame:
    """A delta's operations as JSON lines (value) to send; they name operations by (agent, seq) only."""
    return ops.select(F.to_json(F.struct(*columns)).alias("value"))


def read_delta(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")
