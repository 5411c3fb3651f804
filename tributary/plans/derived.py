"""Operation logs derived from the driver's tables, in Spark and, as common table expressions, in SQL.

Edits: events of eight neighbouring users are one document's operations. A document's events, by time, fall into rounds of
16; in a round each user works alone, beginning from all that the round before left. So a user's operations in a
round are one run, whose parents are the last operations of all runs of the round before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.runs import sorted_join

USERS, ROUND = 8, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, round, agent, lv, seq, key, value, event_id, ts)."""
    by_time = Window.partitionBy("doc").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.expr(f"user_id div {USERS}").alias("doc"), F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("agent"), "event_id", "ts", F.col("event_type").alias("key"), "value")
    rows = rows.withColumn("round", F.floor((F.row_number().over(by_time) - 1) / ROUND).cast("long"))
    order = ["round", "agent", "ts", "event_id"]
    number = lambda *keys: (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")
    return rows.withColumns({"lv": number("doc"), "seq": number("doc", "agent")})


def spans(ops_: DataFrame) -> DataFrame:
    """(doc, round, agent, start, end, seq_start)."""
    return ops_.groupBy("doc", "round", "agent").agg(F.min("lv").alias("start"), (F.max("lv") + 1).alias("end"), F.min("seq").alias("seq_start"))


def runs(spans_: DataFrame) -> DataFrame:
    """(doc, start, end, parents)."""
    ends = spans_.groupBy("doc", (F.col("round") + 1).alias("round")).agg(F.array_sort(F.collect_list(F.col("end") - 1)).alias("parents"))
    return spans_.join(sorted_join(ends), ["doc", "round"], "left").select("doc", "start", "end", F.coalesce("parents", F.array().cast("array<bigint>")).alias("parents"))


def agents(spans_: DataFrame) -> DataFrame:
    return spans_.select("doc", F.col("start").alias("lv_start"), F.col("end").alias("lv_end"), "agent", "seq_start")


def questions(spans_: DataFrame) -> DataFrame:
    """(doc, q, a, b): by round, a is the first user's last operation in it, b the last user's: in the same round if its number is even, else in the one before."""
    ends = spans_.groupBy("doc", "round").agg(F.min_by("end", "agent").alias("first"), F.max_by("end", "agent").alias("last"))
    before = F.lag("last").over(Window.partitionBy("doc").orderBy("round"))
    b = F.when(F.col("round") % 2 == 0, F.col("last")).otherwise(before)
    return ends.select("doc", F.col("round").alias("q"), F.array(F.col("first") - 1).alias("a"), F.array(b - 1).alias("b"))


def sets_of_ops(spans_: DataFrame) -> DataFrame:
    """(doc, q, ops): by round, the last operations of its runs and of those of the round before."""
    ends = spans_.select("doc", "round", (F.col("end") - 1).alias("lv"))
    both = ends.union(ends.select("doc", F.col("round") + 1, "lv"))
    last = spans_.groupBy("doc").agg(F.max("round").alias("most"))
    return both.join(last, "doc").filter("round <= most").groupBy("doc", F.col("round").alias("q")).agg(F.collect_list("lv").alias("ops"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, turn, role, content, n, pos): turns appended one after another."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    n = F.length("content").cast("long")
    w = Window.partitionBy("doc").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"n": n, "pos": F.sum(n).over(w) - n})


def duets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Conversations as concurrent edits. Two neighbouring turns are typed at once, at the end of what all before left; then, of a
    pair's n characters, two editors at once delete n // 4 each: `x` forwards from the first on, `y` backwards those from n // 8 on,
    so that some are deleted twice. The next pair begins from both.

    Tables runs, text, agents, and tips (doc, version).
    """
    by_doc = Window.partitionBy("doc").orderBy("turn", "role")
    rows = conversations(spark, sf_dir).filter("n > 0").withColumn("k", F.row_number().over(by_doc) - 1).withColumn("pair", F.floor(F.col("k") / 2).cast("long"))
    typed = rows.select("doc", "pair", (F.col("k") % 2).cast("long").alias("step"), F.concat(F.col("role"), F.lit("-"), (F.col("k") % 2).cast("string")).alias("agent"), "n", F.lit("Ins").alias("kind"), "content", F.lit(True).alias("fwd"), F.lit(0).cast("long").alias("into"))
    sizes = typed.groupBy("doc", "pair").agg(F.sum("n").alias("size"))
    gone = lambda step, agent, fwd, into: sizes.filter("size >= 4").select("doc", "pair", F.lit(step).cast("long").alias("step"), F.lit(agent).alias("agent"), F.expr("size div 4").alias("n"), F.lit("Del").alias("kind"), F.lit(None).cast("string").alias("content"), F.lit(fwd).alias("fwd"), F.expr(into).cast("long").alias("into"))
    deleted = gone(2, "x", True, "0").union(gone(3, "y", False, "size div 8"))
    order = Window.partitionBy("doc").orderBy("pair", "step").rowsBetween(Window.unboundedPreceding, 0)
    of_agent = Window.partitionBy("doc", "agent").orderBy("pair").rowsBetween(Window.unboundedPreceding, 0)
    ops_ = typed.unionByName(deleted).withColumns({"lv": F.sum("n").over(order) - F.col("n"), "seq": F.sum("n").over(of_agent) - F.col("n")})
    left = F.expr("size - size div 4 - size div 8")
    begins = sizes.withColumn("begin", F.sum(left).over(Window.partitionBy("doc").orderBy("pair").rowsBetween(Window.unboundedPreceding, 0)) - left)
    # phase 2p types pair p, phase 2p + 1 deletes from it; a phase's runs have the ends of the last phase before as parents
    ops_ = ops_.join(begins, ["doc", "pair"]).withColumn("phase", F.col("pair") * 2 + (F.col("kind") == "Del").cast("long"))
    ends = ops_.groupBy("doc", "phase").agg(F.array_sort(F.collect_list(F.col("lv") + F.col("n") - 1)).alias("ends"))
    before = F.lag("ends").over(Window.partitionBy("doc").orderBy("phase"))
    ops_ = ops_.join(ends.withColumn("parents", F.coalesce(before, F.array().cast("array<bigint>"))), ["doc", "phase"])
    last = F.col("lv") + F.col("n")
    return {
        "runs": ops_.select("doc", F.col("lv").alias("start"), last.alias("end"), "parents"),
        "text": ops_.select("doc", "lv", "n", "kind", (F.col("begin") + F.col("into")).alias("pos"), "content", "fwd"),
        "agents": ops_.select("doc", F.col("lv").alias("lv_start"), last.alias("lv_end"), "agent", F.col("seq").alias("seq_start")),
        "tips": ends.groupBy("doc").agg(F.max_by("ends", "phase").alias("version")),
    }


def shared_names(ops_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log as if two neighbouring users wrote under one name: (doc, lv, agent, seq) and its spans (doc, round, agent, start, end, seq_start)."""
    named = ops_.withColumn("agent", F.concat(F.lit("w"), F.expr("CAST(CAST(substr(agent, 2) AS BIGINT) div 2 AS STRING)")))
    named = named.withColumn("seq", (F.row_number().over(Window.partitionBy("doc", "agent").orderBy("lv")) - 1).cast("long"))
    user = ops_.select("doc", "lv", F.col("agent").alias("user"))
    return named.select("doc", "lv", "agent", "seq"), spans(named.join(user, ["doc", "lv"]).withColumn("round", F.struct("round", "user"))).withColumn("round", F.col("round.round"))


def peer(ops_: DataFrame, parity: int, *order) -> dict[str, DataFrame]:
    """A peer's log (runs, agents, text, ops): the first half of the rounds and, of the one after, the users of even (0) or odd (1)
    number, numbered by round and `order`. An operation's edit inserts its key."""
    half = ops_.groupBy("doc").agg(F.expr("max(round) div 2").alias("half"))
    mine = F.expr(f"CAST(substr(agent, 2) AS BIGINT) % 2 = {parity}")
    kept = ops_.join(half, "doc").filter((F.col("round") <= F.col("half")) | ((F.col("round") == F.col("half") + 1) & mine))
    kept = kept.withColumn("lv", (F.row_number().over(Window.partitionBy("doc").orderBy("round", *order, "lv")) - 1).cast("long"))
    of_peer = spans(kept)
    text = kept.select("doc", "lv", F.lit(1).cast("long").alias("n"), F.lit("Ins").alias("kind"), F.col("seq").alias("pos"), F.substring("key", 1, 1).alias("content"), F.lit(True).alias("fwd"))
    return {"runs": runs(of_peer), "agents": agents(of_peer), "text": text, "ops": kept}


#: The same in SQL; to be followed by more expressions or the query.
EV = f"""
WITH RECURSIVE ev0 AS (SELECT user_id // {USERS} AS doc, 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS agent, event_id, ts, event_type AS key, value,
  (row_number() OVER (PARTITION BY user_id // {USERS} ORDER BY ts, event_id) - 1) // {ROUND} AS round FROM events),
ops AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round, agent, ts, event_id) - 1 AS lv,
  row_number() OVER (PARTITION BY doc, agent ORDER BY round, agent, ts, event_id) - 1 AS seq FROM ev0),
spans AS (SELECT doc, round, agent, min(lv) AS s, max(lv) + 1 AS e, min(seq) AS q0 FROM ops GROUP BY ALL),
edges AS (SELECT r.doc, r.s AS lv, p.e - 1 AS parent FROM spans r JOIN spans p ON p.doc = r.doc AND p.round = r.round - 1
  UNION ALL SELECT o.doc, o.lv, o.lv - 1 FROM ops o ANTI JOIN spans r ON r.doc = o.doc AND r.s = o.lv)"""
#: Beside EV: the questions' two sides (doc, q, side, lv), and their histories (doc, q, side, lv).
ASKED = """,
ends AS (SELECT doc, round AS q, arg_min(e, agent) AS f, arg_max(e, agent) AS l FROM spans GROUP BY ALL),
ends2 AS (SELECT *, lag(l) OVER (PARTITION BY doc ORDER BY q) AS l0 FROM ends),
sides AS (SELECT doc, q, 'a' AS side, f - 1 AS lv FROM ends2 UNION ALL SELECT doc, q, 'b', CASE WHEN q % 2 = 0 THEN l ELSE l0 END - 1 FROM ends2),
anc AS (SELECT doc, q, side, lv FROM sides UNION SELECT a.doc, a.q, a.side, e.parent FROM anc a JOIN edges e ON e.doc = a.doc AND e.lv = a.lv)"""
