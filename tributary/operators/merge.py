"""Writing to logs: appending edits, and deltas between peers with everything that a log has.

A log is a dict of tables, runs, agents and text. A delta names operations by (agent, seq) only, so it means the same to every peer:

  graph  (doc, agent, seq, n, place, parents array<struct<agent,seq>>)   runs of operations in the sender's order, `place`
  text   (doc, agent, seq, n, kind, pos, content, fwd)                     their edits

Numbering and cutting are windows and interval joins; their results, a row a run, are written before they are used several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import edited
from ..sources.cuts import written
from .graph import tip_versions
from .ids import is_agent_name, next_seq, summary, to_local, to_remote
from .runs import intersect_runs, sorted_join
from .sync import trim_known

Log = dict[str, DataFrame]
GRAPH = "doc long, agent string, seq long, n long, place long, parents array<struct<agent:string,seq:long>>"
EDITS = "doc long, agent string, seq long, n long, kind string, pos long, content string, fwd boolean"


def _longs() -> Column:
    return F.array().cast("array<bigint>")


def pack_runs(runs: DataFrame) -> DataFrame:
    """Runs joined to the run before where they only go on from its last operation."""
    w = Window.partitionBy("doc").orderBy("start")
    goes_on = (F.lag("end").over(w) == F.col("start")) & (F.col("parents") == F.array(F.col("start") - 1))
    islands = runs.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("parents", "start").alias("parents")).drop("_island")


def appended(log: Log, edits: DataFrame) -> Log:
    """The log with edits (doc, txn, agent, parents, ops array<struct<kind,pos,n,content,fwd>>) appended in the order of txn.

    Each txn is a run of its agent's, at its parents; without parents (null) it follows the txn before it, the first of a document
    the log's tips. n is an insertion's length or how much is deleted. Txns without operations, or whose agent has no
    proper name, are left out.
    """
    size = F.aggregate("ops", F.lit(0).cast("long"), lambda a, o: a + o["n"])
    given = edits.withColumn("n", size).filter((F.col("n") > 0) & is_agent_name(F.col("agent")))
    w = Window.partitionBy("doc").orderBy("txn")
    so_far = lambda over: F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    length = log["runs"].groupBy("doc").agg(F.max("end").alias("_length"))
    tips = tip_versions(log["runs"]).withColumnRenamed("version", "_tips")
    given = given.join(length, "doc", "left").join(tips, "doc", "left").join(next_seq(log["agents"]), ["doc", "agent"], "left")
    placed = given.withColumn("start", F.coalesce("_length", F.lit(0)) + so_far(w)).withColumn("seq_start", F.coalesce("next_seq", F.lit(0)) + so_far(Window.partitionBy("doc", "agent").orderBy("txn")))
    before = F.lag(F.col("start") + F.col("n") - 1).over(w)
    placed = placed.withColumns({"end": F.col("start") + F.col("n"), "parents": F.coalesce("parents", F.when(before.isNotNull(), F.array(before)), "_tips", _longs())})
    placed = written(placed.select("doc", "start", "end", "agent", "seq_start", "parents", "ops"), "appended")
    each = placed.select("doc", "start", F.posexplode("ops").alias("at", "o"))
    lv = F.col("start") + F.sum("o.n").over(Window.partitionBy("doc", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("o.n")
    text = each.select("doc", lv.alias("lv"), "o.n", "o.kind", "o.pos", "o.content", "o.fwd")
    agents = placed.select("doc", F.col("start").alias("lv_start"), F.col("end").alias("lv_end"), "agent", "seq_start")
    return {
        "runs": log["runs"].unionByName(placed.select("doc", "start", "end", "parents")),
        "agents": log["agents"].unionByName(agents),
        "text": log["text"].unionByName(text),
    }


def edited_branches(log: Log, branches: DataFrame, edits: DataFrame) -> tuple[Log, DataFrame]:
    """(log, branches) after local edits (doc, txn, agent, ops) to branches (doc, content, version), content the text at version.

    A branch's edits follow each other in the order of txn, the first at the branch's version, so they change its content as they are;
    txns that `appended` leaves out change nothing. Branches without edits stay as they are.
    """
    size = F.aggregate("ops", F.lit(0).cast("long"), lambda a, o: a + o["n"])
    given = edits.filter((size > 0) & is_agent_name(F.col("agent"))).join(branches.select("doc", "version"), "doc")
    first = F.row_number().over(Window.partitionBy("doc").orderBy("txn")) == 1
    grown = appended(log, given.withColumn("parents", F.when(first, F.col("version"))).drop("version"))
    total = given.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("txn", "ops"))), lambda x: x["ops"])).alias("ops"))
    last = grown["runs"].groupBy("doc").agg(F.max("end").alias("_end"))
    met = branches.join(total, "doc", "left").join(last, "doc", "left")
    content = F.when(F.col("ops").isNull(), F.col("content")).otherwise(edited(F.col("content"), F.col("ops")))
    version = F.when(F.col("ops").isNull(), F.col("version")).otherwise(F.array(F.col("_end") - 1))
    return grown, met.select("doc", content.alias("content"), version.alias("version"))


def named_runs(log: Log) -> DataFrame:
    """(doc, start, end, agent, seq, parents): runs cut where the agent changes."""
    runs = log["runs"].select("doc", "start", "end", F.col("start").alias("run"), "parents")
    agents = log["agents"].select("doc", F.col("lv_start").alias("start"), F.col("lv_end").alias("end"), "agent", (F.col("lv_start") - F.col("seq_start")).alias("shift"))
    cut = intersect_runs(runs, agents, ["doc"])
    parents = F.when(F.col("start") == F.col("run"), F.col("parents")).otherwise(F.array(F.col("start") - 1))
    return cut.select("doc", "start", "end", "agent", (F.col("start") - F.col("shift")).alias("seq"), parents.alias("parents"))


def text_within(text: DataFrame, spans: DataFrame) -> DataFrame:
    """Edits cut by spans (doc, start, end, ...): the parts (doc, lv, n, kind, pos, content, fwd) with the spans' other columns."""
    ops = text.select("doc", F.col("lv").alias("start"), (F.col("lv") + F.col("n")).alias("end"), F.col("lv").alias("op_lv"), F.col("n").alias("op_n"), "kind", "pos", "content", "fwd")
    cut = intersect_runs(ops, spans, ["doc"])
    a, b = F.col("start") - F.col("op_lv"), F.col("end") - F.col("op_lv")
    # an insertion's characters follow each other; a deletion's fall into one place, backward ones retreat
    pos = F.when(F.col("kind") == "Ins", F.col("pos") + a).when(F.col("fwd"), F.col("pos")).otherwise(F.col("pos") + F.col("op_n") - b)
    content = F.substring("content", (a + 1).cast("int"), (b - a).cast("int"))
    others = [c for c in spans.columns if c not in ("doc", "start", "end")]
    return cut.select("doc", F.col("start").alias("lv"), (b - a).alias("n"), "kind", pos.alias("pos"), content.alias("content"), "fwd", *others)


def _unknown(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (doc, agent, start, end, ...) cut down to the numbers that known (doc, agent, start, end) lacks; `first` is where the row began."""
    fresh = trim_known(rows.select("doc", "agent", "start", "end"), known)
    others = [c for c in rows.columns if c not in ("doc", "agent", "start", "end")]
    return intersect_runs(fresh, rows.select("doc", "agent", "start", "end", F.col("start").alias("first"), *others), ["doc", "agent"])


def changes_since(log: Log, known: DataFrame) -> Log:
    """The delta for a peer that knows the numbers known (doc, agent, start, end), a version summary; what it knows is a closed set."""
    rows = named_runs(log).select("doc", "agent", F.col("seq").alias("start"), (F.col("seq") + F.col("end") - F.col("start")).alias("end"), F.col("start").alias("lv"), "parents")
    fresh = _unknown(rows, known).withColumn("place", F.col("lv") + F.col("start") - F.col("first"))
    parents = F.when(F.col("start") == F.col("first"), F.col("parents")).otherwise(F.array(F.col("place") - 1))
    fresh = written(fresh.select("doc", "agent", F.col("start").alias("seq"), (F.col("end") - F.col("start")).alias("n"), "place", parents.alias("parents")), "fresh")
    points = to_remote(fresh.select("doc", "place", F.explode("parents").alias("lv")), log["agents"])
    names = points.groupBy("doc", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("lv", "agent", "seq"))), lambda x: F.struct(x["agent"].alias("agent"), x["seq"].alias("seq"))).alias("parents"))
    graph = fresh.drop("parents").join(sorted_join(names), ["doc", "place"], "left").select("doc", "agent", "seq", "n", "place", F.coalesce("parents", F.array().cast("array<struct<agent:string,seq:bigint>>")).alias("parents"))
    spans = fresh.select("doc", F.col("place").alias("start"), (F.col("place") + F.col("n")).alias("end"), "agent", (F.col("place") - F.col("seq")).alias("shift"))
    text = text_within(log["text"], spans).select("doc", "agent", (F.col("lv") - F.col("shift")).alias("seq"), "n", "kind", "pos", "content", "fwd")
    return {"graph": graph, "text": text}


def with_changes(log: Log, changes: Log) -> Log:
    """The log with a delta's operations that it lacks, numbered on in the sender's order, their parents by the log's own numbers.

    Applying a delta again changes nothing. Every parent must be known to the log or be in the delta: see unknown_parents.
    """
    rows = changes["graph"].select("doc", "agent", F.col("seq").alias("start"), (F.col("seq") + F.col("n")).alias("end"), "place", "parents").dropDuplicates(["doc", "agent", "start", "end"])
    fresh = _unknown(rows, summary(log["agents"])).withColumn("place", F.col("place") + F.col("start") - F.col("first")).withColumn("n", F.col("end") - F.col("start"))
    length = log["runs"].groupBy("doc").agg(F.max("end").alias("_length"))
    order = Window.partitionBy("doc").orderBy("place", "agent", "start").rowsBetween(Window.unboundedPreceding, 0)
    placed = written(fresh.join(length, "doc", "left").withColumn("lv", F.coalesce("_length", F.lit(0)) + F.sum("n").over(order) - F.col("n")), "placed")
    agents = log["agents"].unionByName(placed.select("doc", F.col("lv").alias("lv_start"), (F.col("lv") + F.col("n")).alias("lv_end"), "agent", F.col("start").alias("seq_start")))
    own = F.array(F.struct(F.col("agent").alias("agent"), (F.col("start") - 1).alias("seq")))
    named = placed.select("doc", F.col("lv").alias("run"), F.explode(F.when(F.col("start") == F.col("first"), F.col("parents")).otherwise(own)).alias("p"))
    found = to_local(named.select("doc", "run", "p.agent", "p.seq"), agents)
    parents = found.groupBy("doc", "run").agg(F.array_sort(F.collect_list("lv")).alias("parents"))
    runs = placed.select("doc", F.col("lv").alias("run"), "n").join(sorted_join(parents), ["doc", "run"], "left")
    runs = runs.select("doc", F.col("run").alias("start"), (F.col("run") + F.col("n")).alias("end"), F.coalesce("parents", _longs()).alias("parents"))
    by_seq = placed.select("doc", "agent", "start", "end", (F.col("lv") - F.col("start")).alias("shift"))
    edits = changes["text"].dropDuplicates(["doc", "agent", "seq", "n"])
    # edits are cut by what is fresh in the agents' numbers, as if each agent were a document of its own
    keyed = lambda df: df.withColumn("doc", F.struct("doc", "agent")).drop("agent")
    text = text_within(keyed(edits.withColumnRenamed("seq", "lv")), keyed(by_seq))
    text = text.select(F.col("doc.doc").alias("doc"), (F.col("lv") + F.col("shift")).alias("lv"), "n", "kind", "pos", "content", "fwd")
    return {"runs": log["runs"].unionByName(runs), "agents": agents, "text": log["text"].unionByName(text)}


def merged_logs(ours: Log, theirs: Log) -> Log:
    """Our log with what theirs has and ours lacks."""
    return with_changes(ours, changes_since(theirs, summary(ours["agents"])))


def unknown_parents(log: Log, changes: Log) -> DataFrame:
    """(doc, agent, seq) of parents that neither the log nor the delta has: such a delta must wait."""
    sent = changes["graph"].select("doc", (-F.col("place") - F.col("n")).alias("lv_start"), (-F.col("place")).alias("lv_end"), "agent", F.col("seq").alias("seq_start"))
    asked = changes["graph"].select("doc", F.explode("parents").alias("p")).select("doc", "p.agent", "p.seq").distinct()
    return to_local(asked, log["agents"].unionByName(sent)).filter("error IS NOT NULL").select("doc", "agent", "seq").distinct()


def to_lines(changes: Log) -> DataFrame:
    """A delta as JSON lines (value)."""
    return changes["graph"].select(F.to_json(F.struct(F.struct("*").alias("graph"))).alias("value")).union(changes["text"].select(F.to_json(F.struct(F.struct("*").alias("text"))).alias("value")))


def from_lines(lines: DataFrame) -> Log:
    """The inverse of to_lines."""
    read = lambda name, schema: lines.select(F.from_json("value", f"{name} struct<{schema.replace(' ', ':').replace(',:', ',')}>").alias("x")).filter(f"x.{name} IS NOT NULL").select(f"x.{name}.*")
    return {"graph": read("graph", GRAPH), "text": read("text", EDITS)}
