"""Whole documents: maps, registers, sets and texts within one another; snapshots of them, and merging a snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ROOT
from . import trees
from .runs import coalesce_runs, lookup

State = dict[str, DataFrame]


def checkout(entries: DataFrame, containers: DataFrame, elements: DataFrame | None = None, texts: DataFrame | None = None, losers: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """(doc, path, kind, value, conflicts): every value of a document, kind value, map, register, set or text.

    entries (doc, crdt, key, value, child): maps' and registers' winners; containers (doc, crdt, kind): what a child is; elements (doc, crdt,
    agent, seq, value, child): what sets hold, in paths by `agent@seq`; texts (doc, crdt, content); losers (doc, crdt, key, value): values
    that lost, given as `conflicts`. A text without content is empty.
    """
    inner = entries.select("doc", "crdt", "key", "value", "child")
    if elements is not None:
        inner = inner.union(elements.select("doc", "crdt", F.concat_ws("@", "agent", F.col("seq").cast("string")), "value", "child"))
    rows = trees.checkout(inner, cut).join(containers.select("doc", F.col("crdt").alias("child"), "kind"), ["doc", "child"], "left")
    value = F.col("value").cast("string")
    if texts is not None:
        rows = rows.join(texts.select("doc", F.col("crdt").alias("child"), "content"), ["doc", "child"], "left")
        value = F.when(F.col("kind") == "text", F.coalesce("content", F.lit(""))).otherwise(value)
    none = F.array().cast("array<string>")
    lost = none
    if losers is not None:
        lists = losers.groupBy("doc", "crdt", "key").agg(F.array_sort(F.collect_list(F.col("value").cast("string"))).alias("lost"))
        rows = rows.withColumn("key", F.element_at("path", -1)).join(lists, ["doc", "crdt", "key"], "left")
        lost = F.coalesce("lost", none)
    return rows.select("doc", "path", F.coalesce("kind", F.lit("value")).alias("kind"), value.alias("value"), lost.alias("conflicts"))


def crdt_name(crdt: Column, agent: Column, seq: Column) -> Column:
    """A container's name to other peers: its creating operation's (agent, seq); the root is ("ROOT", 0)."""
    root = F.struct(F.lit("ROOT").alias("agent"), F.lit(0).cast("long").alias("seq"))
    return F.when(crdt == ROOT, root).otherwise(F.struct(agent.alias("agent"), seq.cast("long").alias("seq")))


def unknown_writes(writes: DataFrame, known: DataFrame) -> DataFrame:
    """The writes (doc, agent, seq, ...) that a summary (doc, agent, start, end) doesn't have."""
    return lookup(writes, known, ["doc", "agent"], "seq", how="left").filter("start IS NULL").select(*writes.columns)


def snapshot(writes: DataFrame) -> State:
    """writes (doc, crdt, key, agent, seq, kind, value, replaces array<struct<agent,seq>>) to a state: heads, those that no write of their key
    replaces, and known, the summary of all."""
    known = coalesce_runs(writes.select("doc", "agent", F.col("seq").alias("start"), (F.col("seq") + 1).alias("end")).distinct(), ["doc", "agent"])
    return {"heads": _unreplaced(writes, writes), "known": known}


def _unreplaced(rows: DataFrame, by: DataFrame) -> DataFrame:
    gone = by.select("doc", "crdt", "key", F.explode("replaces").alias("r")).select("doc", "crdt", "key", "r.agent", "r.seq").distinct()
    return rows.select("doc", "crdt", "key", "agent", "seq", "kind", "value").join(gone, ["doc", "crdt", "key", "agent", "seq"], "left_anti")


def merged_snapshot(state: State, writes: DataFrame) -> State:
    """A peer's state with those of our writes applied that its summary doesn't have; others change nothing."""
    fresh = unknown_writes(writes, state["known"])
    heads = state["heads"].select("doc", "crdt", "key", "agent", "seq", "kind", "value").union(fresh.select("doc", "crdt", "key", "agent", "seq", "kind", "value"))
    ours = fresh.select("doc", "agent", F.col("seq").alias("start"), (F.col("seq") + 1).alias("end")).distinct()
    known = coalesce_runs(state["known"].select("doc", "agent", "start", "end").union(ours), ["doc", "agent"])
    return {"heads": _unreplaced(heads, fresh), "known": known}


def to_lines(state: State) -> DataFrame:
    """(doc, part, line): a state as lines of JSON, one for each head and each known range, so that no document has to fit in a row."""
    lines = lambda part: state[part].select("doc", F.lit(part).alias("part"), F.to_json(F.struct(*[c for c in state[part].columns if c != "doc"])).alias("line"))
    return lines("heads").union(lines("known"))


def from_lines(lines: DataFrame, crdt: str = "long") -> State:
    """The state of to_lines; `crdt` is the type that containers are named by."""

    def part(name: str, schema: str) -> DataFrame:
        return lines.filter(F.col("part") == name).select("doc", F.from_json("line", schema).alias("x")).select("doc", "x.*")

    return {"heads": part("heads", f"crdt {crdt}, key string, agent string, seq long, kind string, value string"), "known": part("known", "agent string, start long, end long")}
