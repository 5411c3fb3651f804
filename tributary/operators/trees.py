"""Documents as trees of maps: checkout to paths, navigation, deletion of subtrees. One join for each level of nesting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ROOT


def checkout(entries: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """entries (doc, crdt, key, value, child), child the id of a nested map or null, to (doc, path, crdt, value, child, is_map)."""
    at = entries.filter(F.col("crdt") == ROOT).select("doc", F.array("key").alias("path"), "crdt", "value", "child")
    out = None
    while not (at := cut(at)).isEmpty():
        rows = at.select("doc", "path", "crdt", "value", "child", F.col("child").isNotNull().alias("is_map"))
        out = rows if out is None else out.union(rows)
        inner = entries.select("doc", F.col("crdt").alias("_in"), "key", F.col("value").alias("_value"), F.col("child").alias("_child"))
        parents = at.filter("child IS NOT NULL").select("doc", "path", F.col("child").alias("_in"))
        at = parents.join(inner, ["doc", "_in"]).select("doc", F.array_append("path", F.col("key")).alias("path"), F.col("_in").alias("crdt"), F.col("_value").alias("value"), F.col("_child").alias("child"))
    return out if out is not None else entries.filter("false").select("doc", F.array("key").alias("path"), "crdt", "value", "child", F.lit(False).alias("is_map"))


def at_path(entries: DataFrame, path: list[str]) -> DataFrame:
    """(doc, value, child) that stands at a path; documents without it have no row."""
    at = entries.select("doc").distinct().select("doc", F.lit(ROOT).cast("long").alias("crdt"))
    for k, key in enumerate(path):
        found = entries.filter(F.col("key") == key).join(at, ["doc", "crdt"])
        if k == len(path) - 1:
            return found.select("doc", "value", "child")
        at = found.filter("child IS NOT NULL").select("doc", F.col("child").alias("crdt"))
    return at.select("doc", F.lit(None).cast("string").alias("value"), F.col("crdt").alias("child"))


def deleted(children: DataFrame, replaced: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """children (doc, crdt, child) and the first maps that were overwritten (doc, crdt) to all maps that go with them."""
    at = replaced.select("doc", "crdt").distinct()
    out = None
    while not (at := cut(at)).isEmpty():
        out = at if out is None else out.union(at)
        at = children.join(at, ["doc", "crdt"]).select("doc", F.col("child").alias("crdt")).distinct()
    return out if out is not None else replaced.select("doc", "crdt").filter("false")


def nested_json(rows: DataFrame) -> DataFrame:
    """(doc, json): each document's paths as one JSON object of path text to value."""
    pairs = F.array_sort(F.collect_list(F.struct(F.array_join("path", "/").alias("k"), F.col("value").cast("string").alias("v"))))
    return rows.filter("NOT is_map").groupBy("doc").agg(F.to_json(F.map_from_entries(pairs)).alias("json"))
