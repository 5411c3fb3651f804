"""Multi-value registers and maps of them: heads, winners, conflicts, deletes, checkout at a version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import dominators
from .ids import tie_break
from .runs import lookup

KEY = ["doc", "crdt", "key"]


def heads(writes: DataFrame, runs: DataFrame) -> DataFrame:
    """The writes (doc, crdt, key, lv, ...) that no later write of their key contains. Of a run only the last write of a key can be one, so a key's question is as short as its runs are few."""
    last = lookup(writes.select(*KEY, "lv"), runs, ["doc"]).groupBy(*KEY, "start").agg(F.max("lv").alias("lv"))
    asked = last.groupBy(*KEY).agg(F.collect_list("lv").alias("ops")).withColumn("q", F.monotonically_increasing_id())
    # the answer names operations, and an operation writes one key
    found = dominators(runs, asked.select("doc", "q", "ops")).select("doc", F.explode("version").alias("lv"))
    return writes.join(found, ["doc", "lv"], "left_semi")


def heads_by_parents(writes: DataFrame) -> DataFrame:
    """Heads where each write names the writes it replaces (`replaces`, an array of lv): those that no one names."""
    named = writes.select(*KEY, F.explode("replaces").alias("lv")).distinct()
    return writes.join(named, [*KEY, "lv"], "left_anti")


def resolved(heads_: DataFrame, js: bool = False) -> DataFrame:
    """(doc, crdt, key, lv, agent, seq, kind, value, n_conflicts): each key's winner and how many heads lost."""
    best = F.max_by(F.struct("lv", "agent", "seq", "kind", "value"), tie_break(F.col("agent"), F.col("seq"), js)).alias("w")
    return heads_.groupBy(*KEY).agg(best, (F.count(F.lit(1)) - 1).alias("n_conflicts")).select(*KEY, "w.*", "n_conflicts")


def conflicting(heads_: DataFrame, js: bool = False) -> DataFrame:
    """The heads that lost, beside the winner's lv."""
    won = resolved(heads_, js).select(*KEY, F.col("lv").alias("winner_lv"))
    return heads_.join(won, KEY).filter(F.col("lv") != F.col("winner_lv"))


def present(winners: DataFrame) -> DataFrame:
    """Winners without tombstones."""
    return winners.filter("kind <> 'delete'")


def written_within(writes: DataFrame, spans: DataFrame) -> DataFrame:
    """The writes within a history's spans (doc, start, end)."""
    return lookup(writes, spans.select("doc", "start", "end"), ["doc"]).select(*writes.columns)
