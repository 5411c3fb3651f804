"""Tables of an operation log, and expressions on versions.

  runs    (doc, start, end, parents)                       runs of operations; parents are those of the first
  agents  (doc, lv_start, lv_end, agent, seq_start)         who made which operations, in runs
  text    (doc, lv, n, kind, pos, content, fwd)             text edits, in runs
  maps    (doc, crdt, key, lv, agent, seq, kind, value)      writes of map keys
  sets    (doc, crdt, agent, seq, op, target_agent, target_seq, value)

A version is an ascending array of operations, [] the root; ROOT names the document itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = -1
RUNS = "doc long, start long, end long, parents array<long>"
AGENTS = "doc long, lv_start long, lv_end long, agent string, seq_start long"
TEXT = "doc long, lv long, n long, kind string, pos long, content string, fwd boolean"


def version(*ops) -> Column:
    """The version of the given columns' operations; nulls are left out."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*ops))))


def is_root(v: Column) -> Column:
    return F.size(v) == 0


def single(v: Column) -> Column:
    """The only operation of a version, else null."""
    return F.when(F.size(v) == 1, v[0])


def advance_by_run(v: Column, parents: Column, last: Column) -> Column:
    """The version after a run with these parents that ends in `last`."""
    return F.array_sort(F.array_union(F.array_except(v, parents), F.array(last)))


def inserted(v: Column, op: Column) -> Column:
    """The version with one more operation, which it may have already."""
    return F.array_sort(F.array_union(v, F.array(op)))


def replaced(v: Column, old: Column, new: Column) -> Column:
    """The version with one operation in another's place."""
    return F.array_sort(F.array_distinct(F.transform(v, lambda x: F.when(x == old, new).otherwise(x))))


def same_version(a: Column, b: Column) -> Column:
    """Whether two versions name the same operations, in whatever order and whatever they are named by: numbers or structs of agent and seq."""
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def is_sorted(v: Column) -> Column:
    return v == F.array_sort(F.array_distinct(v))


def spelled(v: Column) -> Column:
    """A version as comma-joined text."""
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")
