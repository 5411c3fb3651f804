"""Structured Streaming: operations arrive in any order, more than once, and are let through once each, after what they depend on.

State by document: the ranges of numbers let through for each agent, and the operations that wait for a parent. `apply_ops` feeds
what is let through to materialised registers in foreachBatch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ARRIVING = "doc long, agent string, seq long, parents array<struct<agent:string,seq:long>>, payload string"
LET_THROUGH = "doc long, agent string, seq long, parents array<struct<agent:string,seq:long>>, payload string, position long"


def let_through(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One document's arrivals: known ones are dropped, those with unknown parents wait, others go on, each behind its parents."""
    known_json, waiting_json, position = state.get if state.exists else ("{}", "[]", 0)
    known = {a: [tuple(r) for r in ranges] for a, ranges in json.loads(known_json).items()}
    waiting = [tuple(x) for x in json.loads(waiting_json)]

    def has(agent: str, seq: int) -> bool:
        return any(s <= seq < e for s, e in known.get(agent, ()))

    def add(agent: str, seq: int) -> None:
        ranges = sorted([*known.get(agent, []), (seq, seq + 1)])
        out = [ranges[0]]
        for s, e in ranges[1:]:
            if s <= out[-1][1]:
                out[-1] = (out[-1][0], max(e, out[-1][1]))
            else:
                out.append((s, e))
        known[agent] = out

    for batch in batches:
        for r in batch.itertuples():
            parents = [(p["agent"], int(p["seq"])) if isinstance(p, dict) else (p.agent, int(p.seq)) for p in (r.parents if r.parents is not None else [])]
            waiting.append((r.agent, int(r.seq), parents, r.payload))
    out, moved = [], True
    waiting.sort(key=lambda x: (x[1], x[0]))
    while moved:
        moved, rest = False, []
        for agent, seq, parents, payload in waiting:
            if has(agent, seq):
                pass
            elif all(has(*p) for p in parents):
                add(agent, seq)
                out.append((key[0], agent, seq, [{"agent": a, "seq": s} for a, s in parents], payload, position))
                position += 1
                moved = True
            else:
                rest.append((agent, seq, parents, payload))
        waiting = rest
    state.update((json.dumps(known), json.dumps(waiting), position))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in ("doc", "agent", "seq", "parents", "payload", "position")])


def causal_stream(arrivals: DataFrame) -> DataFrame:
    """A stream of ARRIVING rows to one of LET_THROUGH rows."""
    return arrivals.groupBy("doc").applyInPandasWithState(let_through, LET_THROUGH, "known string, waiting string, position long", "append", GroupStateTimeout.NoTimeout)


def materialise(path: str, by: list[str], order: list[str]):
    """A foreachBatch function that keeps, as Parquet under path/<epoch>, the last row of each key so far."""

    def apply_ops(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/{epoch - 1}").unionByName(batch)
        best = rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in by]), F.struct(*order)).alias("r")).select(*by, "r.*")
        best.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/{epoch}")

    return apply_ops
