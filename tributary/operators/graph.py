"""Questions about histories, for many documents and many versions at once.

A document's questions are answered by a kernel on its runs, in one descending pass each. Documents are spread by key;
one with many questions is split: its questions are dealt into groups of at most about `per_task`, each of which gets the document's
runs, so that a hot document isn't one task. What joins and aggregates express (tips, parents, one closure for all) is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.graph import History, Span, chain_cover, to_dot, within
from .runs import coalesce_runs, intersect_runs, lookup, sorted_join

PER_TASK = 4096
CELLS = 1 << 21  # of a table of runs x questions, 8 bytes each


def history_of(runs: pd.DataFrame) -> History:
    return History(zip(runs["start"], runs["end"], runs["parents"], strict=True))


def grouped(runs: DataFrame, questions: DataFrame, answered: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, per_task: int = PER_TASK) -> DataFrame:
    """answered(runs, questions) for each document; one with more than `per_task` questions is dealt into several groups."""
    many = sorted_join(questions.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_task)).alias("_parts")))
    dealt = questions.withColumn("_row", F.monotonically_increasing_id()).join(many, "doc").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts"))).drop("_parts", "_row")
    dealt = dealt.select(*(F.col(c).alias(c) for c in dealt.columns))  # new names for a table that may share its origin with runs
    copies = runs.join(many, "doc").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    return copies.groupBy("doc", "_part").cogroup(dealt.groupBy("doc", "_part")).applyInPandas(answered, schema)


def ask(runs: DataFrame, questions: DataFrame, answer: Callable[[History, dict], Iterable[tuple]], schema: str, per_task: int = PER_TASK) -> DataFrame:
    """questions (doc, ...) to the rows that answer(history, question) gives, of the given schema."""
    names = [x.split()[0] for x in schema.split(", ")]

    def answered(runs_: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        history = history_of(runs_)
        return pd.DataFrame([row for q in asked.to_dict("records") for row in answer(history, q)], columns=names)

    return grouped(runs, questions, answered, schema, per_task)


def ask_together(runs: DataFrame, questions: DataFrame, answer: Callable[[History, pd.DataFrame], dict], schema: str) -> DataFrame:
    """As ask, but answer(history, questions) gets some of a group's questions at a time, as many as keep a table of runs x
    questions within CELLS, and gives the columns beside doc."""
    names = [x.split()[0] for x in schema.split(", ")]

    def answered(runs_: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        history = history_of(runs_)
        step = max(1, CELLS // max(1, len(runs_)))
        parts = [pd.DataFrame({"doc": asked["doc"].iloc[0], **answer(history, asked.iloc[k : k + step])}, columns=names) for k in range(0, len(asked), step)]
        return pd.concat(parts) if parts else pd.DataFrame(columns=names)

    return grouped(runs, questions, answered, schema)


def ints(v) -> list[int]:
    return [int(x) for x in v]


def versions(asked: pd.DataFrame, name: str) -> list[list[int]]:
    return [ints(v) for v in asked[name]]


def spans_between(history: History, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict:
    """(q, start, end) of the operations above low and up to high, run by run."""
    starts = np.array(history.starts, dtype=np.int64)[:, None]
    begin = np.maximum(starts, low + 1)
    run, which = np.nonzero(begin <= high)
    return {"q": q[which], "start": begin[run, which], "end": high[run, which] + 1}


def closures(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (doc, q, version) to the spans (doc, q, start, end) of each one's history, cut where runs begin."""

    def answer(h: History, x: pd.DataFrame) -> dict:
        top = h.reach_many(versions(x, "version"))
        return spans_between(h, x["q"].to_numpy(), np.full_like(top, -1), top)

    return ask_together(runs, asked, answer, "doc long, q long, start long, end long")


def compared(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (doc, q, a, b) to (doc, q, order): lt, eq, gt or concurrent."""

    def answer(h: History, x: pd.DataFrame) -> dict:
        a, b = h.reach_many(versions(x, "a")), h.reach_many(versions(x, "b"))
        more, less = (a > b).any(axis=0), (a < b).any(axis=0)
        return {"q": x["q"].to_numpy(), "order": np.select([more & less, more, less], ["concurrent", "gt", "lt"], "eq")}

    return ask_together(runs, pairs, answer, "doc long, q long, order string")


def contained(runs: DataFrame, points: DataFrame) -> DataFrame:
    """points (doc, q, version, lv) to (doc, q, lv, contained); -1, the root, always is."""

    def answer(h: History, x: pd.DataFrame) -> dict:
        top, lv = h.reach_many(versions(x, "version")), x["lv"].to_numpy()
        run = np.array([h.run_of(v) if v >= 0 else 0 for v in lv.tolist()], dtype=np.int64)
        return {"q": x["q"].to_numpy(), "lv": lv, "contained": top[run, np.arange(len(lv))] >= lv}

    return ask_together(runs, points, answer, "doc long, q long, lv long, contained boolean")


def differences(runs: DataFrame, pairs: DataFrame, flags: tuple[str, ...] = ("a", "b", "shared")) -> DataFrame:
    """pairs (doc, q, a, b) to (doc, q, flag, start, end): what only a, only b and both have, cut where runs begin."""

    def answer(h: History, x: pd.DataFrame) -> dict:
        q, a, b = x["q"].to_numpy(), h.reach_many(versions(x, "a")), h.reach_many(versions(x, "b"))
        sides = {"a": (b, a), "b": (a, b), "shared": (np.full_like(a, -1), np.minimum(a, b))}
        found = {f: spans_between(h, q, *sides[f]) for f in flags}
        return {"flag": np.repeat(list(flags), [len(x["q"]) for x in found.values()]), **{c: np.concatenate([x[c] for x in found.values()]) for c in ("q", "start", "end")}}

    return ask_together(runs, pairs, answer, "doc long, q long, flag string, start long, end long")


def conflicts(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (doc, q, a, b) to (doc, q, flag, start, end, common): spans back to the common version, which every row repeats; a row with null flag where there are none."""

    def answer(h: History, x: pd.DataFrame) -> dict:
        sides = versions(x, "a"), versions(x, "b")
        tops = [h.reach_many(v) for v in sides]
        rows = []
        for k, (q, a, b) in enumerate(zip(x["q"].tolist(), *sides, strict=True)):
            spans, common = h.conflict(a, b, (tops[0][:, k], tops[1][:, k]))
            text = ",".join(map(str, common))
            rows += [(q, flag, s, e, text) for s, e, flag in spans] or [(q, None, None, None, text)]
        columns = list(zip(*rows, strict=True))
        return {"q": columns[0], "flag": columns[1], "start": pd.array(columns[2], "Int64"), "end": pd.array(columns[3], "Int64"), "common": columns[4]}

    return ask_together(runs, pairs, answer, "doc long, q long, flag string, start long, end long, common string")


def conflict_graphs(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (doc, q, a, b) to the runs (doc, q, start, end, flag, parents) that both have after their common version; those without parents stand on it."""
    rows = lambda h, q: ((q["doc"], q["q"], *run) for run in h.conflict_graph(ints(q["a"]), ints(q["b"]))[0])
    return ask(runs, pairs, rows, "doc long, q long, start long, end long, flag string, parents array<long>")


def merge_plans(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (doc, q, a, b) to the steps (doc, q, step, action, start, end) that take a text from a to a and b together: see History.merge_plan."""
    rows = lambda h, q: ((q["doc"], q["q"], k, *step) for k, step in enumerate(h.merge_plan(ints(q["a"]), ints(q["b"]))))
    return ask(runs, pairs, rows, "doc long, q long, step long, action string, start long, end long")


def plan_costs(plans: DataFrame) -> DataFrame:
    """(doc, q, clears, forwarded, applied, replayed, moved) of plans with steps: how often the tracker begins anew, and operations by kind of step."""
    n = lambda *actions: F.sum(F.when(F.col("action").isin(*actions), F.col("end") - F.col("start")).otherwise(0))
    kinds = {"forwarded": n("forward"), "applied": n("apply"), "replayed": n("replay"), "moved": n("retreat", "advance")}
    return plans.groupBy("doc", "q").agg(F.count_if(F.col("action") == "clear").alias("clears"), *(c.alias(name) for name, c in kinds.items()))


def advanced(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (doc, q, version, spans array<struct<start,end>>) to (doc, q, version) after the spans, whose parents the version or the spans have."""
    return versions_of(runs, questions, lambda h, q: h.advance(ints(q["version"]), h.split(spans_of(q, "spans"), ())))


def retreated(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (doc, q, version, spans) to (doc, q, version) without the spans; nothing that is left may descend from them."""
    return versions_of(runs, questions, lambda h, q: h.retreat(ints(q["version"]), spans_of(q, "spans")))


def versions_of(runs: DataFrame, questions: DataFrame, form: Callable[[History, dict], list[int]]) -> DataFrame:
    """questions (doc, q, ...) to (doc, q, version), the version being form's."""
    return ask(runs, questions, lambda h, q: [(q["doc"], q["q"], form(h, q))], "doc long, q long, version array<long>")


def dominators(runs: DataFrame, sets: DataFrame) -> DataFrame:
    """sets (doc, q, ops) to (doc, q, version): the operations that no other contains."""
    return ask_together(runs, sets, lambda h, x: {"q": x["q"].to_numpy(), "version": h.dominators_many(versions(x, "ops"))}, "doc long, q long, version array<long>")


def labelled_dominators(runs: DataFrame, sets: DataFrame) -> DataFrame:
    """sets (doc, q, ops) to (doc, q, lv, dominates): each of the operations once, and whether no other contains it."""

    def answer(h: History, x: pd.DataFrame) -> dict:
        sets_ = versions(x, "ops")
        rows = [(q, v, v in best) for q, ops, best in zip(x["q"].tolist(), sets_, map(set, h.dominators_many(sets_)), strict=True) for v in dict.fromkeys(ops)]
        q, lv, dominates = zip(*rows, strict=True) if rows else ((), (), ())
        return {"q": q, "lv": lv, "dominates": dominates}

    return ask_together(runs, sets, answer, "doc long, q long, lv long, dominates boolean")


def unions(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    return dominators(runs, pairs.select("doc", "q", F.concat("a", "b").alias("ops")))


def shadow_contains(a, b, shadow_of_a):
    """Whether b, by a's shadow alone, is a or an ancestor of it: a quick yes; otherwise the history must be asked. Columns."""
    return (a == b) | ((a > b) & (shadow_of_a <= b))


def shadow_of(points: DataFrame, runs: DataFrame) -> DataFrame:
    """points (doc, lv, ...) with shadow: the least operation from which all up to the point are known to be its ancestors."""
    found = lookup(points, shadows(runs), ["doc"])
    return found.drop("start", "end", "offset")


def exists_at(created: DataFrame, deleted: DataFrame, spans: DataFrame) -> DataFrame:
    """created (doc, name, lv) and deleted (doc, name, lv) of things, and the spans (doc, start, end) of a version's history by document:
    the things that were created and not deleted at the version."""
    then = lambda x: lookup(x, spans.select("doc", "start", "end"), ["doc"]).select(*x.columns)
    return then(created).join(then(deleted).select("doc", "name").distinct(), ["doc", "name"], "left_anti")


def common_versions(runs: DataFrame, agents: DataFrame, theirs: DataFrame) -> DataFrame:
    """theirs (doc, agent, start, end), another peer's summary, to (doc, version): the operations that both know and that no other of these follows."""
    ours = agents.select("doc", "agent", F.col("seq_start").alias("start"), (F.col("seq_start") + F.col("lv_end") - F.col("lv_start")).alias("end"), (F.col("lv_start") - F.col("seq_start")).alias("shift"))
    known = intersect_runs(ours, theirs.select("doc", "agent", "start", "end"), ["doc", "agent"])
    spans = known.select("doc", (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"))
    ends = intersect_runs(spans, runs.select("doc", "start", "end"), ["doc"]).groupBy("doc").agg(F.collect_list(F.col("end") - 1).alias("ops"))
    return dominators(runs, ends.withColumn("q", F.lit(0).cast("long"))).select("doc", "version")


def spans_of(q: dict, name: str = "keep") -> list[Span]:
    return sorted((int(x["start"]), int(x["end"])) for x in q[name])


def projections(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (doc, q, version, keep array<struct<start,end>>) to (doc, q, version) on the kept operations."""
    return versions_of(runs, questions, lambda h, q: h.project(ints(q["version"]), spans_of(q)))


def subgraphs(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (doc, q, version, keep) to (doc, q, start, end, parents) of the induced history."""
    return ask(runs, questions, lambda h, q: [(q["doc"], q["q"], s, e, p) for s, e, p in h.subgraph(ints(q["version"]), spans_of(q))], "doc long, q long, start long, end long, parents array<long>")


def simple_runs(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (doc, q, version) to runs (doc, q, start, end, parents) whose parents are last in their runs."""
    return ask(runs, asked, lambda h, q: [(q["doc"], q["q"], s, e, p) for s, e, p in h.simple_runs(ints(q["version"]))], "doc long, q long, start long, end long, parents array<long>")


def shadows(runs: DataFrame) -> DataFrame:
    """Runs with their shadow: the least operation from which all up to the run are its ancestors."""
    one = runs.select("doc").distinct()
    return ask(runs, one, lambda h, q: [(q["doc"], s, e, x) for s, e, x in zip(h.starts, h.ends, h.shadows(), strict=True)], "doc long, start long, end long, shadow long")


def concurrency(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (doc, q, version) to (doc, q, total, ops): total / ops is the mean number of other open branches."""
    return ask(runs, asked, lambda h, q: [(q["doc"], q["q"], *h.concurrency(ints(q["version"])))], "doc long, q long, total long, ops long")


def concurrency_of_logs(runs: DataFrame) -> DataFrame:
    """(doc, total, ops) of each whole log, by one aggregation: an operation is open until its first child, a run's inner ones until the next of the run."""
    first = runs.select("doc", F.explode("parents").alias("lv"), "start").groupBy("doc", "lv").agg(F.min("start").alias("child"))
    ends = runs.select("doc", "start", "end", (F.col("end") - 1).alias("lv"))
    n = runs.groupBy("doc").agg(F.max("end").alias("n"))
    waits = ends.join(first, ["doc", "lv"], "left").join(n, "doc")
    return waits.groupBy("doc").agg(F.sum(F.coalesce("child", "n") - F.col("end")).alias("total"), F.sum(F.col("end") - F.col("start")).alias("ops"))


def tips(runs: DataFrame) -> DataFrame:
    """(doc, lv): operations that are no one's parent."""
    used = runs.select("doc", F.explode("parents").alias("lv")).distinct()
    return runs.select("doc", (F.col("end") - 1).alias("lv")).join(sorted_join(used), ["doc", "lv"], "left_anti")


def tip_versions(runs: DataFrame) -> DataFrame:
    """(doc, version)."""
    return tips(runs).groupBy("doc").agg(F.array_sort(F.collect_list("lv")).alias("version"))


def parents_of(points: DataFrame, runs: DataFrame) -> DataFrame:
    """points (doc, lv, ...) with the version that each operation was made at."""
    found = lookup(points, runs, ["doc"])
    parents = F.when(F.col("offset") == 0, F.col("parents")).otherwise(F.array(F.col("lv") - 1))
    return found.withColumn("at", parents).drop("start", "end", "parents", "offset").withColumnRenamed("at", "parents")


def closure_by_joins(runs: DataFrame, heads: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """heads (doc, q, lv) to history spans by repeated joins, one round for each level of runs. `cut` writes a round's rows.

    For shallow histories of few, very large documents; many documents are better served by closures().
    """
    at = cut(lookup(heads, runs, ["doc"]).groupBy("doc", "q", "start", "parents").agg((F.max("lv") + 1).alias("end")))
    seen = at
    while not at.isEmpty():
        up = at.select("doc", "q", F.explode("parents").alias("lv")).distinct()
        found = lookup(up, runs, ["doc"]).groupBy("doc", "q", "start", "parents").agg((F.max("lv") + 1).alias("end"))
        known = seen.groupBy("doc", "q", "start").agg(F.max("end").alias("reached"))
        at = cut(found.join(known, ["doc", "q", "start"], "left").filter(F.col("reached").isNull() | (F.col("end") > F.col("reached"))).drop("reached"))
        seen = cut(seen.unionByName(at))
    widest = seen.groupBy("doc", "q", "start").agg(F.max("end").alias("end"))
    return coalesce_runs(widest, ["doc", "q"])


def dots(runs: DataFrame) -> DataFrame:
    """(doc, dot): Graphviz text of each history."""
    return ask(runs, runs.select("doc").distinct(), lambda h, q: [(q["doc"], to_dot(h))], "doc long, dot string")


def chain_covers(runs: DataFrame, agents: DataFrame) -> DataFrame:
    """(doc, agent, start, end, slot): each agent's runs, cut where the history's runs begin, dealt into slots that are totally ordered."""
    mine = agents.select("doc", "agent", F.col("lv_start").alias("start"), F.col("lv_end").alias("end"))
    cut = intersect_runs(mine, runs.select("doc", "start", "end"), ["doc"])
    spans = cut.groupBy("doc", "agent").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("keep"))

    def answer(h: History, q: dict):
        mine = spans_of(q)
        yield from ((q["doc"], q["agent"], s, e, slot) for (s, e), slot in zip(mine, chain_cover(h, mine), strict=True))

    return ask(runs, spans, answer, "doc long, agent string, start long, end long, slot long")


def unsound(runs: DataFrame) -> DataFrame:
    """Runs that break the table's rules: empty, with parents not before them, or with unsorted parents."""
    late = F.exists("parents", lambda p: p >= F.col("start"))
    return runs.filter((F.col("start") >= F.col("end")) | late | (F.col("parents") != F.array_sort(F.array_distinct("parents"))))
