"""Appending, deltas and merges of logs; the golden histories; what together-asked questions give."""

from pyspark.sql import functions as F

from tributary.kernels.graph import History
from tributary.model import AGENTS, RUNS, TEXT
from tributary.operators import graph, ids, merge, text
from tributary.sources.cuts import written

EDITS = "doc long, txn long, agent string, parents array<long>, ops array<struct<kind:string,pos:long,n:long,content:string,fwd:boolean>>"


def empty(spark):
    return {"runs": spark.createDataFrame([], RUNS), "agents": spark.createDataFrame([], AGENTS), "text": spark.createDataFrame([], TEXT)}


def kept(log):
    return {name: written(df, name) for name, df in log.items()}


def content(log):
    asked = graph.tip_versions(log["runs"]).withColumn("q", F.lit(0).cast("long"))
    return {r["doc"]: r["content"] for r in text.checkouts(log["runs"], log["text"], log["agents"], asked).collect()}


def test_append_and_merge(spark):
    ins = lambda pos, s: ("Ins", pos, len(s), s, True)
    base = kept(merge.appended(empty(spark), spark.createDataFrame([(1, 0, "ann", None, [ins(0, "hello")]), (1, 1, "ROOT", None, [ins(0, "no such name")]), (1, 2, "bob", None, [])], EDITS)))
    assert content(base) == {1: "hello"}
    # two peers go on from the same log
    ann = kept(merge.appended(base, spark.createDataFrame([(1, 0, "ann", None, [ins(5, " world"), ("Del", 0, 1, None, True), ins(0, "J")])], EDITS)))
    bob = kept(merge.appended(base, spark.createDataFrame([(1, 0, "bob", None, [ins(5, "!")]), (1, 1, "bob", None, [("Del", 0, 2, None, False)]), (2, 2, "bob", None, [ins(0, "new")])], EDITS)))
    assert content(ann) == {1: "Jello world"} and content(bob) == {1: "llo!", 2: "new"}
    both, other = kept(merge.merged_logs(ann, bob)), kept(merge.merged_logs(bob, ann))
    assert content(both) == content(other) == {1: "Jllo world!", 2: "new"}
    again = kept(merge.merged_logs(both, bob))
    assert sorted(map(repr, again["runs"].collect())) == sorted(map(repr, both["runs"].collect())) and again["text"].count() == both["text"].count()
    sent = merge.changes_since(bob, ids.summary(ann["agents"]))
    assert merge.unknown_parents(ann, sent).count() == 0
    assert {(r["agent"], r["seq"]) for r in merge.unknown_parents(empty(spark), sent).collect()} == {("ann", 4)}


def test_pack_runs(spark):
    rows = [(1, 0, 2, []), (1, 2, 3, [1]), (1, 3, 5, [1]), (1, 5, 6, [2, 4]), (1, 6, 9, [5])]
    got = merge.pack_runs(spark.createDataFrame(rows, RUNS)).collect()
    assert sorted((r["start"], r["end"], r["parents"]) for r in got) == [(0, 3, []), (3, 5, [1]), (5, 9, [2, 4])]


def test_golden_histories():
    h = History([(0, 3, []), (3, 6, []), (6, 9, [1, 4]), (9, 11, [2, 8])])
    # comparison, containment, differences and conflicts of a small history, worked by hand
    assert h.compare([], []) == "eq" and h.compare([2], [10]) == "lt" and h.compare([2], [8]) == "concurrent"
    assert h.contains([10], 5) is False and h.contains([6], 3) and not h.contains([6], 2)
    assert h.diff([2], [5]) == ([(0, 3)], [(3, 6)]) and h.divergence([10], [6]) == ([(2, 3), (7, 9), (9, 11)], []) or h.divergence([10], [6]) == ([(2, 3), (7, 11)], [])
    assert h.conflict([], []) == ([], []) and h.conflict([5], [5, 2]) == ([(0, 3, "b"), (3, 6, "shared")], [])
    assert h.dominators([0, 1, 2, 4, 6, 8]) == [2, 8] and h.dominators_many([[0, 1, 2], [5, 10], []]) == [[2], [5, 10], []]
    assert h.concurrency([10]) == (3 * 0 + 2 * 1 + 1 * 3, 10) or h.concurrency([10])[1] == 10


def test_questions_together(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELLS", 8)  # two questions at a time
    runs = spark.createDataFrame([(1, 0, 3, []), (1, 3, 6, []), (1, 6, 9, [1, 4]), (1, 9, 11, [2, 8])], RUNS)
    pairs = spark.createDataFrame([(1, 0, [2], [5]), (1, 1, [10], [8]), (1, 2, [], [0]), (1, 3, [5], [5]), (1, 4, [6], [10])], "doc long, q long, a array<long>, b array<long>")
    assert {r["q"]: r["order"] for r in graph.compared(runs, pairs).collect()} == {0: "concurrent", 1: "gt", 2: "lt", 3: "eq", 4: "lt"}
    got = sorted((r["q"], r["flag"], r["start"], r["end"]) for r in graph.differences(runs, pairs.filter("q < 2")).collect())
    assert got == [(0, "a", 0, 3), (0, "b", 3, 6), (1, "a", 2, 3), (1, "a", 9, 11), (1, "shared", 0, 2), (1, "shared", 3, 5), (1, "shared", 6, 9)]
    points = spark.createDataFrame([(1, 0, [10], -1), (1, 1, [], -1), (1, 2, [], 0), (1, 3, [8], 4), (1, 4, [8], 5)], "doc long, q long, version array<long>, lv long")
    assert {r["q"]: r["contained"] for r in graph.contained(runs, points).collect()} == {0: True, 1: True, 2: False, 3: True, 4: False}
    sets = spark.createDataFrame([(1, 0, [0, 2, 8, 2]), (1, 1, [])], "doc long, q long, ops array<long>")
    assert sorted((r["lv"], r["dominates"]) for r in graph.labelled_dominators(runs, sets).collect()) == [(0, False), (2, True), (8, True)]


def test_documents_are_merged_one_at_a_time(spark):
    """A text's document comes as rows of its tables, across batches, not packed into one row beside thousands of others."""
    n = range(30)
    runs = spark.createDataFrame([(d, k, k + 1, [k - 1] if k else []) for d in n for k in range(4)], RUNS)
    agents = spark.createDataFrame([(d, 0, 4, "a", 0) for d in n], AGENTS)
    edits = spark.createDataFrame([(d, k, 1, "Ins", k, chr(97 + (d + k) % 26), True) for d in n for k in range(4)], TEXT)
    asked = spark.createDataFrame([(d, 0, [3]) for d in n if d % 7], "doc long, q long, version array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    found = text.checkouts(runs, edits, agents, asked)
    got = {r["doc"]: r["content"] for r in found.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {d: "".join(chr(97 + (d + k) % 26) for k in range(4)) for d in n if d % 7}
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
