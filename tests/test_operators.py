"""Operators on small tables: edge cases, codecs, sources, streaming."""

import json
import random

from pyspark.sql import functions as F

from tributary import model
from tributary.functions import checksums, scalars
from tributary.operators import graph, ids, merge, runs, sets, stats, sync, text, trees
from tributary.registry import QUERIES
from tributary.sources import logs
from tributary.streaming import ingest


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_runs_edges(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (2, 0, 1)], "k long, start long, end long")
    assert rows(runs.coalesce_runs(a, ["k"]), "k", "start", "end") == [(1, 0, 7), (1, 9, 12), (2, 0, 1)]
    assert rows(runs.gaps(a, ["k"]), "k", "start", "end") == [(1, 7, 9)]
    b = spark.createDataFrame([(1, 3, 200, "x"), (3, 0, 9, "y")], "k long, start long, end long, v string")
    assert rows(runs.intersect_runs(a, b, ["k"], 2), "k", "start", "end", "v") == [(1, 3, 5, "x"), (1, 5, 7, "x"), (1, 9, 12, "x")]
    empty = a.filter("false")
    assert runs.coalesce_runs(empty, ["k"]).count() == runs.intersect_runs(empty, b, ["k"]).count() == 0
    p = spark.createDataFrame([(1, 4), (1, 8), (2, 5)], "k long, lv long")
    assert rows(runs.lookup(p, a, ["k"]), "k", "lv", "start", "offset") == [(1, 4, 0, 4)]
    assert sorted(r["lv"] for r in runs.lookup(p, a, ["k"], how="left").collect()) == [4, 5, 8]
    assert rows(runs.next_run(p.filter("k = 1"), a, ["k"]), "lv", "next_start") == [(4, 0), (8, 9)]
    assert rows(runs.take_max(a.filter("k = 1 AND start = 0"), 2), "start", "end") == [(0, 2), (2, 4), (4, 5)]
    assert runs.overlaps(a.union(spark.createDataFrame([(1, 6, 8)], "k long, start long, end long")), ["k"]).count() == 1


def test_run_joins_are_not_broadcast(spark, tmp_path):
    spark.range(1000).selectExpr("id % 9 AS doc", "id AS start", "id + 1 AS end").write.parquet(f"{tmp_path}/runs")
    small = spark.read.parquet(f"{tmp_path}/runs")
    for met in (runs.intersect_runs(small, small, ["doc"]), runs.lookup(small.select("doc", F.col("start").alias("lv")), small, ["doc"], how="left")):
        assert met.count() == 1000
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_remote_versions_are_their_documents(spark):
    found = QUERIES["remote_version"](spark, "/root/testdata/sf0.1").collect()
    assert len(found) == 188 and all(int(name[1:7]) // 8 == r["doc"] for r in found for name in r["remote"].split(","))
    agents = spark.createDataFrame([(1, 0, 3, "u1", 0)], model.AGENTS)
    twice = spark.createDataFrame([(1, 7, [0, 2]), (1, 8, [0, 2]), (1, 9, [])], "doc long, q long, version array<long>")
    assert [[tuple(x) for x in r["remote"]] for r in ids.remote_version(twice, agents).orderBy("q").collect()] == [[("u1", 0), ("u1", 2)]] * 2 + [[]]


def test_versions(spark):
    df = spark.createDataFrame([([3, 8], [3], 9)], "v array<long>, p array<long>, last long")
    assert df.select(model.advance_by_run(F.col("v"), F.col("p"), F.col("last")).alias("x")).first()["x"] == [8, 9]
    assert df.select(model.spelled(F.col("v")).alias("x"), model.is_sorted(F.col("v")).alias("s"), model.single(F.col("p")).alias("o")).first() == ("3,8", True, 3)


def test_closure_by_joins_equals_kernel(spark, tmp_path):
    r = random.Random(5)
    table, tips = [], [[]]
    n = 0
    for _ in range(12):
        parents = sorted(set(r.sample(range(n), min(n, r.randint(0, 2)))))
        m = r.randint(1, 5)
        table.append((1, n, n + m, parents))
        n += m
        tips.append([n - 1])
    runs_ = spark.createDataFrame(table, model.RUNS)
    heads = spark.createDataFrame([(1, k, k) for k in range(0, n, 3)], "doc long, q long, lv long")
    count = iter(range(1000))

    def cut(df):
        path = f"{tmp_path}/{next(count)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    by_joins = graph.closure_by_joins(runs_, heads, cut)
    by_kernel = graph.closures(runs_, heads.select("doc", "q", F.array("lv").alias("version")))
    assert rows(by_joins, "q", "start", "end") == rows(by_kernel, "q", "start", "end")


def test_ask_deals_hot_documents(spark):
    runs_ = spark.createDataFrame([(1, 0, 50, [])], model.RUNS)
    asked = spark.createDataFrame([(1, k, [k]) for k in range(50)], "doc long, q long, version array<long>")
    out = graph.ask(runs_, asked, lambda h, q: [(q["q"], h.closure([int(x) for x in q["version"]])[0][1])], "q long, end long", per_task=7)
    assert rows(out, "q", "end") == [(k, k + 1) for k in range(50)]


def test_agent_names(spark):
    df = spark.createDataFrame([("a",), ("ROOT",), ("x" * 50,), (None,)], "n string")
    assert [r[0] for r in df.select(ids.is_agent_name(F.col("n"))).collect()] == [True, False, False, False]


def test_sets(spark):
    ins = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    dels = spark.createDataFrame([(2,), (2,), (9,)], "id long")
    assert rows(sets.live(ins, dels, ["id"]), "id", "v") == [(1, "a")] and rows(sets.dangling(ins, dels, ["id"]), "id") == [(9,)]


def test_trees(spark):
    entries = spark.createDataFrame([(1, -1, "a", None, 5), (1, 5, "b", "x", None), (1, -1, "c", "y", None)], "doc long, crdt long, key string, value string, child long")
    assert [json.loads(r["json"]) for r in trees.nested_json(trees.checkout(entries)).collect()] == [{"a/b": "x", "c": "y"}]
    assert trees.at_path(entries, ["a", "b"]).first()["value"] == "x" and trees.at_path(entries, ["a", "z"]).count() == 0
    assert trees.checkout(entries.filter("false")).count() == 0


def test_sync(spark):
    ours = spark.createDataFrame([(1, "a", 0, 0, 0), (1, "a", 1, 1, 1)], "doc long, agent string, seq long, lv long, order long")
    them = spark.createDataFrame([(1, "a", 1, 0, 0), (1, "b", 0, 1, 1), (2, "c", 0, 0, 0)], ours.schema)
    once = sync.ingest(ours, them)
    assert rows(once, "doc", "agent", "seq", "lv") == [(1, "a", 0, 0), (1, "a", 1, 1), (1, "b", 0, 2), (2, "c", 0, 0)]
    assert sync.same_log(once, sync.ingest(once, them), ["doc", "agent", "seq", "lv"])


def test_order_violations(spark):
    runs_ = spark.createDataFrame([(1, 0, 1, []), (1, 1, 2, [])], model.RUNS)
    agents = spark.createDataFrame([(1, 0, 1, "a", 0), (1, 1, 2, "a", 1)], model.AGENTS)
    assert rows(stats.order_violations(runs_, agents), "agent", "lv") == [("a", 1)]
    assert rows(stats.many_rooted(runs_), "n_roots") == [(2,)]
    bad = spark.createDataFrame([(1, 0, 0, []), (1, 3, 4, [3])], model.RUNS)
    assert graph.unsound(bad).count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([(0,), (-1,), (1,), (-(2**40),), (2**40,)], "x long")
    out = df.select("x", scalars.zigzag(F.col("x")).alias("z")).withColumn("back", scalars.unzigzag(F.col("z"))).collect()
    assert [r["z"] for r in out[:3]] == [0, 1, 2] and all(r["x"] == r["back"] for r in out)
    t = spark.createDataFrame([("a𐆐bé", "a𐆐Xbé"), ("", "x"), ("same", "same"), ("aaa", "aa")], "a string, b string")
    got = t.select(scalars.utf16_length(F.col("a")), scalars.chars_to_utf16(F.col("a"), F.lit(2)), scalars.utf16_to_chars(F.col("a"), F.lit(3)), scalars.chars_to_bytes(F.col("a"), F.lit(2))).first()
    assert tuple(got) == (5, 3, 2, 5)
    d = [tuple(r["d"]) for r in t.select(scalars.calc_diff(F.col("a"), F.col("b")).alias("d")).collect()]
    assert d == [(2, 0, "X"), (0, 0, "x"), (4, 0, ""), (2, 1, "")]
    cases = [(5, "Ins", 5, 8, 5, 8), (6, "Ins", 5, 8, 9, 9), (6, "Del", 5, 8, 5, 5), (9, "Del", 5, 8, 6, 6), (2, "Del", 5, 8, 2, 2)]
    c = spark.createDataFrame([x[:4] for x in cases], "at long, kind string, s long, e long")
    both = c.select(*(scalars.transform_position(F.col("at"), F.col("kind"), F.col("s"), F.col("e"), left) for left in (True, False))).collect()
    assert [tuple(r) for r in both] == [x[4:] for x in cases]
    ops = F.array(F.struct(F.lit("Ins").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(2).cast("long").alias("end")), F.struct(F.lit("Del").alias("kind"), F.lit(1).cast("long").alias("start"), F.lit(3).cast("long").alias("end")))
    assert spark.range(1).select(scalars.transform_through(F.lit(5).cast("long"), ops)).first()[0] == 5
    for n in (0, 1, 127, 128, 300, 2**40):
        assert scalars.from_leb128(scalars.leb128(n) + b"x") == (n, len(scalars.leb128(n)))


def test_sources(spark, tmp_path):
    line = {"startContent": "", "endContent": "hi!", "txns": [{"time": "2020-01-01T00:00:00Z", "patches": [[0, 0, "hello"], [1, 4, "i!"]]}]}
    (tmp_path / "t.json").write_text(json.dumps(line) + "\n")
    ops = logs.patches_to_text(logs.read_linear_traces(spark, str(tmp_path / "t.json")))
    assert rows(ops, "lv", "n", "kind", "pos", "content") == [(0, 5, "Ins", 0, "hello"), (5, 4, "Del", 1, None), (9, 2, "Ins", 1, "i!")]
    whole = {"txns": [{"span": [0, 1], "parents": [], "agent": "a", "seqStart": 0, "ops": [[0, 0, "a"]]}, {"span": [1, 2], "parents": [], "agent": "b\"", "seqStart": 0, "ops": [[0, 0, "\"b"[1:]]]}, {"span": [2, 3], "parents": [0, 1], "agent": "a", "seqStart": 1, "ops": [[2, 0, "c"]]}], "endContent": "abc"}
    (tmp_path / "c.json").write_text(json.dumps(whole) + "\n")
    t = logs.read_conformance(spark, str(tmp_path / "c.json"))
    tips = graph.tip_versions(t["runs"]).withColumn("q", F.lit(0).cast("long"))
    assert [r["content"] for r in text.checkouts(t["runs"], t["text"], t["agents"], tips).collect()] == ["abc"]
    out = [json.loads(r["json"]) for r in logs.export_conformance(t["runs"], t["agents"], t["text"], t["ends"]).collect()]
    assert out == [whole]
    logs.write_log(t, str(tmp_path / "log"), content=False)
    assert rows(logs.read_log(spark, str(tmp_path / "log"))["runs"], "start", "end") == [(0, 1), (1, 2), (2, 3)]
    (tmp_path / "times.jsonl").write_text('["a", 0, "2020-01-01T00:00:00+02:00"]\n')
    assert logs.read_times(spark, str(tmp_path / "times.jsonl")).filter("time = timestamp'2019-12-31 22:00:00'").count() == 1
    delta = logs.delta_json(t["agents"], ["agent", "seq_start"])
    assert rows(logs.read_delta(delta, "agent string, seq_start long"), "agent", "seq_start") == [("a", 0), ("a", 1), ('b"', 0)]


def test_stream(spark, tmp_path):
    def op(agent, seq, parents, payload):
        return json.dumps({"doc": 1, "agent": agent, "seq": seq, "parents": [{"agent": a, "seq": s} for a, s in parents], "payload": payload})

    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join([op("b", 0, [("a", 1)], "late parent"), op("a", 0, [], "first"), op("a", 0, [], "again")]))
    arrivals = spark.readStream.schema(ingest.ARRIVING).option("maxFilesPerTrigger", 1).json(str(source))
    go = lambda: ingest.causal_stream(arrivals).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    go()
    (source / "2.json").write_text("\n".join([op("a", 1, [("a", 0)], "second"), op("a", 0, [], "once more")]))
    go()
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("position").collect()
    assert [(r["agent"], r["seq"], r["position"]) for r in found] == [("a", 0, 0), ("a", 1, 1), ("b", 0, 2)]


def test_materialise(spark, tmp_path):
    keep = ingest.materialise(str(tmp_path), ["key"], ["agent", "seq"])
    schema = "key string, agent string, seq long, value string"
    keep(spark.createDataFrame([("k", "a", 0, "x"), ("k", "b", 0, "y")], schema), 0)
    keep(spark.createDataFrame([("k", "a", 5, "z"), ("m", "a", 1, "w")], schema), 1)
    assert rows(spark.read.parquet(f"{tmp_path}/1"), "key", "value") == [("k", "y"), ("m", "w")]


def test_checksums_equal_bit_by_bit(spark):
    def plain(data):
        register = 0xFFFFFFFF
        for byte in data:
            register ^= byte
            for _ in range(8):
                register = (register >> 1) ^ (0x82F63B78 if register & 1 else 0)
        return register ^ 0xFFFFFFFF

    r = random.Random(3)
    blobs = [b"123456789", None, *(r.randbytes(n) for n in (0, 1, 3, 4, 5, 255, 256, 257, 511, 513, 9000)), bytes(300)]
    assert checksums.checksums(blobs)[0] == 0xE3069283 and checksums.checksums([]) == []
    df = spark.createDataFrame(list(enumerate(blobs)), "k int, data binary").select("k", checksums.crc32c(F.col("data")).alias("crc"))
    assert rows(df, "k", "crc") == [(k, None if b is None else plain(b)) for k, b in enumerate(blobs)]


def test_edited_branches(spark):
    log = {
        "runs": spark.createDataFrame([(1, 0, 5, []), (1, 5, 7, [2]), (2, 0, 2, [])], model.RUNS),
        "agents": spark.createDataFrame([(1, 0, 5, "ann", 0), (1, 5, 7, "ben", 0), (2, 0, 2, "ann", 0)], model.AGENTS),
        "text": spark.createDataFrame([(1, 0, 5, "Ins", 0, "hello", True), (1, 5, 2, "Ins", 3, "XY", True), (2, 0, 2, "Ins", 0, "ab", True)], model.TEXT),
    }
    branches = spark.createDataFrame([(1, "hello", [4]), (2, "ab", [1])], "doc long, content string, version array<long>")
    op = "doc long, txn long, agent string, ops array<struct<kind:string,pos:long,n:long,content:string,fwd:boolean>>"
    edits = spark.createDataFrame([(1, 0, "ann", [("Ins", 5, 1, "!", True), ("Del", 0, 1, None, True)]), (1, 1, "cid", [("Ins", 0, 1, "J", True)]), (1, 2, "ROOT", [("Del", 0, 3, None, True)])], op)
    grown, after = merge.edited_branches(log, branches, edits)
    assert sorted(tuple(r) for r in after.collect()) == [(1, "Jello!", [9]), (2, "ab", [1])]
    assert rows(grown["runs"].filter("doc = 1"), "start", "end", "parents")[2:] == [(7, 9, [4]), (9, 10, [8])]
    asked = spark.createDataFrame([(1, 0, [9]), (1, 1, [6, 9])], "doc long, q long, version array<long>")
    assert rows(text.checkouts(grown["runs"], grown["text"], grown["agents"], asked), "q", "content") == [(0, "Jello!"), (1, "Jello!XY")]  # at one place, ann comes before ben
    taken = after.filter("doc = 1").select(scalars.with_deleted(F.col("content"), F.expr("named_struct('kind', 'Del', 'pos', 1L, 'n', 3L, 'content', CAST(null AS string))")).alias("op"))
    assert taken.first()["op"]["content"] == "ell"
