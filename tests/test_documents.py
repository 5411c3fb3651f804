"""Codecs, versions, sampled versions and snapshots on cases worked by hand."""

from pyspark.sql import functions as F

from tributary import model
from tributary.functions import scalars
from tributary.operators import documents, ids, runs


def test_prefix_varint(spark):
    edges = [0, 1, 127, 128, 16511, 16512, 2113663, 2113664, (1 << 35) - 1, 1 << 49, 1 << 54, (1 << 56) + 12345, (1 << 62) + 7]
    edges += [least + d for least in scalars.PREFIX_LEAST[1:] for d in (-1, 0)]
    rows = spark.createDataFrame([(x,) for x in edges], "x long").withColumn("b", scalars.prefix_varint(F.col("x")))
    for r in rows.withColumn("y", scalars.from_prefix_varint(F.col("b"))).collect():
        size = next((k for k in range(1, 9) if r.x < scalars.PREFIX_LEAST[k]), 9)
        assert (r.y, len(r.b)) == (r.x, size), r
    short = spark.createDataFrame([(bytearray(b"\xc0\x01"),)], "b binary")
    assert short.select(scalars.from_prefix_varint(F.col("b"))).first()[0] is None


def test_bits_and_positions(spark):
    df = spark.createDataFrame([("a😀éb", 5)], "t string, x long")
    r = df.select(
        scalars.strip_bit(scalars.mix_bit(F.col("x"), F.lit(True))).alias("bit"),
        scalars.bytes_to_chars(F.col("t"), F.lit(5)).alias("chars"),
        scalars.utf16_edit(F.col("t"), F.lit(1), F.lit(3), F.lit("z")).alias("edit"),
    ).first()
    assert tuple(r["bit"]) == (5, True) and r["chars"] == 2 and tuple(r["edit"]) == (1, 2, "z")


def test_versions(spark):
    raw = lambda *ids_: F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(s).alias("seq")) for a, s in ids_])
    v = F.array(F.lit(3), F.lit(7))
    r = spark.range(1).select(
        model.inserted(v, F.lit(5)), model.inserted(v, F.lit(7)), model.replaced(v, F.lit(7), F.lit(1)),
        model.same_version(raw(("a", 1), ("b", 2)), raw(("b", 2), ("a", 1))), model.advance_by_run(raw(("a", 1), ("b", 2)), raw(("a", 1)), raw(("c", 0))[0]),
    ).first()
    assert list(r[:4]) == [[3, 5, 7], [3, 7], [1, 3], True] and [tuple(x) for x in r[4]] == [("b", 2), ("c", 0)]


def test_sampled_version(spark):
    agents = spark.createDataFrame([(1, 0, 16, "a", 0), (2, 0, 1, "b", 4)], "doc long, lv_start long, lv_end long, agent string, seq_start long")
    tips = spark.createDataFrame([(1, 15), (2, 0)], "doc long, lv long")
    found = {(r.doc, r.lv, r.agent, r.seq) for r in ids.sampled_version(tips, agents, 5).collect()}
    assert found == {(1, lv, "a", lv) for lv in (15, 14, 12, 8)} | {(2, 0, "b", 4)}


def test_descending(spark):
    rows = spark.createDataFrame([(1, 9, 10, 0), (1, 7, 9, 1), (1, 4, 5, 2), (1, 5, 6, 3), (1, 3, 5, 4)], "doc long, start long, end long, at long")
    found = sorted((r.start, r.end, r.pieces) for r in runs.coalesce_descending(rows, ["doc"], "at").collect())
    assert found == [(3, 6, 2), (4, 5, 1), (7, 10, 2)]


WRITE = "doc long, crdt long, key string, agent string, seq long, kind string, value string, replaces array<struct<agent:string,seq:long>>"


def test_snapshot(spark):
    first = [(1, -1, "k", "a", 0, "set", "x", []), (1, -1, "k", "b", 0, "set", "y", [])]
    ours = [*first, (1, -1, "k", "a", 1, "set", "z", [("a", 0)]), (2, -1, "k", "c", 0, "delete", None, [])]
    df = lambda rows: spark.createDataFrame(rows, WRITE)
    heads = lambda s: sorted((r.doc, r.agent, r.seq, r.value) for r in s["heads"].collect())
    state = documents.from_lines(documents.to_lines(documents.snapshot(df(first))))
    assert heads(state) == [(1, "a", 0, "x"), (1, "b", 0, "y")]
    merged = documents.merged_snapshot(state, df(ours))
    assert heads(merged) == [(1, "a", 1, "z"), (1, "b", 0, "y"), (2, "c", 0, None)]
    assert sorted(tuple(r) for r in merged["known"].select("doc", "agent", "start", "end").collect()) == [(1, "a", 0, 2), (1, "b", 0, 1), (2, "c", 0, 1)]
    # what the summary has stays gone, though no head names it
    assert heads(documents.merged_snapshot(merged, df(ours))) == heads(merged)
    assert heads(documents.merged_snapshot(documents.snapshot(df([])), df([]))) == []


def test_names_and_empty_documents(spark):
    named = spark.range(1).select(documents.crdt_name(F.lit(-1), F.lit("x"), F.lit(3)).alias("r"), documents.crdt_name(F.lit(5), F.lit("x"), F.lit(3)).alias("c")).first()
    assert (tuple(named.r), tuple(named.c)) == (("ROOT", 0), ("x", 3))
    entries = spark.createDataFrame([], "doc long, crdt long, key string, value string, child long")
    assert documents.checkout(entries, spark.createDataFrame([], "doc long, crdt long, kind string")).count() == 0
