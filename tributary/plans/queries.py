"""Queries over the driver's tables, one for each operator or a few of a kind, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checksums, scalars
from ..model import ROOT, spelled
from ..operators import documents, graph, ids, merge, registers, runs, sets, stats, sync, text, trees
from ..sources.cuts import written
from . import derived
from .derived import ASKED, EV, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


class Log:
    """The log derived from events: its tables, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.ops = derived.ops(spark, sf_dir)
        self.spans = derived.spans(self.ops)

    def cut(self) -> Log:
        """The same with its spans written, so that what is built from them begins there."""
        self.spans = written(self.spans, "spans")
        return self

    runs = property(lambda self: derived.runs(self.spans))
    agents = property(lambda self: derived.agents(self.spans))
    asked = property(lambda self: derived.questions(self.spans))
    sets = property(lambda self: derived.sets_of_ops(self.spans))

    @property
    def writes(self) -> DataFrame:
        """Each event sets its type's key, one in seven deletes it."""
        kind = F.when(F.col("event_id") % 7 == 0, "delete").otherwise("set")
        return self.ops.select("doc", F.lit(ROOT).cast("long").alias("crdt"), "key", "lv", "agent", "seq", kind.alias("kind"), F.col("value").alias("value"))


# --- runs -------------------------------------------------------------------------------------------------------------


@query("rle_coalesce", EV + ", i AS (SELECT *, lv - row_number() OVER (PARTITION BY doc, round ORDER BY lv) AS g FROM ops) SELECT doc, round, min(lv) AS start, max(lv) + 1 AS \"end\" FROM i GROUP BY doc, round, g")
def rle_coalesce(spark, sf_dir):
    return runs.coalesce_runs(Log(spark, sf_dir).spans.select("doc", "round", "start", "end"), ["doc", "round"])


@query("rle_explode", EV + " SELECT doc, s AS start, lv FROM spans JOIN ops USING (doc, round, agent)")
def rle_explode(spark, sf_dir):
    return runs.explode_runs(Log(spark, sf_dir).spans).select("doc", "start", "lv")


@query("rle_take_max", EV + " SELECT doc, x AS start, least(x + 2, e) AS \"end\" FROM (SELECT doc, e, unnest(range(s, e, 2)) AS x FROM spans)")
def rle_take_max(spark, sf_dir):
    return runs.take_max(Log(spark, sf_dir).spans.select("doc", "start", "end"), 2)


#: Runs of ten operations each, beside the log's own.
TENS = ", tens AS (SELECT doc, lv // 10 AS ten, min(lv) AS s2, max(lv) + 1 AS e2 FROM ops GROUP BY ALL)"


def tens(log: Log) -> DataFrame:
    return log.ops.groupBy("doc", F.floor(F.col("lv") / 10).cast("long").alias("ten")).agg(F.min("lv").alias("start"), (F.max("lv") + 1).alias("end"))


@query("rle_zip_join", EV + TENS + " SELECT doc, agent, ten, greatest(s, s2) AS start, least(e, e2) AS \"end\" FROM spans JOIN tens USING (doc) WHERE s < e2 AND s2 < e")
def rle_zip_join(spark, sf_dir):
    log = Log(spark, sf_dir)
    return runs.zip_runs(log.spans.select("doc", "agent", "start", "end"), tens(log), ["doc"])


@query("rle_intersect_join", EV + TENS + " SELECT doc, agent, ten, greatest(s, s2) AS start, least(e, e2) AS \"end\" FROM spans JOIN tens USING (doc) WHERE s < e2 AND s2 < e AND round % 2 = 0 AND ten % 3 = 0")
def rle_intersect_join(spark, sf_dir):
    log = Log(spark, sf_dir)
    return runs.intersect_runs(log.spans.filter("round % 2 = 0").select("doc", "agent", "start", "end"), tens(log).filter("ten % 3 = 0"), ["doc"])


@query("rle_gaps", EV + " SELECT doc, agent, p AS start, s AS \"end\" FROM (SELECT *, lag(e) OVER (PARTITION BY doc, agent ORDER BY s) AS p FROM spans) WHERE p < s")
def rle_gaps(spark, sf_dir):
    return runs.gaps(Log(spark, sf_dir).spans.select("doc", "agent", "start", "end"), ["doc", "agent"])


@query("rle_runs_and_gaps", EV + """, p AS (SELECT *, lag(e) OVER (PARTITION BY doc, agent ORDER BY s) AS p FROM spans)
SELECT doc, agent, s AS start, e AS "end", false AS is_gap FROM p UNION ALL SELECT doc, agent, p, s, true FROM p WHERE p < s""")
def rle_runs_and_gaps(spark, sf_dir):
    return runs.runs_and_gaps(Log(spark, sf_dir).spans.select("doc", "agent", "start", "end"), ["doc", "agent"])


@query("rle_descending", EV + """, i AS (SELECT *, lv - row_number() OVER (PARTITION BY doc, round ORDER BY lv) AS g FROM ops) SELECT doc, round, min(lv) AS start, max(lv) + 1 AS "end", CAST(ceil(count(*) / 3) AS BIGINT) AS pieces FROM i GROUP BY doc, round, g""")
def rle_descending(spark, sf_dir):
    """Pieces of three operations, the last first."""
    whole = runs.coalesce_runs(Log(spark, sf_dir).spans.select("doc", "round", "start", "end"), ["doc", "round"])
    pieces = runs.take_max(whole, 3).withColumn("at", -F.col("start"))
    return runs.coalesce_descending(pieces, ["doc", "round"], "at")


@query("rle_clip", EV + " SELECT doc, greatest(s, 100) AS start, least(e, 300) AS \"end\" FROM spans WHERE s < 300 AND e > 100")
def rle_clip(spark, sf_dir):
    return runs.clip(Log(spark, sf_dir).spans.select("doc", "start", "end"), F.lit(100).cast("long"), F.lit(300).cast("long"))


@query("point_in_run_lookup", EV + " SELECT o.doc, lv, s AS start, lv - s AS \"offset\" FROM ops o JOIN spans r ON r.doc = o.doc AND r.s <= lv AND lv < r.e")
def point_in_run_lookup(spark, sf_dir):
    log = Log(spark, sf_dir)
    return runs.lookup(log.ops.select("doc", "lv"), log.spans.select("doc", "start", "end"), ["doc"]).select("doc", "lv", "start", "offset")


@query("next_run", EV + " SELECT o.doc, o.agent, lv, (SELECT min(s) FROM spans r WHERE r.doc = o.doc AND r.agent = o.agent AND r.e > lv + 1) AS next_start FROM ops o")
def next_run(spark, sf_dir):
    log = Log(spark, sf_dir)
    at = log.ops.select("doc", "agent", (F.col("lv") + 1).alias("lv"))
    return runs.next_run(at, log.spans.select("doc", "agent", "start", "end"), ["doc", "agent"]).withColumn("lv", F.col("lv") - 1)


#: Every fifth run reaches two operations into the next.
LONGER = ", longer AS (SELECT doc, s, CASE WHEN s % 5 = 0 THEN e + 2 ELSE e END AS e FROM spans)"


@query("run_overlaps", EV + LONGER + " SELECT doc, s AS start, e AS \"end\" FROM longer x WHERE EXISTS (SELECT 1 FROM longer y WHERE y.doc = x.doc AND (y.s < x.s OR (y.s = x.s AND y.e < x.e)) AND y.e > x.s)")
def run_overlaps(spark, sf_dir):
    longer = Log(spark, sf_dir).spans.select("doc", "start", F.when(F.col("start") % 5 == 0, F.col("end") + 2).otherwise(F.col("end")).alias("end"))
    return runs.overlaps(longer, ["doc"])


# --- ids and summaries ------------------------------------------------------------------------------------------------


@query("agent_runs", EV + ", g AS (SELECT *, lv - seq AS d FROM ops) SELECT doc, agent, min(lv) AS lv_start, max(lv) + 1 AS lv_end, min(seq) AS seq_start FROM g GROUP BY doc, agent, d")
def agent_runs(spark, sf_dir):
    return ids.agent_runs(Log(spark, sf_dir).ops)


@query("agent_dictionary", EV + " SELECT doc, agent, row_number() OVER (PARTITION BY doc ORDER BY min(lv)) - 1 AS agent_id FROM ops GROUP BY doc, agent")
def agent_dictionary(spark, sf_dir):
    return ids.agent_dictionary(Log(spark, sf_dir).ops)


@query("lv_to_remote", EV + " SELECT doc, lv, agent, seq FROM ops")
def lv_to_remote(spark, sf_dir):
    log = Log(spark, sf_dir)
    return ids.to_remote(log.ops.select("doc", "lv"), log.agents)


@query("remote_to_lv_errors", EV + """, n AS (SELECT doc, agent, max(seq) + 1 AS n FROM ops GROUP BY ALL),
asked AS (SELECT doc, agent, seq FROM ops UNION ALL SELECT doc, agent, n FROM n UNION ALL SELECT doc, 'x' || agent, 0 FROM n)
SELECT a.doc, a.agent, a.seq, o.lv, CASE WHEN o.lv IS NOT NULL THEN NULL WHEN n.n IS NULL THEN 'unknown_agent' ELSE 'seq_in_future' END AS error
FROM asked a LEFT JOIN ops o USING (doc, agent, seq) LEFT JOIN n USING (doc, agent)""")
def remote_to_lv_errors(spark, sf_dir):
    log = Log(spark, sf_dir)
    n = ids.next_seq(log.agents)
    asked = log.ops.select("doc", "agent", "seq").union(n).union(n.select("doc", F.concat(F.lit("x"), "agent"), F.lit(0).cast("long")))
    return ids.to_local(asked, log.agents)


@query("remote_version", EV + ", t AS (SELECT * FROM spans WHERE round = (SELECT max(round) FROM spans x WHERE x.doc = spans.doc)) SELECT doc, string_agg(agent || ':' || (q0 + e - s - 1), ',' ORDER BY e) AS remote FROM t GROUP BY doc")
def remote_version(spark, sf_dir):
    log = Log(spark, sf_dir)
    named = ids.remote_version(graph.tip_versions(log.runs), log.agents)
    return named.select("doc", F.array_join(F.transform("remote", lambda x: F.concat(x["agent"], F.lit(":"), x["seq"].cast("string"))), ",").alias("remote"))


@query("next_seq", EV + " SELECT doc, agent, max(seq) + 1 AS next_seq FROM ops GROUP BY ALL")
def next_seq(spark, sf_dir):
    return ids.next_seq(Log(spark, sf_dir).agents)


@query("version_summary", EV + ", k AS (SELECT doc, agent, seq, seq - row_number() OVER (PARTITION BY doc, agent ORDER BY seq) AS g FROM ops WHERE round % 3 <> 1) SELECT doc, agent, min(seq) AS start, max(seq) + 1 AS \"end\" FROM k GROUP BY doc, agent, g")
def version_summary(spark, sf_dir):
    return ids.summary(derived.agents(Log(spark, sf_dir).spans.filter("round % 3 <> 1")))


#: What another peer says it knows: of each agent the first half, and from the last one on three more that don't exist here.
THEIRS = """, n AS (SELECT doc, agent, max(seq) + 1 AS n FROM ops GROUP BY ALL),
theirs AS (SELECT doc, agent, 0 AS s, (n + 1) // 2 AS e FROM n UNION ALL SELECT doc, agent, n - 1, n + 3 FROM n WHERE n >= 4),
asked AS (SELECT doc, agent, unnest(range(s, e)) AS seq FROM theirs), found AS (SELECT a.*, o.lv FROM asked a LEFT JOIN ops o USING (doc, agent, seq))"""


def theirs(log: Log) -> DataFrame:
    n = ids.next_seq(log.agents)
    return n.select("doc", "agent", F.lit(0).cast("long").alias("start"), F.expr("(next_seq + 1) div 2").alias("end")).union(n.filter("next_seq >= 4").select("doc", "agent", F.col("next_seq") - 1, F.col("next_seq") + 3))


@query("summary_intersect", EV + THEIRS + " SELECT doc, agent, seq, lv FROM found")
def summary_intersect(spark, sf_dir):
    log = Log(spark, sf_dir)
    cut = ids.intersect_summary(log.agents, theirs(log))
    return runs.explode_runs(cut, "seq").select("doc", "agent", "seq", (F.col("lv") + F.col("seq") - F.col("start")).alias("lv"))


@query("summary_remainder", EV + THEIRS + ", r AS (SELECT *, seq - row_number() OVER (PARTITION BY doc, agent ORDER BY seq) AS g FROM found WHERE lv IS NULL) SELECT doc, agent, min(seq) AS start, max(seq) + 1 AS \"end\" FROM r GROUP BY doc, agent, g")
def summary_remainder(spark, sf_dir):
    log = Log(spark, sf_dir)
    return ids.intersect_summary(log.agents, theirs(log)).filter("lv IS NULL").select("doc", "agent", "start", "end")


# --- histories --------------------------------------------------------------------------------------------------------


@query("sampled_version", EV + """, t AS (SELECT doc, lv FROM ops o WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc = o.doc AND e.parent = o.lv)),
n AS (SELECT doc, max(e) AS n, 20 - (SELECT count(*) FROM t WHERE t.doc = spans.doc) AS more FROM spans GROUP BY doc),
f AS (SELECT *, greatest(1.1, pow(n, 1.0 / more)) AS f FROM n WHERE more > 0),
p AS (SELECT doc, lv FROM t UNION SELECT doc, n - CAST(floor(pow(f, k) + 1e-9) AS BIGINT) FROM f, range(500) r(k) WHERE pow(f, k) < n - 1e-6) SELECT doc, lv, agent, seq FROM p JOIN ops USING (doc, lv)""")
def sampled_version(spark, sf_dir):
    log = Log(spark, sf_dir)
    return ids.sampled_version(graph.tips(log.runs), log.agents, 20).select("doc", "lv", "agent", "seq")


@query("tips_frontier", EV + " SELECT doc, lv FROM ops o WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc = o.doc AND e.parent = o.lv)")
def tips_frontier(spark, sf_dir):
    return graph.tips(Log(spark, sf_dir).runs)


@query("parents_at_version", EV + " SELECT o.doc, o.lv, coalesce(string_agg(CAST(parent AS VARCHAR), ',' ORDER BY parent), '') AS parents FROM ops o LEFT JOIN edges e USING (doc, lv) GROUP BY ALL")
def parents_at_version(spark, sf_dir):
    log = Log(spark, sf_dir)
    return graph.parents_of(log.ops.select("doc", "lv"), log.runs).select("doc", "lv", spelled(F.col("parents")).alias("parents"))


@query("history_size", EV + ASKED + " SELECT doc, q, count(*) AS n FROM anc WHERE side = 'a' AND lv IS NOT NULL GROUP BY ALL")
def history_size(spark, sf_dir):
    log = Log(spark, sf_dir)
    spans = graph.closures(log.runs, log.asked.select("doc", "q", F.col("a").alias("version")))
    return spans.groupBy("doc", "q").agg(F.sum(F.col("end") - F.col("start")).alias("n"))


def _half(log: Log) -> DataFrame:
    """(doc, q, version): the version that the first half of the rounds leaves."""
    half = log.spans.join(log.spans.groupBy("doc").agg(F.expr("max(round) div 2").alias("most")), "doc").filter("round = most")
    return half.groupBy("doc").agg(F.array_sort(F.collect_list(F.col("end") - 1)).alias("version")).withColumn("q", F.lit(0).cast("long"))


def _sided(log: Log) -> DataFrame:
    return log.asked.filter("b[0] IS NOT NULL")


PAIRED = ASKED + """,
met AS (SELECT doc, q, lv, bool_or(side = 'a') AS in_a, bool_or(side = 'b') AS in_b FROM anc WHERE lv IS NOT NULL GROUP BY ALL),
good AS (SELECT doc, q FROM sides GROUP BY ALL HAVING count(lv) = 2)"""


@query("history_contains", EV + PAIRED + " SELECT doc, q, s.lv, coalesce(b.in_a, false) AS contained FROM sides s JOIN good USING (doc, q) LEFT JOIN met b USING (doc, q, lv) WHERE side = 'b'")
def history_contains(spark, sf_dir):
    log = Log(spark, sf_dir)
    return graph.contained(log.runs, _sided(log).select("doc", "q", F.col("a").alias("version"), F.col("b")[0].alias("lv")))


def _diff(flag: str, where: str):
    sql = EV + PAIRED + f" SELECT doc, q, lv FROM met JOIN good USING (doc, q) WHERE {where}"

    def found(spark, sf_dir):
        log = Log(spark, sf_dir)
        return runs.explode_runs(graph.differences(log.runs, _sided(log), (flag,))).select("doc", "q", "lv")

    return sql, found


for _name, _flag, _where in (("history_diff_only_a", "a", "in_a AND NOT in_b"), ("history_diff_only_b", "b", "in_b AND NOT in_a"), ("history_shared", "shared", "in_a AND in_b")):
    _sql, _found = _diff(_flag, _where)
    query(_name, _sql)(_found)


@query("version_cmp_pairs", EV + PAIRED + """, c AS (SELECT doc, q, bool_or(in_a AND NOT in_b) AS x, bool_or(in_b AND NOT in_a) AS y FROM met JOIN good USING (doc, q) GROUP BY ALL)
SELECT doc, q, CASE WHEN x AND y THEN 'concurrent' WHEN x THEN 'gt' WHEN y THEN 'lt' ELSE 'eq' END AS "order" FROM c""")
def version_cmp_pairs(spark, sf_dir):
    log = Log(spark, sf_dir)
    return graph.compared(log.runs, _sided(log))


SETS = """,
members AS (SELECT doc, round AS q, e - 1 AS lv FROM spans UNION ALL SELECT doc, round + 1, e - 1 FROM spans WHERE round < (SELECT max(round) FROM spans x WHERE x.doc = spans.doc)),
up AS (SELECT m.doc, m.q, e.parent AS lv FROM members m JOIN edges e USING (doc, lv) UNION SELECT u.doc, u.q, e.parent FROM up u JOIN edges e USING (doc, lv)),
dom AS (SELECT doc, q, lv FROM members m WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.doc = m.doc AND up.q = m.q AND up.lv = m.lv))"""


@query("dominators", EV + SETS + " SELECT doc, q, string_agg(CAST(lv AS VARCHAR), ',' ORDER BY lv) AS version FROM dom GROUP BY ALL")
def dominators(spark, sf_dir):
    log = Log(spark, sf_dir)
    return graph.dominators(log.runs, log.sets).select("doc", "q", spelled(F.col("version")).alias("version"))


@query("version_union", EV + PAIRED + """, s AS (SELECT DISTINCT doc, q, lv FROM sides JOIN good USING (doc, q)), up AS (SELECT s.doc, s.q, e.parent AS lv FROM s JOIN edges e USING (doc, lv) UNION SELECT u.doc, u.q, e.parent FROM up u JOIN edges e USING (doc, lv))
SELECT doc, q, string_agg(CAST(lv AS VARCHAR), ',' ORDER BY lv) AS version FROM s ANTI JOIN up USING (doc, q, lv) GROUP BY ALL""")
def version_union(spark, sf_dir):
    log = Log(spark, sf_dir)
    return graph.unions(log.runs, _sided(log)).select("doc", "q", spelled(F.col("version")).alias("version"))


def _kept(log: Log) -> DataFrame:
    """Per document, the runs of every second agent, by number, as the operations kept."""
    kept = log.spans.join(ids.agent_dictionary(log.ops), ["doc", "agent"]).filter("agent_id % 2 = 0")
    return kept.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("keep"))


KEPT = """, ids AS (SELECT doc, agent, row_number() OVER (PARTITION BY doc ORDER BY min(lv)) - 1 AS id FROM ops GROUP BY doc, agent), kept AS (SELECT doc, lv FROM ops JOIN ids USING (doc, agent) WHERE id % 2 = 0)"""


@query("project_onto_filter", EV + ASKED + KEPT + """, h AS (SELECT a.* FROM anc a SEMI JOIN kept USING (doc, lv) WHERE side = 'a'),
up AS (SELECT h.doc, h.q, e.parent AS lv FROM h JOIN edges e USING (doc, lv) UNION SELECT u.doc, u.q, e.parent FROM up u JOIN edges e USING (doc, lv)),
d AS (SELECT doc, q, lv FROM h ANTI JOIN up USING (doc, q, lv))
SELECT doc, q, coalesce(string_agg(CAST(d.lv AS VARCHAR), ',' ORDER BY d.lv), '') AS version FROM ends2 LEFT JOIN d USING (doc, q) GROUP BY ALL""")
def project_onto_filter(spark, sf_dir):
    log = Log(spark, sf_dir)
    asked = log.asked.join(runs.sorted_join(_kept(log)), "doc").select("doc", "q", F.col("a").alias("version"), "keep")
    return graph.projections(log.runs, asked).select("doc", "q", spelled(F.col("version")).alias("version"))


@query("subgraph_parents", EV + KEPT.replace("SELECT doc, lv FROM ops JOIN", "SELECT ops.* FROM ops JOIN") + """, k AS (SELECT r.* FROM spans r JOIN ids USING (doc, agent) WHERE id % 2 = 0),
near AS (SELECT k.doc, k.s, max(p.round) AS round FROM k LEFT JOIN k p ON p.doc = k.doc AND p.round < k.round GROUP BY ALL),
named AS (SELECT n.doc, n.s, coalesce(string_agg(CAST(p.e - 1 AS VARCHAR), ',' ORDER BY p.e), '') AS parents FROM near n LEFT JOIN k p ON p.doc = n.doc AND p.round = n.round GROUP BY ALL)
SELECT o.doc, o.lv, coalesce(named.parents, CAST(o.lv - 1 AS VARCHAR)) AS parents FROM kept o LEFT JOIN named ON named.doc = o.doc AND named.s = o.lv""")
def subgraph_parents(spark, sf_dir):
    log = Log(spark, sf_dir).cut()
    asked = graph.tip_versions(log.runs).join(runs.sorted_join(_kept(log)), "doc").select("doc", F.lit(0).cast("long").alias("q"), "version", "keep")
    kept = runs.explode_runs(graph.subgraphs(log.runs, asked))
    return kept.select("doc", "lv", F.when(F.col("lv") > F.col("start"), (F.col("lv") - 1).cast("string")).otherwise(spelled(F.col("parents"))).alias("parents"))


@query("graph_runs_simple", EV + " SELECT doc, s AS start, e AS \"end\" FROM spans")
def graph_runs_simple(spark, sf_dir):
    log = Log(spark, sf_dir)
    asked = graph.tip_versions(log.runs).withColumn("q", F.lit(0).cast("long"))
    return graph.simple_runs(log.runs, asked).select("doc", "start", "end")


@query("shadows", EV + ", w AS (SELECT doc, round, count(*) AS width, min(s) AS first FROM spans GROUP BY ALL) SELECT r.doc, r.s AS start, r.e AS \"end\", CASE WHEN r.round = 0 AND r.s > 0 THEN r.s WHEN r.s = w.first THEN 0 ELSE r.s END AS shadow FROM spans r JOIN w USING (doc, round)")
def shadows(spark, sf_dir):
    return graph.shadows(Log(spark, sf_dir).runs)


@query("merge_count", EV + ", p AS (SELECT doc, s, count(parent) AS k FROM spans r LEFT JOIN edges e ON e.doc = r.doc AND e.lv = r.s GROUP BY r.doc, s) SELECT doc, count(*) FILTER (k >= 2) AS merges FROM p GROUP BY doc".replace("SELECT doc, s, count", "SELECT r.doc, s, count"))
def merge_count(spark, sf_dir):
    return Log(spark, sf_dir).runs.groupBy("doc").agg(F.count_if(F.size("parents") >= 2).alias("merges"))


@query("conflict_spans", EV + PAIRED + """, x AS (SELECT b.*, o.round FROM met b JOIN good USING (doc, q) JOIN ops o USING (doc, lv)),
cut AS (SELECT doc, q, s.lv AS a, t.lv AS b, oa.round AS ra, ob.round AS rb, oa.agent = ob.agent AS same FROM sides s JOIN sides t USING (doc, q) JOIN good USING (doc, q) JOIN ops oa ON oa.doc = s.doc AND oa.lv = s.lv JOIN ops ob ON ob.doc = t.doc AND ob.lv = t.lv WHERE s.side = 'a' AND t.side = 'b')
SELECT doc, q, lv, CASE WHEN in_a AND in_b THEN 'shared' WHEN in_a THEN 'a' ELSE 'b' END AS flag FROM x JOIN cut USING (doc, q)
WHERE NOT (in_a AND in_b) OR (NOT same AND ra <> rb AND x.round = least(ra, rb) AND lv > (SELECT coalesce(max(y.e) - 1, -1) FROM spans y WHERE y.doc = x.doc AND y.round < x.round)
  AND (SELECT count(*) FROM spans z WHERE z.doc = x.doc AND z.round = x.round) > 1)""")
def conflict_spans(spark, sf_dir):
    log = Log(spark, sf_dir)
    return runs.explode_runs(graph.conflicts(log.runs, _sided(log)).filter("flag IS NOT NULL")).select("doc", "q", "lv", "flag")


@query("conflict_common_version", EV + PAIRED + """, x AS (SELECT b.*, o.round FROM met b JOIN good USING (doc, q) JOIN ops o USING (doc, lv)),
cut AS (SELECT doc, q, oa.round AS ra, ob.round AS rb, oa.agent = ob.agent AS same FROM sides s JOIN sides t USING (doc, q) JOIN good USING (doc, q) JOIN ops oa ON oa.doc = s.doc AND oa.lv = s.lv JOIN ops ob ON ob.doc = t.doc AND ob.lv = t.lv WHERE s.side = 'a' AND t.side = 'b'),
k AS (SELECT doc, q, lv FROM x JOIN cut USING (doc, q) WHERE in_a AND in_b AND NOT (NOT same AND ra <> rb AND x.round = least(ra, rb) AND (SELECT count(*) FROM spans z WHERE z.doc = x.doc AND z.round = x.round) > 1))
SELECT doc, q, coalesce((SELECT string_agg(CAST(k.lv AS VARCHAR), ',' ORDER BY k.lv) FROM k WHERE k.doc = g.doc AND k.q = g.q AND NOT EXISTS (SELECT 1 FROM k c JOIN edges e USING (doc, lv) WHERE c.doc = k.doc AND c.q = k.q AND e.parent = k.lv)), '') AS common FROM good g""")
def conflict_common_version(spark, sf_dir):
    log = Log(spark, sf_dir)
    return graph.conflicts(log.runs, _sided(log)).select("doc", "q", "common").distinct()


@query("conflict_graph", EV + PAIRED + """, x AS (SELECT b.*, o.round FROM met b JOIN good USING (doc, q) JOIN ops o USING (doc, lv)),
cut AS (SELECT doc, q, oa.round AS ra, ob.round AS rb, oa.agent = ob.agent AS same FROM sides s JOIN sides t USING (doc, q) JOIN good USING (doc, q) JOIN ops oa ON oa.doc = s.doc AND oa.lv = s.lv JOIN ops ob ON ob.doc = t.doc AND ob.lv = t.lv WHERE s.side = 'a' AND t.side = 'b'),
zone AS (SELECT doc, q, lv, CASE WHEN in_a AND in_b THEN 'shared' WHEN in_a THEN 'a' ELSE 'b' END AS flag FROM x JOIN cut USING (doc, q)
WHERE NOT (in_a AND in_b) OR (NOT same AND ra <> rb AND x.round = least(ra, rb) AND (SELECT count(*) FROM spans z WHERE z.doc = x.doc AND z.round = x.round) > 1))
SELECT z.doc, z.q, z.lv, z.flag, coalesce(string_agg(CAST(y.lv AS VARCHAR), ',' ORDER BY y.lv), '') AS parents FROM zone z LEFT JOIN edges e ON e.doc = z.doc AND e.lv = z.lv LEFT JOIN zone y ON y.doc = z.doc AND y.q = z.q AND y.lv = e.parent GROUP BY ALL""")
def conflict_graph(spark, sf_dir):
    log = Log(spark, sf_dir)
    each = runs.explode_runs(graph.conflict_graphs(log.runs, _sided(log)))
    parents = F.when(F.col("lv") == F.col("start"), F.col("parents")).otherwise(F.array(F.col("lv") - 1))
    return each.select("doc", "q", "lv", "flag", spelled(parents).alias("parents"))


@query("merge_plan", EV + """, w AS (SELECT doc, round, count(*) AS width, sum(e - s) AS n, arg_max(e - s, s) AS last FROM spans GROUP BY ALL)
SELECT doc, count(*) FILTER (width > 1) AS clears, CAST(coalesce(sum(n) FILTER (width = 1), 0) AS BIGINT) AS forwarded, CAST(coalesce(sum(n) FILTER (width > 1), 0) AS BIGINT) AS applied, 0 AS replayed, CAST(coalesce(sum(n - last) FILTER (width > 1), 0) AS BIGINT) AS moved FROM w GROUP BY doc""")
def merge_plan(spark, sf_dir):
    """What it takes to merge each whole log: rounds of one run are forwarded, in others each run but the last is retreated from."""
    log = Log(spark, sf_dir)
    asked = graph.tip_versions(log.runs).select("doc", F.lit(0).cast("long").alias("q"), F.array().cast("array<bigint>").alias("a"), F.col("version").alias("b"))
    return graph.plan_costs(graph.merge_plans(log.runs, asked)).drop("q")


@query("version_moves", EV + """, v AS (SELECT doc, round AS q, string_agg(CAST(e - 1 AS VARCHAR), ',' ORDER BY e) AS version FROM spans GROUP BY ALL)
SELECT n.doc, n.q, o.version AS retreated, n.version AS advanced FROM v n JOIN v o ON o.doc = n.doc AND o.q = n.q - 1""")
def version_moves(spark, sf_dir):
    """From the end of each round back to that of the one before, and forth again."""
    log = Log(spark, sf_dir).cut()
    by_round = log.spans.groupBy("doc", F.col("round").alias("q")).agg(F.array_sort(F.collect_list(F.col("end") - 1)).alias("version"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    back = written(graph.retreated(log.runs, by_round.filter("q > 0")), "back")
    forth = graph.advanced(log.runs, back.join(by_round.select("doc", "q", "spans"), ["doc", "q"]))
    return back.withColumnRenamed("version", "r").join(forth, ["doc", "q"]).select("doc", "q", spelled(F.col("r")).alias("retreated"), spelled(F.col("version")).alias("advanced"))


@query("dominators_labelled", EV + SETS + " SELECT DISTINCT m.doc, m.q, m.lv, d.lv IS NOT NULL AS dominates FROM members m LEFT JOIN dom d USING (doc, q, lv)")
def dominators_labelled(spark, sf_dir):
    log = Log(spark, sf_dir)
    return graph.labelled_dominators(log.runs, log.sets)


@query("shadow_of", EV + ", w AS (SELECT doc, round, count(*) AS width, min(s) AS first FROM spans GROUP BY ALL) SELECT o.doc, o.lv, CASE WHEN r.round = 0 AND r.s > 0 THEN r.s WHEN r.s = w.first THEN 0 ELSE r.s END AS shadow FROM ops o JOIN spans r USING (doc, round, agent) JOIN w USING (doc, round)")
def shadow_of(spark, sf_dir):
    log = Log(spark, sf_dir)
    return graph.shadow_of(log.ops.select("doc", "lv"), log.runs).select("doc", "lv", "shadow")


@query("summary_common_version", EV + THEIRS + """, known AS (SELECT DISTINCT doc, lv FROM found WHERE lv IS NOT NULL),
up AS (SELECT k.doc, e.parent AS lv FROM known k JOIN edges e USING (doc, lv) UNION SELECT u.doc, e.parent FROM up u JOIN edges e USING (doc, lv))
SELECT doc, string_agg(CAST(lv AS VARCHAR), ',' ORDER BY lv) AS version FROM known ANTI JOIN up USING (doc, lv) GROUP BY doc""")
def summary_common_version(spark, sf_dir):
    log = Log(spark, sf_dir)
    return graph.common_versions(log.runs, log.agents, theirs(log)).select("doc", spelled(F.col("version")).alias("version"))


@query("exists_at_version", EV + """, cut AS (SELECT doc, max(round) // 2 AS most FROM ops GROUP BY doc), made AS (SELECT doc, key || agent AS name, min(lv) AS lv FROM ops GROUP BY ALL),
gone AS (SELECT doc, key || agent AS name, max(lv) AS lv FROM ops WHERE event_id % 7 = 0 GROUP BY ALL), seen AS (SELECT doc, lv FROM ops JOIN cut USING (doc) WHERE round <= most)
SELECT doc, name, lv FROM made SEMI JOIN seen USING (doc, lv) ANTI JOIN (SELECT doc, name FROM gone SEMI JOIN seen USING (doc, lv)) USING (doc, name)""")
def exists_at_version(spark, sf_dir):
    """Things, here each agent's keys, that were created and not deleted in the history of half of the rounds."""
    log = Log(spark, sf_dir)
    named = log.ops.withColumn("name", F.concat("key", "agent"))
    created = named.groupBy("doc", "name").agg(F.min("lv").alias("lv"))
    gone = named.filter("event_id % 7 = 0").groupBy("doc", "name").agg(F.max("lv").alias("lv"))
    return graph.exists_at(created, gone, graph.closures(log.runs, _half(log)))


#: An operation is open from itself to its first child.
OPEN = """, child AS (SELECT doc, parent AS lv, min(lv) AS child FROM edges WHERE parent IS NOT NULL GROUP BY ALL), n AS (SELECT doc, count(*) AS n FROM ops GROUP BY doc)
SELECT doc, CAST(sum(coalesce(child, n) - o.lv - 1) AS BIGINT) AS total, count(*) AS ops FROM ops o JOIN n USING (doc) LEFT JOIN child USING (doc, lv) GROUP BY doc"""


@query("concurrency_estimate", EV + OPEN)
def concurrency_estimate(spark, sf_dir):
    log = Log(spark, sf_dir)
    return graph.concurrency(log.runs, graph.tip_versions(log.runs).withColumn("q", F.lit(0).cast("long"))).select("doc", "total", "ops")


@query("concurrency_of_logs", EV + OPEN)
def concurrency_of_logs(spark, sf_dir):
    return graph.concurrency_of_logs(Log(spark, sf_dir).runs)


@query("history_dot")
def history_dot(spark, sf_dir):
    return graph.dots(Log(spark, sf_dir).runs)


#: Two neighbouring users under one name: its spans, and which of a round's each is.
NAMED = EV + """, named AS (SELECT doc, round, 'w' || (CAST(substr(agent, 2) AS BIGINT) // 2) AS agent, s, e FROM spans),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc, round, agent ORDER BY s) - 1 AS slot FROM named)"""


@query("chain_cover", NAMED + " SELECT doc, agent, s AS start, e AS \"end\", slot FROM placed")
def chain_cover(spark, sf_dir):
    log = Log(spark, sf_dir).cut()
    named, _ = derived.shared_names(log.ops)
    return graph.chain_covers(log.runs, ids.agent_runs(named))


# --- registers, maps, sets, trees -------------------------------------------------------------------------------------

HEADS = """, writes AS (SELECT doc, key, lv, agent, seq, round, CASE WHEN event_id % 7 = 0 THEN 'delete' ELSE 'set' END AS kind, value FROM ops),
top AS (SELECT doc, key, max(round) AS round FROM writes GROUP BY ALL),
heads AS (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY doc, key, agent ORDER BY lv DESC) AS r FROM writes w JOIN top USING (doc, key, round)) WHERE r = 1)"""
WON = ", won AS (SELECT doc, key, arg_max(lv, (agent, seq)) AS lv, count(*) - 1 AS n_conflicts FROM heads GROUP BY ALL)"


@query("register_heads", EV + HEADS + " SELECT doc, key, lv, agent, seq, value FROM heads")
def register_heads(spark, sf_dir):
    log = Log(spark, sf_dir)
    return registers.heads(log.writes, log.runs).select("doc", "key", "lv", "agent", "seq", "value")


@query("register_winner", EV + HEADS + WON + " SELECT doc, key, lv, agent, value, n_conflicts FROM won JOIN heads USING (doc, key, lv)")
def register_winner(spark, sf_dir):
    log = Log(spark, sf_dir)
    return registers.resolved(registers.heads(log.writes, log.runs)).select("doc", "key", "lv", "agent", "value", "n_conflicts")


@query("register_winner_js", EV + HEADS + ", won AS (SELECT doc, key, arg_max(lv, (agent, -seq)) AS lv FROM heads GROUP BY ALL) SELECT doc, key, lv, agent, value FROM won JOIN heads USING (doc, key, lv)")
def register_winner_js(spark, sf_dir):
    log = Log(spark, sf_dir)
    return registers.resolved(registers.heads(log.writes, log.runs), js=True).select("doc", "key", "lv", "agent", "value")


@query("register_conflicts", EV + HEADS + WON + " SELECT h.doc, h.key, h.lv, w.lv AS winner_lv FROM heads h JOIN won w ON w.doc = h.doc AND w.key = h.key WHERE h.lv <> w.lv")
def register_conflicts(spark, sf_dir):
    log = Log(spark, sf_dir)
    return registers.conflicting(registers.heads(log.writes, log.runs)).select("doc", "key", "lv", "winner_lv")


#: Each write replaces its agent's last write of the key.
REPLACES = ", w AS (SELECT *, lag(lv) OVER (PARTITION BY doc, key, agent ORDER BY lv) AS p FROM ops), left_ AS (SELECT * FROM w x WHERE NOT EXISTS (SELECT 1 FROM w y WHERE y.doc = x.doc AND y.key = x.key AND y.p = x.lv))"


@query("register_heads_by_parents", EV + REPLACES + " SELECT doc, key, agent, lv, value FROM left_")
def register_heads_by_parents(spark, sf_dir):
    before = F.lag("lv").over(Window.partitionBy("doc", "key", "agent").orderBy("lv"))
    writes = Log(spark, sf_dir).writes.withColumn("replaces", F.array_compact(F.array(before)))
    return registers.heads_by_parents(writes).select("doc", "key", "agent", "lv", "value")


@query("snapshot_merge", EV + REPLACES + """ SELECT doc, key, agent, value, false AS known_twice FROM left_""")
def snapshot_merge(spark, sf_dir):
    """A snapshot of the first half of the rounds, written as lines and read again, with all our writes merged into it, twice."""
    before = F.lag("seq").over(Window.partitionBy("doc", "key", "agent").orderBy("lv"))
    named = F.when(before.isNotNull(), F.array(F.struct("agent", before.alias("seq")))).otherwise(F.array().cast("array<struct<agent:string,seq:bigint>>"))
    log = Log(spark, sf_dir)
    rounds = log.ops.select("doc", "lv", "round")
    writes = log.writes.withColumn("replaces", named).withColumn("value", F.col("value").cast("string")).join(rounds, ["doc", "lv"]).withColumn("half", F.expr("max(round) OVER (PARTITION BY doc) div 2"))
    state = documents.from_lines(documents.to_lines(documents.snapshot(writes.filter("round <= half"))))
    merged = documents.merged_snapshot(documents.merged_snapshot(state, writes), writes)
    twice = merged["heads"].groupBy("doc", "crdt", "key", "agent", "seq", "value").count()
    return twice.select("doc", "key", "agent", F.col("value").cast("double").alias("value"), (F.col("count") > 1).alias("known_twice"))


@query("map_delete", EV + HEADS + WON + " SELECT doc, key, value FROM won JOIN heads USING (doc, key, lv) WHERE kind <> 'delete'")
def map_delete(spark, sf_dir):
    log = Log(spark, sf_dir)
    return registers.present(registers.resolved(registers.heads(log.writes, log.runs))).select("doc", "key", "value")


@query("map_checkout_at_version", EV + ", cut AS (SELECT doc, max(round) // 2 AS most FROM ops GROUP BY doc)" + HEADS.replace("FROM ops)", "FROM ops JOIN cut USING (doc) WHERE round <= most)", 1) + WON + " SELECT doc, key, lv, value FROM won JOIN heads USING (doc, key, lv)")
def map_checkout_at_version(spark, sf_dir):
    log = Log(spark, sf_dir)
    then = registers.written_within(log.writes, graph.closures(log.runs, _half(log)))
    return registers.resolved(registers.heads(then, log.runs)).select("doc", "key", "lv", "value")


@query("orset_live", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_returnflag = 'R') = 0")
def orset_live(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    by = ["l_orderkey", "l_linenumber"]
    return sets.live(items.drop("l_returnflag"), items.filter("l_returnflag = 'R'"), by)


@query("orset_sizes", "SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_returnflag = 'R') = 0) GROUP BY ALL")
def orset_sizes(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return sets.sizes(items, items.filter("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"], ["l_orderkey"])


def _tree(spark, sf_dir) -> DataFrame:
    """A document of maps: regions of nations of customers. Map ids: regions from 0, nations from 1,000."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("double")
    regions = t("region").select(F.lit(ROOT).cast("long").alias("crdt"), F.col("r_name").alias("key"), none.alias("value"), F.col("r_regionkey").cast("long").alias("child"))
    nations = t("nation").select(F.col("n_regionkey").cast("long"), "n_name", none, F.col("n_nationkey").cast("long") + 1000)
    customers = t("customer").select(F.col("c_nationkey").cast("long") + 1000, "c_name", "c_acctbal", F.lit(None).cast("long"))
    return regions.union(nations).union(customers).select(F.lit(0).cast("long").alias("doc"), "*")


PATHS = """WITH p AS (SELECT r_name AS path, CAST(NULL AS DOUBLE) AS value, true AS is_map FROM region UNION ALL
SELECT r_name || '/' || n_name, NULL, true FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL
SELECT r_name || '/' || n_name || '/' || c_name, c_acctbal, false FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey)"""


@query("nested_tree_paths", PATHS + " SELECT path, value, is_map FROM p")
def nested_tree_paths(spark, sf_dir):
    return trees.checkout(_tree(spark, sf_dir)).select(F.array_join("path", "/").alias("path"), "value", "is_map")


@query("tree_at_path", "SELECT n_nationkey + 1000 AS child FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND n_name = 'CHINA'")
def tree_at_path(spark, sf_dir):
    return trees.at_path(_tree(spark, sf_dir), ["ASIA", "CHINA"]).select("child")


@query("deleted_subtree", "SELECT r_regionkey AS crdt FROM region WHERE r_regionkey < 2 UNION ALL SELECT n_nationkey + 1000 FROM nation WHERE n_regionkey < 2")
def deleted_subtree(spark, sf_dir):
    entries = _tree(spark, sf_dir)
    replaced = entries.filter(f"crdt = {ROOT} AND child < 2").select("doc", F.col("child").alias("crdt"))
    return trees.deleted(entries.filter("child IS NOT NULL"), replaced).select("crdt")


# --- sync -------------------------------------------------------------------------------------------------------------


@query("ops_since", EV + ASKED.replace("FROM ends2 UNION ALL", "FROM ends2 WHERE q = (SELECT max(y.q) // 2 FROM ends2 y WHERE y.doc = ends2.doc) UNION ALL").replace("END - 1 FROM ends2)", "END - 1 FROM ends2 WHERE false)") + " SELECT doc, lv, agent, seq, key, value FROM ops ANTI JOIN anc USING (doc, lv)")
def ops_since(spark, sf_dir):
    log = Log(spark, sf_dir)
    half = Window.partitionBy("doc")
    known = log.asked.withColumn("most", F.max("q").over(half)).filter("q = most div 2").join(graph.tip_versions(log.runs), "doc").select("doc", "q", "a", F.col("version").alias("b"))
    return sync.ops_since(log.ops.select("doc", "lv", "key", "value"), log.runs, log.agents, known).select("doc", "lv", "agent", "seq", "key", "value")


def _peers(log: Log) -> tuple[DataFrame, DataFrame]:
    """Two peers' logs: rounds not divisible by 4 for us, rounds from 2 on for them, each numbered by itself."""
    part = lambda df: df.withColumn("lv", (F.row_number().over(Window.partitionBy("doc").orderBy("lv")) - 1).cast("long"))
    cols = ["doc", "agent", "seq", "lv", "order"]
    base = log.ops.withColumn("order", F.col("lv"))
    return part(base.filter("round % 4 <> 0")).select(cols), part(base.filter("round >= 2")).select(cols)


@query("missing_ops_antijoin", EV + " SELECT doc, agent, seq FROM ops WHERE round >= 2 AND round % 4 = 0")
def missing_ops_antijoin(spark, sf_dir):
    ours, them = _peers(Log(spark, sf_dir))
    return sync.missing(ours, them).select("doc", "agent", "seq")


@query("merge_idempotent", EV + """, ours AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY lv) - 1 AS n FROM ops WHERE round % 4 <> 0),
fresh AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY lv, agent, seq) - 1 AS k FROM ops WHERE round >= 2 AND round % 4 = 0), m AS (SELECT doc, max(n) + 1 AS m FROM ours GROUP BY doc)
SELECT doc, agent, seq, n AS lv FROM ours UNION ALL SELECT doc, agent, seq, coalesce(m, 0) + k FROM fresh LEFT JOIN m USING (doc)""")
def merge_idempotent(spark, sf_dir):
    ours, them = _peers(Log(spark, sf_dir))
    once = sync.ingest(ours, them)
    return sync.ingest(once, them).select("doc", "agent", "seq", "lv")


@query("trim_straddling", EV + THEIRS + ", r AS (SELECT DISTINCT doc, agent, seq FROM found WHERE lv IS NULL OR lv % 3 = 0), i AS (SELECT *, seq - row_number() OVER (PARTITION BY doc, agent ORDER BY seq) AS g FROM r) SELECT doc, agent, seq FROM i")
def trim_straddling(spark, sf_dir):
    log = Log(spark, sf_dir)
    known = runs.coalesce_runs(log.ops.filter("lv % 3 <> 0").select("doc", "agent", F.col("seq").alias("start"), (F.col("seq") + 1).alias("end")), ["doc", "agent"])
    return runs.explode_runs(sync.trim_known(theirs(log), known), "seq").select("doc", "agent", "seq").distinct()


#: The peers' logs: o numbers ours (even users), t theirs (odd users, in another order); remote names an operation.
PEERS = EV + """, half AS (SELECT doc, max(round) // 2 AS half FROM ops GROUP BY doc),
held AS (SELECT ops.*, half, agent || ':' || seq AS remote, CAST(substr(agent, 2) AS BIGINT) % 2 AS odd FROM ops JOIN half USING (doc) WHERE round <= half + 1),
o AS (SELECT doc, agent, seq, row_number() OVER (PARTITION BY doc ORDER BY round, agent, lv) - 1 AS lv FROM held WHERE round <= half OR odd = 0),
t AS (SELECT doc, agent, seq, round, half, row_number() OVER (PARTITION BY doc ORDER BY round, agent DESC, lv) - 1 AS lv FROM held WHERE round <= half OR odd = 1),
n AS (SELECT doc, count(*) AS n FROM o GROUP BY doc),
both_ AS (SELECT doc, agent, seq, lv FROM o UNION ALL SELECT doc, agent, seq, n + row_number() OVER (PARTITION BY doc ORDER BY t.lv) - 1 FROM t JOIN n USING (doc) WHERE round > half),
named AS (SELECT h.doc, h.agent, h.seq, coalesce(string_agg(p.remote, ',' ORDER BY p.remote), '') AS parents FROM held h LEFT JOIN edges e ON e.doc = h.doc AND e.lv = h.lv LEFT JOIN held p ON p.doc = h.doc AND p.lv = e.parent GROUP BY ALL)"""


def _named_parents(log: dict) -> DataFrame:
    """(doc, lv, agent, seq, parents): each operation with its parents' names, in order of these."""
    each = runs.explode_runs(log["runs"]).select("doc", "lv")
    at = graph.parents_of(each, log["runs"]).select("doc", F.col("lv").alias("of"), F.explode("parents").alias("lv"))
    name = F.concat("agent", F.lit(":"), F.col("seq").cast("string"))
    parents = ids.to_remote(at, log["agents"]).groupBy("doc", F.col("of").alias("lv")).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("parents"))
    return ids.to_remote(each, log["agents"]).join(runs.sorted_join(parents), ["doc", "lv"], "left").withColumn("parents", F.coalesce("parents", F.lit("")))


def _two_peers(log: Log) -> tuple[dict, dict]:
    kept = lambda peer: {name: written(peer[name], name) for name in ("runs", "agents", "text")}
    return kept(derived.peer(log.ops, 0, F.asc("agent"))), kept(derived.peer(log.ops, 1, F.desc("agent")))


@query("merge_logs", PEERS + " SELECT doc, agent, seq, lv, parents FROM both_ JOIN named USING (doc, agent, seq)")
def merge_logs(spark, sf_dir):
    """Two peers' logs as one: our numbers, then theirs that are new, with the parents mapped."""
    ours, them = _two_peers(Log(spark, sf_dir))
    met = merge.merged_logs(ours, them)
    return _named_parents({name: written(met[name], name) for name in ("runs", "agents")}).select("doc", "agent", "seq", "lv", "parents")


@query("delta_changes", PEERS + " SELECT t.doc, t.agent, t.seq, parents, substr(h.key, 1, 1) AS content, t.seq AS pos FROM t JOIN named USING (doc, agent, seq) JOIN held h USING (doc, agent, seq) WHERE t.round > t.half")
def delta_changes(spark, sf_dir):
    """What theirs has and ours lacks, as JSON lines and back: each operation with its parents and its edit."""
    ours, them = _two_peers(Log(spark, sf_dir))
    sent = merge.from_lines(written(merge.to_lines(merge.changes_since(them, ids.summary(ours["agents"]))), "delta"))
    each = sent["graph"].withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    own = F.array(F.struct(F.col("agent").alias("agent"), (F.col("seq") + F.col("k") - 1).alias("seq")))
    named = F.transform(F.when(F.col("k") == 0, F.col("parents")).otherwise(own), lambda p: F.concat(p["agent"], F.lit(":"), p["seq"].cast("string")))
    ops = each.select("doc", "agent", (F.col("seq") + F.col("k")).alias("seq"), F.array_join(F.array_sort(named), ",").alias("parents"))
    return ops.join(runs.sorted_join(sent["text"].select("doc", "agent", "seq", "content", "pos")), ["doc", "agent", "seq"])


@query("delta_round_trip", PEERS + " SELECT doc, count(*) AS ops, 0 AS only_ours, 0 AS only_theirs, 0 AS waiting FROM held GROUP BY doc")
def delta_round_trip(spark, sf_dir):
    """Both peers send each other what they lack, twice: how many operations ours then has, and how many (names, parents and edits) only one has."""
    ours, them = _two_peers(Log(spark, sf_dir))
    kept = lambda x: {name: written(df, name) for name, df in x.items()}
    to_us, to_them = merge.changes_since(them, ids.summary(ours["agents"])), merge.changes_since(ours, ids.summary(them["agents"]))
    to_us, to_them = kept(to_us), kept(to_them)
    a = kept(merge.with_changes(kept(merge.with_changes(ours, to_us)), to_us))
    b = kept(merge.with_changes(them, to_them))
    edits = lambda x: _named_parents(x).join(runs.sorted_join(x["text"]), ["doc", "lv"]).select("doc", "agent", "seq", "parents", "kind", "pos", "content")
    met = edits(a).withColumn("side", F.lit(1)).union(edits(b).withColumn("side", F.lit(2))).groupBy("doc", "agent", "seq", "parents", "kind", "pos", "content").agg(F.sum("side").alias("sides"))
    waiting = merge.unknown_parents(ours, to_us).groupBy("doc").agg(F.count(F.lit(1)).alias("waiting"))
    found = met.groupBy("doc").agg(F.count_if(F.col("sides").isin(1, 3)).alias("ops"), F.count_if(F.col("sides") == 1).alias("only_ours"), F.count_if(F.col("sides") == 2).alias("only_theirs"))
    return found.join(waiting, "doc", "left").select("doc", "ops", "only_ours", "only_theirs", F.coalesce("waiting", F.lit(0)).alias("waiting"))


@query("graph_push", EV + ", half AS (SELECT doc, max(e) // 2 AS h FROM spans GROUP BY doc) SELECT doc, s AS start, e AS \"end\" FROM spans")
def graph_push(spark, sf_dir):
    """Runs pushed in pieces of three operations come together again where they only go on."""
    log = Log(spark, sf_dir)
    pieces = runs.take_max(log.runs.withColumn("run", F.col("start")), 3)
    parents = F.when(F.col("start") == F.col("run"), F.col("parents")).otherwise(F.array(F.col("start") - 1))
    packed = merge.pack_runs(pieces.select("doc", "start", "end", parents.alias("parents")))
    # a run whose only parent is the operation before it is one with that run: cut there again
    again = runs.zip_runs(packed.select("doc", "start", "end"), log.spans.select("doc", "start", "end", "round"), ["doc"])
    return again.select("doc", "start", "end")


# --- statistics -------------------------------------------------------------------------------------------------------


@query("log_stats", EV + """, p AS (SELECT r.doc, r.s, count(parent) AS k FROM spans r LEFT JOIN edges e ON e.doc = r.doc AND e.lv = r.s GROUP BY r.doc, r.s)
SELECT doc, (SELECT count(*) FROM ops o WHERE o.doc = p.doc) AS n_ops, count(*) AS n_runs, count(*) FILTER (k >= 2) AS n_merges, count(*) FILTER (k = 0) AS n_roots,
(SELECT count(DISTINCT agent) FROM ops o WHERE o.doc = p.doc) AS n_agents, count(*) AS n_agent_runs FROM p GROUP BY doc""")
def log_stats(spark, sf_dir):
    log = Log(spark, sf_dir)
    return stats.log_stats(log.runs, log.agents)


@query("trace_roots", EV + " SELECT doc, count(*) AS n_roots FROM spans WHERE round = 0 GROUP BY doc HAVING count(*) > 1")
def trace_roots(spark, sf_dir):
    return stats.many_rooted(Log(spark, sf_dir).runs)


@query("agent_order_violations", NAMED + " SELECT doc, agent, s AS lv FROM placed WHERE slot > 0")
def agent_order_violations(spark, sf_dir):
    log = Log(spark, sf_dir)
    _, spans = derived.shared_names(log.ops)
    return stats.order_violations(log.runs, derived.agents(spans))


@query("unsound_runs", EV + """, p AS (SELECT r.doc, r.s, count(parent) AS k FROM spans r LEFT JOIN edges e ON e.doc = r.doc AND e.lv = r.s GROUP BY ALL)
SELECT doc, s AS start FROM p WHERE s % 7 = 0 OR (s % 7 = 1 AND k >= 2) OR s % 7 = 2""")
def unsound_runs(spark, sf_dir):
    """With faults planted by the start's remainder by 7: a run that is its own parent, parents in the wrong order, an empty run."""
    at = lambda k: F.col("start") % 7 == k
    parents = F.when(at(0), F.array_append("parents", F.col("start"))).when(at(1), F.reverse(F.array_sort("parents"))).otherwise(F.col("parents"))
    planted = Log(spark, sf_dir).runs.select("doc", "start", F.when(at(2), F.col("start")).otherwise(F.col("end")).alias("end"), parents.alias("parents"))
    return graph.unsound(planted).select("doc", "start")


@query("asof_timestamp", EV + ", k AS (SELECT *, CASE WHEN lv % 5 = 0 THEN ts END AS t FROM ops) SELECT doc, agent, seq, epoch_us(last_value(t IGNORE NULLS) OVER (PARTITION BY doc, agent ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS us FROM k")
def asof_timestamp(spark, sf_dir):
    log = Log(spark, sf_dir)
    times = log.ops.filter("lv % 5 = 0").select("doc", "agent", "seq", F.col("ts").alias("time"))
    return stats.filled_times(log.ops.select("doc", "agent", "seq"), times).select("doc", "agent", "seq", F.unix_micros(F.col("time").cast("timestamp")).alias("us"))


@query("bench_duplicate", EV + ", n AS (SELECT doc, max(e) AS n FROM spans GROUP BY doc) SELECT doc, c.c AS copy, s + c.c * n AS start, e + c.c * n AS \"end\" FROM spans JOIN n USING (doc), range(3) c(c)")
def bench_duplicate(spark, sf_dir):
    return stats.repeated(Log(spark, sf_dir).runs, 3).select("doc", "copy", "start", "end")


@query("repack_truncate", EV + ", n AS (SELECT doc, max(e) AS n FROM spans GROUP BY doc) SELECT doc, s AS start, least(e, n // 2) AS \"end\" FROM spans JOIN n USING (doc) WHERE s < n // 2")
def repack_truncate(spark, sf_dir):
    log = Log(spark, sf_dir)
    half = log.spans.join(log.spans.groupBy("doc").agg(F.expr("max(end) div 2").alias("half")), "doc")
    return runs.clip(half.select("doc", "start", "end", "half"), F.lit(0).cast("long"), F.col("half")).select("doc", "start", "end")


@query("chunked_txns", EV + " SELECT doc, agent, s AS start, q0 AS seq_start, count(*) AS n, string_agg(o.key, ',' ORDER BY o.lv) AS keys FROM spans JOIN ops o USING (doc, round, agent) GROUP BY ALL")
def chunked_txns(spark, sf_dir):
    log = Log(spark, sf_dir)
    cut = runs.zip_runs(log.runs.select("doc", "start", "end"), log.agents.select("doc", F.col("lv_start").alias("start"), F.col("lv_end").alias("end"), "agent", F.col("seq_start"), F.col("lv_start").alias("base")), ["doc"])
    held = runs.lookup(log.ops.select("doc", "lv", "key"), cut, ["doc"])
    named = held.groupBy("doc", "agent", "start", (F.col("seq_start") + F.col("start") - F.col("base")).alias("seq_start"))
    return named.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lv", "key"))), lambda x: x["key"]), ",").alias("keys"))


# --- texts ------------------------------------------------------------------------------------------------------------

TALK = """WITH c AS (SELECT conv_id AS doc, turn, role, coalesce(text, '') AS content, length(coalesce(text, '')) AS n FROM conversations)"""


@query("linear_positions", TALK + " SELECT doc, turn, role, n, CAST(sum(n) OVER (PARTITION BY doc ORDER BY turn, role ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS pos FROM c")
def linear_positions(spark, sf_dir):
    return derived.conversations(spark, sf_dir).select("doc", "turn", "role", "n", "pos")


@query("linear_text_length", TALK + " SELECT doc, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY doc")
def linear_text_length(spark, sf_dir):
    return derived.conversations(spark, sf_dir).groupBy("doc").agg(F.sum("n").alias("n"))


DUET = TALK + """, d AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY turn, role) - 1 AS k FROM c WHERE n > 0), e AS (SELECT *, k // 2 AS pair, role || '-' || k % 2 AS side FROM d),
p AS (SELECT doc, pair, CAST(sum(n) AS BIGINT) AS n, string_agg(content, '' ORDER BY side) AS content FROM e GROUP BY ALL)"""


def _duets(spark, sf_dir):
    t = derived.duets(spark, sf_dir)
    return t["runs"], t["text"], t["agents"], t["tips"].withColumn("q", F.lit(0).cast("long"))


@query("text_checkout_concurrent", DUET + " SELECT doc, string_agg(substr(content, n // 4 + n // 8 + 1), '' ORDER BY pair) AS content FROM p GROUP BY doc")
def text_checkout_concurrent(spark, sf_dir):
    r, t, a, tips = _duets(spark, sf_dir)
    return text.checkouts(r, t, a, tips).select("doc", "content")


@query("append_ops", DUET + ", t AS (SELECT doc, string_agg(substr(content, n // 4 + n // 8 + 1), '' ORDER BY pair) AS content FROM p GROUP BY doc) SELECT doc, '?!' || substr(content, 2) AS content FROM t")
def append_ops(spark, sf_dir):
    """To each text, `!` is put in front and the character behind it deleted, then another agent puts `?` in front."""
    t = derived.duets(spark, sf_dir)
    op = lambda kind, pos, content: F.struct(F.lit(kind).alias("kind"), F.lit(pos).cast("long").alias("pos"), F.lit(1).cast("long").alias("n"), F.lit(content).cast("string").alias("content"), F.lit(True).alias("fwd"))
    edit = lambda txn, agent, *ops: t["tips"].select("doc", F.lit(txn).alias("txn"), F.lit(agent).alias("agent"), F.lit(None).cast("array<bigint>").alias("parents"), F.array(*ops).alias("ops"))
    log = merge.appended(t, edit(1, "z", op("Ins", 0, "!"), op("Del", 1, None)).union(edit(2, "y", op("Ins", 0, "?"))))
    asked = graph.tip_versions(log["runs"]).withColumn("q", F.lit(0).cast("long"))
    return text.checkouts(log["runs"], log["text"], log["agents"], asked).select("doc", "content")


@query("branch_merge", DUET + ", t AS (SELECT doc, string_agg(substr(content, n // 4 + n // 8 + 1), '' ORDER BY pair) AS content FROM p GROUP BY doc) SELECT doc, content FROM t")
def branch_merge(spark, sf_dir):
    """A branch at the first turn alone, merged up to the tips."""
    t = derived.duets(spark, sf_dir)
    first = t["runs"].filter("start = 0").select("doc", F.array(F.col("end") - 1).alias("a")).join(t["text"].filter("lv = 0").select("doc", "content"), "doc")
    asked = first.join(t["tips"].withColumnRenamed("version", "b"), "doc").withColumn("q", F.lit(0).cast("long"))
    return text.merged_branches(t["runs"], t["text"], t["agents"], asked).select("doc", "content")


def _own_texts(spark, sf_dir):
    """The same edits, each pair's in a text of its own that is named by where it stood."""
    t = derived.duets(spark, sf_dir)
    begin = F.last(F.when(F.col("kind") == "Ins", F.col("pos")), ignorenulls=True).over(Window.partitionBy("doc").orderBy("lv"))
    own = t["text"].withColumn("crdt", begin).withColumn("pos", F.col("pos") - F.col("crdt"))
    return t["runs"], own, t["agents"], t["tips"].withColumn("q", F.lit(0).cast("long"))


OWN = DUET + """, o AS (SELECT *, CAST(sum(n - n // 4 - n // 8) OVER (PARTITION BY doc ORDER BY pair) - (n - n // 4 - n // 8) AS BIGINT) AS crdt FROM p)"""


@query("embedded_texts", OWN + " SELECT doc, crdt, substr(content, n // 4 + n // 8 + 1) AS content FROM o")
def embedded_texts(spark, sf_dir):
    r, t, a, tips = _own_texts(spark, sf_dir)
    return text.embedded_checkouts(r, t, a, tips).select("doc", "crdt", "content")


@query("embedded_changes", OWN + " SELECT doc, crdt, 'Ins' AS kind, n FROM o UNION ALL SELECT doc, crdt, 'Del', CAST(2 * (n // 4) AS BIGINT) FROM o WHERE n >= 4")
def embedded_changes(spark, sf_dir):
    r, t, a, tips = _own_texts(spark, sf_dir)
    found = text.embedded_transformed(r, t, a, tips.select("doc", "q", F.array().cast("array<bigint>").alias("a"), F.col("version").alias("b")))
    return found.groupBy("doc", "crdt", "kind").agg(F.sum("n").alias("n"))


@query("document_checkout", OWN + """ SELECT doc, 'title' AS path, 'value' AS kind, 'talk ' || doc AS value, 'lost' AS conflicts FROM o GROUP BY doc UNION ALL SELECT doc, 'turns', 'set', NULL, '' FROM o GROUP BY doc
UNION ALL SELECT doc, 'turns/pair@' || crdt, 'text', substr(content, n // 4 + n // 8 + 1), '' FROM o""")
def document_checkout(spark, sf_dir):
    """Documents of a title, which another one lost to, and a set of texts."""
    r, t, a, tips = _own_texts(spark, sf_dir)
    texts = written(text.embedded_checkouts(r, t, a, tips).select("doc", "crdt", "content"), "texts")
    docs, none, the_set = tips.select("doc"), F.lit(None).cast("long"), F.lit(-2).cast("long")
    title = F.struct(F.lit("title").alias("key"), F.concat(F.lit("talk "), F.col("doc").cast("string")).alias("value"), none.alias("child"))
    turns = F.struct(F.lit("turns").alias("key"), F.lit(None).cast("string").alias("value"), the_set.alias("child"))
    entries = docs.select("doc", F.lit(ROOT).cast("long").alias("crdt"), F.inline(F.array(title, turns)))
    elements = texts.select("doc", the_set.alias("crdt"), F.lit("pair").alias("agent"), F.col("crdt").alias("seq"), F.lit(None).cast("string").alias("value"), F.col("crdt").alias("child"))
    containers = texts.select("doc", "crdt", F.lit("text").alias("kind")).union(docs.select("doc", the_set, F.lit("set")))
    losers = docs.select("doc", F.lit(ROOT).cast("long").alias("crdt"), F.lit("title").alias("key"), F.lit("lost").alias("value"))
    found = documents.checkout(entries, containers, elements, texts, losers, lambda level: written(level, "level"))
    return found.select("doc", F.array_join("path", "/").alias("path"), "kind", "value", F.array_join("conflicts", ",").alias("conflicts"))


@query("text_has_conflicts", DUET + " SELECT doc, max(k) >= 1 AS conflicts FROM e GROUP BY doc")
def text_has_conflicts(spark, sf_dir):
    r, t, a, tips = _duets(spark, sf_dir)
    return text.conflicting(r, t, a, tips.select("doc", "q", F.array().cast("array<bigint>").alias("a"), F.col("version").alias("b"))).select("doc", "conflicts")


@query("text_transformed_ops", DUET + """ SELECT doc, 'Ins' AS kind, CAST(sum(n) AS BIGINT) AS n, 0 AS gone FROM p GROUP BY doc
UNION ALL SELECT doc, 'Del', CAST(sum(2 * (n // 4)) AS BIGINT), CAST(sum(n // 4 - n // 8) AS BIGINT) FROM p WHERE n >= 4 GROUP BY doc""")
def text_transformed_ops(spark, sf_dir):
    """Characters by kind, and how many of the deletions found them gone already."""
    r, t, a, tips = _duets(spark, sf_dir)
    found = text.transformed(r, t, a, tips.select("doc", "q", F.array().cast("array<bigint>").alias("a"), F.col("version").alias("b")))
    return found.groupBy("doc", "kind").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("pos").isNull(), F.col("n")).otherwise(0)).alias("gone"))


@query("op_shape_histogram", DUET + """ SELECT 'Ins' AS kind, CASE WHEN n = 1 THEN 'single' ELSE 'forward' END AS shape, count(*) AS ops, CAST(sum(n) AS BIGINT) AS characters FROM e GROUP BY ALL
UNION ALL SELECT 'Del', CASE WHEN n // 4 = 1 THEN 'single' ELSE shape END, count(*), CAST(sum(n // 4) AS BIGINT) FROM p, (VALUES ('forward'), ('backward')) v(shape) WHERE n >= 4 GROUP BY ALL""")
def op_shape_histogram(spark, sf_dir):
    return stats.op_shapes(derived.duets(spark, sf_dir)["text"])


@query("text_stats", DUET + """ SELECT doc, CAST(sum(n) AS BIGINT) AS inserted, CAST(sum(2 * (n // 4)) AS BIGINT) AS deleted, CAST(sum(n + 2 * (n // 4)) AS BIGINT) AS keystrokes, CAST(sum(strlen(content)) AS BIGINT) AS content_bytes FROM p GROUP BY doc""")
def text_stats(spark, sf_dir):
    return stats.text_stats(derived.duets(spark, sf_dir)["text"])


@query("edit_costs", EV + " SELECT doc, count(*) AS cost FROM spans WHERE s < 300 AND e > 100 GROUP BY doc")
def edit_costs(spark, sf_dir):
    log = Log(spark, sf_dir)
    edits = log.spans.select("doc", F.col("start").alias("lv"), (F.col("end") - F.col("start")).alias("n"))
    asked = log.spans.select("doc").distinct().select("doc", F.lit(0).cast("long").alias("q"), F.lit(100).cast("long").alias("start"), F.lit(300).cast("long").alias("end"))
    return stats.edit_costs(edits, asked).select("doc", "cost")


@query("branch_edits", TALK + """, f AS (SELECT doc, arg_min(content, (turn, role)) AS content FROM c WHERE n >= 4 GROUP BY doc)
SELECT doc, '> ' || left(content, 1) || substr(content, 2 + length(content) // 4) AS content, CAST(length(content) + 1 + length(content) // 4 AS BIGINT) AS tip FROM f""")
def branch_edits(spark, sf_dir):
    """A branch on each conversation's first longer turn: a quotation mark is put before it and a quarter of it deleted; the log has it all."""
    rows = derived.conversations(spark, sf_dir).filter("n >= 4")
    first = written(rows.groupBy("doc").agg(F.min_by("content", F.struct("turn", "role")).alias("content")).withColumn("n", F.length("content").cast("long")), "first")
    at = F.lit(0).cast("long")
    log = {
        "runs": first.select("doc", at.alias("start"), F.col("n").alias("end"), F.array().cast("array<bigint>").alias("parents")),
        "agents": first.select("doc", at.alias("lv_start"), F.col("n").alias("lv_end"), F.lit("ann").alias("agent"), at.alias("seq_start")),
        "text": first.select("doc", at.alias("lv"), "n", F.lit("Ins").alias("kind"), at.alias("pos"), "content", F.lit(True).alias("fwd")),
    }
    op = lambda kind, pos, n, content: F.struct(F.lit(kind).alias("kind"), F.lit(pos).cast("long").alias("pos"), n.cast("long").alias("n"), content.cast("string").alias("content"), F.lit(True).alias("fwd"))
    txn = lambda k, op: first.select("doc", F.lit(k).cast("long").alias("txn"), F.lit("ben").alias("agent"), F.array(op).alias("ops"))
    edits = txn(0, op("Ins", 0, F.lit(2), F.lit("> "))).union(txn(1, op("Del", 3, F.expr("n div 4"), F.lit(None))))
    grown, branches = merge.edited_branches(log, first.select("doc", "content", F.array(F.col("n") - 1).alias("version")), edits)
    asked = branches.select("doc", at.alias("q"), "version")
    texts = text.checkouts(grown["runs"], grown["text"], grown["agents"], asked).select("doc", F.col("content").alias("of_log"))
    return branches.join(texts, "doc").filter("content = of_log").select("doc", "content", F.col("version")[0].alias("tip"))


# --- scalars ----------------------------------------------------------------------------------------------------------


@query("zigzag", "SELECT event_id, CASE WHEN value < 0 THEN -2 * CAST(floor(value * 100) AS BIGINT) - 1 ELSE 2 * CAST(floor(value * 100) AS BIGINT) END AS z FROM (SELECT event_id, floor(value * 100) / 100 AS value, value AS v FROM events)".replace("(SELECT event_id, floor(value * 100) / 100 AS value, value AS v FROM events)", "events"))
def zigzag(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.zigzag(F.floor(F.col("value") * 100).cast("long")).alias("z"))


@query("prefix_varint", """WITH v AS (SELECT l_orderkey, l_linenumber, l_orderkey * l_linenumber * l_linenumber * 97 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN v < 128 THEN lpad(hex(v), 2, '0') WHEN v < 16512 THEN hex(32768 + v - 128) WHEN v < 2113664 THEN hex(12582912 + v - 16512) ELSE hex(3758096384 + v - 2113664) END AS coded, v AS decoded FROM v""")
def prefix_varint(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey").cast("long") * F.col("l_linenumber") * F.col("l_linenumber") * 97).alias("v"))
    coded = v.withColumn("b", scalars.prefix_varint(F.col("v")))
    return coded.select("l_orderkey", "l_linenumber", F.hex("b").alias("coded"), scalars.from_prefix_varint(F.col("b")).alias("decoded"))


@query("crc32c", TALK + """, tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, y: xor(x >> 1, 2197175160 * (x & 1)))) AS t),
b AS (SELECT doc, turn, role, t, list_transform(range(1, strlen(content) + 1), lambda i: CAST('0x' || substr(hex(content), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM c, tab)
SELECT doc, turn, role, xor(list_reduce(list_prepend(4294967295, bytes), lambda r, x: xor(r >> 8, t[1 + (xor(r, x) & 255)])), 4294967295) AS crc FROM b""")
def crc32c(spark, sf_dir):
    return derived.conversations(spark, sf_dir).select("doc", "turn", "role", checksums.crc32c(F.encode("content", "UTF-8")).alias("crc"))


@query("utf16_length", "SELECT doc_id, CAST(length(coalesce(text, '')) + length(regexp_replace(coalesce(text, ''), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS units FROM documents")
def utf16_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.utf16_length(F.coalesce("text", F.lit(""))).alias("units"))


@query("transform_cursor", TALK + ", p AS (SELECT *, sum(n) OVER (PARTITION BY doc ORDER BY turn, role ROWS UNBOUNDED PRECEDING) - n AS pos FROM c) SELECT doc, turn, role, CAST(CASE WHEN 500 <= pos THEN 500 ELSE 500 + n END AS BIGINT) AS ins, CAST(CASE WHEN 500 <= pos THEN 500 WHEN 500 < pos + n THEN pos ELSE 500 - n END AS BIGINT) AS del FROM p")
def transform_cursor(spark, sf_dir):
    at = lambda kind: scalars.transform_position(F.lit(500).cast("long"), F.lit(kind), F.col("pos"), F.col("pos") + F.col("n"))
    return derived.conversations(spark, sf_dir).select("doc", "turn", "role", at("Ins").alias("ins"), at("Del").alias("del"))


@query("calc_diff", TALK + """, t AS (SELECT *, lag(content) OVER (PARTITION BY doc ORDER BY turn, role) AS old FROM c),
h AS (SELECT *, least(length(old), n) AS most, (SELECT max(k) FROM range(0, least(length(old), n) + 1) r(k) WHERE left(old, k) = left(content, k)) AS head FROM t WHERE old IS NOT NULL),
g AS (SELECT *, (SELECT max(k) FROM range(0, most - head + 1) r(k) WHERE right(old, k) = right(content, k)) AS tail FROM h)
SELECT doc, turn, role, head AS pos, CAST(length(old) - head - tail AS BIGINT) AS removed, CAST(n - head - tail AS BIGINT) AS added FROM g""")
def calc_diff(spark, sf_dir):
    rows = derived.conversations(spark, sf_dir).withColumn("old", F.lag("content").over(Window.partitionBy("doc").orderBy("turn", "role"))).filter("old IS NOT NULL")
    return rows.select("doc", "turn", "role", scalars.calc_diff(F.col("old"), F.col("content")).alias("d")).select("doc", "turn", "role", "d.pos", F.col("d.del").alias("removed"), F.length("d.ins").cast("long").alias("added"))
