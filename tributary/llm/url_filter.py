"""URL filter by a path-template tree (DataFrame functions only).

Rules label what they fit. For the rest, each host's paths form a tree of segments, as deep as the paths are. From the top
down, a node's children are generalised where they are variable: at least 3 of them, more than half as many as the node has
pages. They become their shapes, digit runs being `#`, where at most half as many shapes as children result, else `*`. Of a node
that isn't variable, each child becomes `*` whose labelled block share doesn't differ, by a two-proportion test at 1.96 standard
errors, from that of its siblings (both with 5 labels or more). A template is rejected when its labelled purity,
smoothed towards the share of block among all labels with a weight of 2, is 0.8 or more.

A level is a grouped pass, written before the next. Where all paths below a node go on alike, nothing can be generalised: such
stretches, and the rest of a path that is alone in its branch, are passed at once, so that deep paths cost no rounds of their own.

Defined results: null urls and urls without `://` have empty host and path; no rule fits an empty host; without any
label the prior is 0 and every template is allowed; a segment `*` counts as generalised; repeated rows each get their row; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, lower_az, stash, table

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
NODE = ["host", "prefix"]
LEAST_CHILDREN, LEAST_LABELS, Z, WEIGHT, REJECT = 3, 5, 1.96, 2.0, 0.8


def parts(url: Column) -> tuple[Column, Column]:
    found = lambda k: F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))
    return lower_az(found(1)), found(2)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. Rules are literals of the plan: give at most some hundreds."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for h, p, _ in ordered]
    out = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ordered]
    return reduce(lambda w, x: w.when(*x), list(zip(fits, out, strict=True))[1:], F.when(fits[0], out[0]))


def template_tree(leaves: DataFrame) -> DataFrame:
    """leaves (host, path, n, block, lab) with their templates; one grouped pass a level."""
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.substring("path", 2, 1 << 30), "/"))
    done, active = [], stash(leaves.select("*", F.lit("").alias("prefix"), segments.alias("rest")), "urls-0")
    while True:
        done.append(active.filter(F.size("rest") == 0).select("host", "path", "n", "block", "lab", F.col("prefix").alias("template")))
        active = active.filter(F.size("rest") > 0).withColumn("seg", F.col("rest")[0])
        if (count := active.count()) == 0:
            return reduce(DataFrame.union, done)
        sums = [F.sum(c).alias(f"c_{c}") for c in ("n", "block", "lab")]
        children = stash(active.groupBy(*NODE, "seg").agg(*sums, F.count(F.lit(1)).alias("leaves"), F.min("rest").alias("low"), F.max("rest").alias("high")), "urls-children")
        named = join_counted(children, nodes_of(children), NODE, "kids", count)
        share = F.try_divide("p_block", "p_lab")
        rest_lab, rest_block = F.col("p_lab") - F.col("c_lab"), F.col("p_block") - F.col("c_block")
        error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), F.col("c_lab")) + F.try_divide(F.lit(1.0), rest_lab)))
        similar = (F.col("c_lab") >= LEAST_LABELS) & (rest_lab >= LEAST_LABELS) & (F.abs(F.try_divide("c_block", "c_lab") - F.try_divide(rest_block, rest_lab)) <= Z * error)
        variable = (F.col("kids") >= LEAST_CHILDREN) & (F.col("kids") * 2 > F.col("p_n"))
        general = F.when(variable, F.when(F.col("shapes") * 2 <= F.col("kids"), shape(F.col("seg"))).otherwise("*")).when(F.coalesce(similar, F.lit(False)), "*")
        named = named.select(*NODE, "seg", "leaves", general.alias("general"), F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False)).alias("fork"), F.size("low").alias("whole"))
        alike = F.when(F.col("fork") > 0, F.col("fork") - 1).otherwise(F.col("whole")).cast("int")  # how many segments all paths of the branch share
        named = stash(named.select(*NODE, "seg", "leaves", "general", F.when(F.col("general").isNull(), alike).otherwise(1).alias("steps")), "urls-named")
        met = join_counted(active, named, [*NODE, "seg"], "leaves", count)
        passed = F.coalesce("general", F.array_join(F.slice("rest", F.lit(1), F.col("steps")), "/"))
        left = F.slice("rest", F.col("steps") + 1, F.size("rest"))
        active = stash(met.select("host", "path", "n", "block", "lab", F.concat("prefix", F.lit("/"), passed).alias("prefix"), left.alias("rest")), "urls")


def shape(segment: Column) -> Column:
    return F.regexp_replace(segment, "[0-9]+", "#")


def nodes_of(children: DataFrame) -> DataFrame:
    """Each node's number of children and of their shapes, and its sums; shapes are counted before a node's rows meet."""
    sums = lambda of: [F.sum(f"{of}_{c}").alias(f"p_{c}") for c in ("n", "block", "lab")]
    shapes = children.groupBy(*NODE, shape(F.col("seg")).alias("shape")).agg(F.count(F.lit(1)).alias("kids"), *sums("c"))
    return stash(shapes.groupBy(*NODE).agg(F.sum("kids").alias("kids"), F.count(F.lit(1)).alias("shapes"), *sums("p")), "urls-nodes")


def url_filter(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity."""
    host, path = parts(F.col(url_col).cast("string"))
    at = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    at = stash(at, "urls-pages")
    count = lambda v: F.sum(F.when(F.col("fit.verdict") == v, 1).otherwise(0))
    leaves = at.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), count("block").alias("block"), (count("block") + count("allow")).alias("lab"))
    tree = stash(template_tree(leaves), "urls-tree")
    known = tree.agg(F.sum("block").alias("block"), F.sum("lab").alias("lab"), F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("pages")).first()
    prior = known["block"] / known["lab"] if known["lab"] else 0.0
    judged = tree.groupBy("host", "template").agg(F.count(F.lit(1)).alias("leaves"), ((F.sum("block") + F.lit(WEIGHT * prior)) / (F.sum("lab") + WEIGHT)).alias("purity"))
    of_leaf = stash(join_counted(tree, stash(judged, "urls-judged"), ["host", "template"], "leaves", known["leaves"]).select("host", "path", "n", "template", "purity"), "urls-leaves")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    met = join_counted(at, of_leaf, ["host", "path"], "n", known["pages"] or 0)
    return met.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def op1_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"))


def _oracle(levels: int = 6) -> str:
    """The same in SQL, level by level, for paths of up to `levels` segments."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda k: " ".join(f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{(r[0] + r[1], r[2])[k]}'" for r in ordered)
    sql = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{upper}', '{lower}') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
a AS (SELECT *, CASE {fits(0)} END AS rule, CASE {fits(1)} END AS fit FROM u),
t0 AS (SELECT host, path, string_split(path, '/')[2:] AS segs, '' AS prefix, count(*) AS n, count(*) FILTER (fit = 'block') AS block, count(*) FILTER (fit IS NOT NULL) AS lab FROM a GROUP BY ALL),"""
    for k in range(1, levels + 1):
        sql += f"""
c{k} AS (SELECT host, prefix, segs[{k}] AS seg, sum(n) AS c_n, sum(block) AS c_block, sum(lab) AS c_lab FROM t{k - 1} WHERE len(segs) >= {k} GROUP BY ALL),
p{k} AS (SELECT host, prefix, count(*) AS kids, count(DISTINCT regexp_replace(seg, '[0-9]+', '#', 'g')) AS shapes, sum(c_n) AS p_n, sum(c_block) AS p_block, sum(c_lab) AS p_lab FROM c{k} GROUP BY ALL),
n{k} AS (SELECT host, prefix, seg, CASE WHEN kids >= {LEAST_CHILDREN} AND kids * 2 > p_n THEN CASE WHEN shapes * 2 <= kids THEN regexp_replace(seg, '[0-9]+', '#', 'g') ELSE '*' END
  WHEN c_lab >= {LEAST_LABELS} AND p_lab - c_lab >= {LEAST_LABELS} AND abs(c_block / c_lab - (p_block - c_block) / nullif(p_lab - c_lab, 0)) <=
  {Z} * sqrt(p_block / nullif(p_lab, 0) * (1 - p_block / nullif(p_lab, 0)) * (1.0::DOUBLE / nullif(c_lab, 0) + 1.0::DOUBLE / nullif(p_lab - c_lab, 0))) THEN '*' ELSE seg END AS g FROM c{k} JOIN p{k} USING (host, prefix)),
t{k} AS (SELECT host, path, segs, prefix || '/' || g AS prefix, n, block, lab FROM t{k - 1} JOIN n{k} USING (host, prefix) WHERE len(segs) >= {k} AND seg = segs[{k}]
  UNION ALL SELECT * FROM t{k - 1} WHERE len(segs) < {k}),"""
    return sql + f"""
b AS (SELECT coalesce(sum(block) / nullif(sum(lab), 0), 0.0) AS prior FROM t0),
j AS (SELECT host, prefix, (sum(block) + {WEIGHT} * (SELECT prior FROM b)) / (sum(lab) + {WEIGHT}) AS purity FROM t{levels} GROUP BY ALL)
SELECT page_id, a.host, path, rule, coalesce(fit, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, prefix AS template, purity
FROM a JOIN t{levels} USING (host, path) JOIN j USING (host, prefix)
"""


ORACLE = _oracle()
