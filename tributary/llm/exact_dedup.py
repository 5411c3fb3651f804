"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A document's normalised text (white space deleted) is cut where its content says so: at the first place, 256 or more
code points on, where a three-letter context matches, and after 2,048 at the latest. Chunks are deduplicated to
identifiers; the chunk dictionary verifies byte for byte that no identifier stands for two different chunks. Documents
are then equal exactly when their ordered identifier lists are equal. Text moves once, as distinct chunks; all later
steps see only identifiers, digests and ids, and a recipe that many documents have is joined by broadcast.

Defined results: null text counts as empty; all empty texts are one group; of rows that tie in length the smallest
doc_id stays (a null id comes last), of rows that tie in id too exactly one stays; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, stash, table, text_or_empty

SHA, LENGTH = "_sha256_of_normalised_text", "_code_points_of_text"
WHITE = " \t\n\x0b\x0c\r"
LEAST, MOST = 256, 2048
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?(?<=[a-g][h-n][o-t])|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def chunks(norm: Column) -> Column:
    """The chunks of a text, in order; their concatenation is the text."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def verified(norms: DataFrame, ident: Callable[[Column], Column]) -> bool:
    """Whether each identifier stands for one chunk only. norms: one column, norm."""
    occurrences = norms.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(ident(F.col("chunk")).alias("ident"), "chunk")
    dictionary = occurrences.groupBy("ident", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    return dictionary.groupBy("ident").agg(F.count(F.lit(1)).alias("chunks")).filter("chunks > 1").isEmpty()


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ident: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, uid, n_code_points, text_sha256, recipe. An identifier found to stand for two chunks gives way to the chunk's SHA-256."""
    whole = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = whole.select("doc_id", F.length("text").cast("long").alias("n_code_points"), normalised(F.col("text")).alias("norm"))
    if not verified(base.select("norm"), ident):
        ident = lambda c: F.unhex(F.sha2(c, 256))
    rows = base.select("doc_id", F.monotonically_increasing_id().alias("uid"), "n_code_points", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), lambda c: ident(c)).alias("recipe"))
    return stash(rows, "recipes")


def judged(docs: DataFrame, id_col: str, text_col: str, ident: Callable[[Column], Column]) -> DataFrame:
    """exact_dedup's rows, with n_code_points. A recipe that many documents have is no single task's work."""
    rows = recipes(docs, id_col, text_col, ident)
    first = F.min(F.struct((-F.col("n_code_points")).alias("least"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    groups = stash(rows.groupBy("recipe").agg(first.alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    met = join_counted(rows, groups, ["recipe"], "group_size", rows.count())
    return met.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"), "n_code_points")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ident: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    return judged(docs, id_col, text_col, ident).drop("n_code_points")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = 500_000) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    A row is known by its id, its digest and its code points. Rows that agree in these are alike to the operator, and one of
    them stays where one is kept. Texts stay where they are as long as at most `bound` rows go (some 100 bytes each are broadcast);
    beyond, they move once, by a shuffle.
    """
    mark = ["_mark_id", "_mark_sha", "_mark_n"]
    rows = judged(docs.select(id_col, text_col), id_col, text_col, F.xxhash64).select(F.col("doc_id").alias(mark[0]), F.col("text_sha256").alias(mark[1]), F.col("n_code_points").alias(mark[2]), "kept")
    marks = rows.groupBy(*mark).agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")).filter("NOT _kept OR _rows > 1")
    marks = stash(marks.drop("_rows"), "marks")
    small = marks.limit(bound + 1).count() <= bound
    keyed = docs.withColumns({SHA: F.sha2(normalised(text_or_empty(text_col)), 256), LENGTH: F.length(text_or_empty(text_col)).cast("long")})
    same = keyed[id_col].eqNullSafe(marks[mark[0]]) & (keyed[SHA] == marks[mark[1]]) & (keyed[LENGTH] == marks[mark[2]])
    met = keyed.join(F.broadcast(marks) if small else marks, same, "left").drop(*mark)
    out = met.filter("_kept IS NULL")
    if not marks.filter("_kept").isEmpty():
        out = out.union(met.filter("_kept").dropDuplicates([id_col, SHA, LENGTH]))
    return out.drop(SHA, LENGTH, "_kept")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
"""
