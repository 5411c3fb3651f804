"""Exact top-k inner products by MaxScore over sharded postings.

A vector's components become integers, floor(1024 x). A query's terms are its dimensions of non-zero weight, each with a side:
upper for positive weights, lower for negative ones. Candidates are dealt into shards of about 4,096. A shard has, for each dimension
and side, a base (the upper or lower quartile of its components) and a posting list: the candidates beyond the base. So a
term's impact on a candidate, weight * (component - base), is positive only for those posted, and at most its bound. The score is the
sum of the impacts and of the bases' share, which is the same for all candidates of the shard.

A query comes to a shard with a threshold: the k-th best score of a seed shard, which each query is scored against first, so
it can only be too low. Terms whose bounds, smallest first, together with the bases' share stay below the threshold are
non-essential: a candidate posted in none of the others can't compete. The essential terms' postings are traversed; then
candidates are taken by what they can still reach, best first, and the non-essential terms probe them while any can compete, the
threshold rising with the k-th best score found. The shards' lists are merged by (score descending, vec_id ascending), so ties
are exact. On dense vectors most terms are essential; what is saved shows in the number of rows that shards give.

Queries go to every shard in blocks of about 512; each pair of a shard and a block is one row of work. Nothing is
broadcast or gathered that grows with the input.

Sums are exact at any size: candidates and queries are taken by width, and a pair of groups is summed in doubles or 64-bit
integers where these hold all its sums, else in Python's integers. Scores beyond 64 bits are ranked by their exact value.

Defined results: vectors that are null, or that hold null or non-finite components, take no part, nor do rows without an id
and query-candidate pairs of different length; a score beyond 64 bits is given as the nearest 64-bit number; a query has no row of its own id among its results; with fewer than k
candidates all are returned; rows repeated under one id are ranked each, and as queries share one list; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stash, table

SHARD, BLOCK, STEP = 4096, 512, 64
WIDTHS = (22, 28)  # bits of components: vectors up to the first, up to the second, and beyond
WHOLE = float(1 << 43)  # doubles from here on are whole after multiplication by 1024
SCHEMA = "query_id long, vec_id long, score long, beyond binary"


class Postings:
    """A shard's postings. Rows 0 to d - 1 are the upper sides of the dimensions, d to 2 d - 1 the lower ones."""

    def __init__(self, ids: np.ndarray, shard: np.ndarray):
        d, n = shard.shape
        self.ids, self.shard = ids, shard
        ranked = np.sort(shard, axis=1)
        quarter = n // 4
        upper, lower = ranked[:, n - 1 - quarter], ranked[:, quarter]
        self.base = np.concatenate([upper, lower])
        self.reach = np.concatenate([ranked[:, -1] - upper, lower - ranked[:, 0]])
        self.posted = [np.flatnonzero(shard[i] > upper[i]) for i in range(d)] + [np.flatnonzero(shard[i] < lower[i]) for i in range(d)]

    def best(self, query: np.ndarray, own: int, k: int, least) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of all candidates with a score of `least` (None: any) or more that are among the query's best k of the shard or tie with the last."""
        d, n = self.shard.shape
        terms = np.flatnonzero(query != 0)
        side = np.where(query[terms] > 0, terms, terms + d)
        constant = (query[terms] * self.base[side]).sum()
        bound = np.abs(query[terms]) * self.reach[side]
        order = np.argsort(bound, kind="stable")
        reached = constant + np.cumsum(bound[order])  # what a candidate can score that is posted in the first terms only
        spare = len(order) if least is None else int(np.searchsorted(reached, least, side="left"))
        if least is None or constant >= least:  # even a candidate that no list has can compete
            spare, found = 0, np.arange(n)
        elif spare == len(order):
            return np.zeros(0, np.int64), np.zeros(0, self.shard.dtype)
        else:
            seen = np.zeros(n, dtype=bool)
            for t in side[order[spare:]].tolist():
                seen[self.posted[t]] = True
            found = np.flatnonzero(seen)
        found = found[self.ids[found] != own]
        essential, probes = terms[order[spare:]], terms[order[:spare]][::-1]
        rest = (reached[spare - 1] if spare else constant) - constant  # what the probes can add at most
        rows = self.shard[essential] if len(found) == n else self.shard[np.ix_(essential, found)]
        partial = query[essential] @ rows + (constant - (query[essential] * self.base[side[order[spare:]]]).sum())
        if least is not None:
            keep = partial + rest >= least
            found, partial = found[keep], partial[keep]
        if len(probes):
            found, partial = self.probed(query, probes, found, partial, rest, k, least)
        if len(found) > k:
            last = np.partition(partial, len(partial) - k)[len(partial) - k]
            found, partial = found[partial >= last], partial[partial >= last]
        return found, partial

    def probed(self, query: np.ndarray, probes: np.ndarray, found: np.ndarray, partial: np.ndarray, rest, k: int, least) -> tuple[np.ndarray, np.ndarray]:
        """Candidates whose score can still be `least` or more, with their scores, taken by what they can reach."""
        d = len(self.shard)
        side = np.where(query[probes] > 0, probes, probes + d)
        bases = (query[probes] * self.base[side]).sum()
        order = np.argsort(-partial, kind="stable")
        out_at, out_scores = [], []
        best = np.zeros(0, partial.dtype)
        for i in range(0, len(order), STEP):
            at = order[i : i + STEP]
            if least is not None and partial[at[0]] + rest < least:
                break
            scores = partial[at] + query[probes] @ self.shard[np.ix_(probes, found[at])] - bases
            keep = scores >= least if least is not None else np.ones(len(at), dtype=bool)
            out_at.append(found[at[keep]])
            out_scores.append(scores[keep])
            best = np.sort(np.concatenate([best, scores[keep]]))[::-1][:k]
            if len(best) == k and (least is None or best[-1] > least):
                least = best[-1]
        return np.concatenate([np.zeros(0, np.int64), *out_at]), np.concatenate([np.zeros(0, partial.dtype), *out_scores])


def lists(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def by_width(v: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of v = floor(1024 x) / 1024 by width: (greatest |1024 v|, positions, 1024 v as int64 or, where it may not fit, Python integers)."""
    widths = np.abs(v).max(axis=1, initial=0.0)
    cuts = [-1.0, *(float(1 << bits) / 1024 for bits in WIDTHS), np.inf]
    out = []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        at = np.flatnonzero((widths > low) & (widths <= high))
        if not len(at):
            continue
        if np.isfinite(high):
            whole = (v[at] * 1024.0).astype(np.int64)
        else:
            whole = np.array([int(x) * 1024 if abs(x) >= WHOLE else int(x * 1024.0) for x in v[at].ravel().tolist()], dtype=object).reshape(len(at), v.shape[1])
        out.append((int(abs(whole).max(initial=0)), at, whole))
    return out


def beyond(score: int) -> bytes:
    """Orders scores beyond 64 bits, among each other and around those that fit, as bytes."""
    if -(1 << 63) <= score < 1 << 63:
        return b"\x01"
    size = (abs(score).bit_length() + 7) // 8
    key = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\x02" + key if score > 0 else b"\x00" + bytes(255 - x for x in key)


def search_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(candidate ids, candidate components, query ids, query components, thresholds, dimensions) to each query's best in the shard."""
    for batch in batches:
        for ids, vectors, asked, queries, least, d in zip(*(lists(batch.column(i)) for i in range(4)), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            out: list[list] = [[], [], [], []]
            wanted = by_width(queries.reshape(len(asked), d))
            for widest, of, whole in by_width(vectors.reshape(len(ids), d)):
                names = ids[of]
                for width, which, rows in wanted:
                    most = 4 * widest * width * max(d, 1)  # impacts, bounds and bases
                    exact = np.float64 if most < 2**52 else np.int64 if most < 2**61 else object  # of what the sums hold exactly, the fastest
                    postings = Postings(names, np.ascontiguousarray(whole.T).astype(exact))
                    for q, query in zip(which.tolist(), rows.astype(exact), strict=True):
                        at, scores = postings.best(query, int(asked[q]), k, least[q])
                        found = sorted(zip((-scores).tolist(), names[at].tolist(), strict=True))[:k] if exact is object else None
                        if found is None:
                            best = np.lexsort((names[at], -scores))[:k]
                            found = list(zip((-scores[best].astype(np.int64)).tolist(), names[at[best]].tolist(), strict=True))
                        out[0] += [int(asked[q])] * len(found)
                        out[1] += [x for _, x in found]
                        out[2] += [min(max(-int(x), -(1 << 63)), (1 << 63) - 1) for x, _ in found]
                        out[3] += [beyond(-int(x)) for x, _ in found]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], names=["query_id", "vec_id", "score", "beyond"])


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v: floor(1024 x) / 1024 of each component, which a double holds exactly; vectors that take no part are left out."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    down = lambda x: F.when(F.abs(x) < WHOLE, F.floor(F.lit(1024.0) * x).cast("double") / 1024.0).otherwise(x)
    return vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).filter(~bad).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: down(x.cast("double"))).alias("v"))


def max_score(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose id is divisible by `every`, candidates all other rows."""
    rows = integers(vectors, id_col, vec_col).withColumn("dims", F.size("v"))
    n_shards = max(1, -(-vectors.count() // SHARD))
    # a row's shard, by its place in the table too, as an id may have many rows
    rows = stash(rows.withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_shards))), "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0).select("dims", "vec_id", "v").distinct()
    asked = stash(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, -(-asked.count() // BLOCK))))), "asked")
    shards = rows.groupBy("dims", "part").agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("v")).alias("vectors"))

    def search(queries: DataFrame, n: int) -> DataFrame:
        """The best of each query (dims, block, vec_id, v, least) in each of the first n shards."""
        blocks = queries.groupBy("dims", "block").agg(F.collect_list(F.struct("vec_id", "v", "least")).alias("q"))
        blocks = blocks.select("dims", F.col("q.vec_id").alias("asked"), F.flatten("q.v").alias("queries"), F.col("q.least").alias("least"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("part"))
        pairs = shards.join(blocks.hint("shuffle_hash"), ["dims", "part"]).select("ids", "vectors", "asked", "queries", "least", "dims")
        return map_arrow(pairs, lambda b: search_batches(b, k), SCHEMA)

    seeds = search(asked.withColumn("least", F.lit(None).cast("long")), 1)
    # a list of fewer than k sets no threshold, nor does a score below all 64-bit numbers
    floor = seeds.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= k) & (F.col("least") > F.lit(-(1 << 63))))
    floor = stash(floor.select(F.col("query_id").alias("vec_id"), "least"), "thresholds")
    once = asked.join(asked.groupBy("vec_id").count().filter("count = 1").select("vec_id").join(floor, "vec_id"), "vec_id", "left")
    found = search(once, n_shards)
    best = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_max_score(spark, sf_dir):
    return max_score(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
