"""Conflict-constrained best-fit packing of documents into token bins.

A document's length is a column of the caller's, such as its number of tokens; without one, its number of white-space-separated
words and one end mark. Pieces of `capacity` that a document
fills by itself become bins of their own; what is left is an item. Items are taken by descending length. Open bins are
ordered by residual and carry a bitmap of their sources and one of their duplicate clusters; the successor search starts
at the least residual that holds the item and goes on until a bin has neither the item's source nor its cluster. So no
bin has two items of a source or of a cluster, and each item goes into the tightest compatible bin of its shard.

Items are dealt into shards of about `shard` items, each packed by one task, by a hash of the item (and, of equal items, of its
number among them): a hot source or cluster is spread evenly over all shards, and the bins depend on the items only, not on how files
are split. Text isn't moved; items are four numbers.

Defined results: a null or empty text has length 1; a null or negative length counts as none and gives no row; null sources are no source and conflict with nothing; empty texts
are no duplicates of each other; rows repeated under one id are items each, of one cluster; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, table, text_or_empty

CAPACITY, SHARD = 2048, 8192
SCHEMA = "doc_id long, piece int, bin long, start long, n long"


class Bins:
    """Open bins by residual. Each list holds bins with the same residual and source bitmap, in order of opening."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: dict[int, dict[int, list[int]]] = {}
        self.mask = 0  # bit r: some bin has residual r
        self.total, self.has = Counter(), {}
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _move(self, b: int, by: int) -> None:
        r, s = self.residual[b], self.sources[b]
        self.total[r] += by
        rest = s
        while rest:
            bit = rest & -rest
            rest ^= bit
            count = self.has.setdefault(bit, Counter())
            count[r] += by
        if by > 0:
            insort(self.at.setdefault(r, {}).setdefault(s, []), b)
            self.mask |= 1 << r
        else:
            group = self.at[r]
            del group[s][bisect_left(group[s], b)]
            if not group[s]:
                del group[s]
            if not group:
                del self.at[r]
                self.mask &= ~(1 << r)

    def find(self, n: int, source: int, cluster: int) -> int | None:
        rest, has = self.mask >> n << n, self.has.get(source, {})
        while rest:
            low = rest & -rest
            rest ^= low
            r = low.bit_length() - 1
            if source and self.total[r] <= has.get(r, 0):
                continue
            best = None
            for sources, bins in self.at[r].items():
                if not sources & source:
                    b = next((b for b in bins if not self.clusters[b] & cluster), None)
                    if b is not None and (best is None or b < best):
                        best = b
            if best is not None:
                return best
        return None

    def add(self, n: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, start) of an item, in a new bin if none is compatible."""
        b = self.find(n, source, cluster)
        if b is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._move(b, -1)
        start = self.capacity - self.residual[b]
        self.residual[b] -= n
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if self.residual[b]:
            self._move(b, 1)
        return b, start


def pack(items: list[tuple], capacity: int) -> list[tuple]:
    """(doc_id, source, cluster, n) to (doc_id, piece, bin, start, n)."""
    bins, out = Bins(capacity), []
    twice = {c for c, k in Counter(x[2] for x in items if x[2] is not None).items() if k > 1}
    bit_of: tuple[dict, dict] = ({}, {})
    bit = lambda which, x: 0 if x is None else 1 << bit_of[which].setdefault(x, len(bit_of[which]))
    order = sorted(items, key=lambda x: (-(x[3] % capacity), x[0] is None, x[0] or 0, x[1] or "", x[2] or 0, x[3]))
    full = 0
    for doc, source, cluster, n in order:
        whole, left = divmod(n, capacity)
        if left:
            b, start = bins.add(left, bit(0, source), bit(1, cluster) if cluster in twice else 0)
            out.append((doc, whole, b, start, left))
        for piece in range(whole):
            full += 1
            out.append((doc, piece, -full, 0, capacity))
    n_open = len(bins.residual)
    return [(d, p, b if b >= 0 else n_open - b - 1, s, n) for d, p, b, s, n in out]


def pack_shard(key: tuple, found: pa.Table, capacity: int) -> pa.Table:
    shard = key[0].as_py()
    rows = pack(list(zip(*(found.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "n")), strict=True)), capacity)
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array([(shard << 32) + b for b in columns[2]], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=["doc_id", "piece", "bin", "start", "n"])


def items_of(docs: DataFrame, cluster=None, length=None) -> DataFrame:
    """doc_id, source, cluster, n. cluster, length: columns; else the texts equal but for white space and ASCII case, and words and an end mark."""
    text = text_or_empty()
    bare = F.lower(F.translate(text, " \t\n\x0b\x0c\r", ""))
    same = F.when(bare != "", F.xxhash64(bare)) if cluster is None else cluster
    n = F.regexp_count(text, F.lit(r"\S+")) + 1 if length is None else F.greatest(F.coalesce(length, F.lit(0)), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), same.cast("long").alias("cluster"), n.cast("long").alias("n"))


def best_fit(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, cluster=None, length=None) -> DataFrame:
    """One row per piece of a document: doc_id, piece, bin, start, n. cluster (of a bounded integer type) and length may be columns of docs."""
    item = ["doc_id", "source", "cluster", "n"]
    counted = stash(items_of(docs, cluster, length).groupBy(*item).agg(F.count(F.lit(1)).alias("copies")), "items")
    shards = max(1, -(-(counted.agg(F.sum("copies")).first()[0] or 0) // shard))
    items = counted.select(*item, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(*item, "copy"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(lambda key, found: pack_shard(key, found, capacity), SCHEMA)


def op3_best_fit_packing(spark, sf_dir):
    return best_fit(table(spark, sf_dir, "documents"))
