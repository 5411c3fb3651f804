"""Near-duplicate documents by order MinHash.

A document is the sequence of its five-word shingles, each labelled with its occurrence number (a text of fewer words
is one shingle of them all). For each of 22 orders of the labelled shingles a sketch takes the 5 least, keeps them in
text order and hashes them: two documents share a sketch if the least of both together are aligned ones, C(L, 5) / C(U, 5)
with L aligned of U = n + m - L. That is the fifth power of their similarity for long texts and less for short ones, so texts of at
most 32 shingles get 4 sketches more, and those of at most 15 another 16 sketches of 3. At a similarity of 0.8 or more all
sketches differ with a chance of at most 4 in 10,000, whatever the lengths (worst: 29 and 34 shingles, 3.6 in 10,000).

Candidates are verified by banded alignment: similarity is L / (n + m - L) with L the longest common subsequence of the
two labelled sequences within the band that 0.8 allows; as labelled shingles are unique in a text, that is the longest
increasing run of matched positions. Classes are the components of links of 0.8 or more.

No group is gathered and no group's pairs are listed: texts of equal words collapse first; then each bucket's members
are compared with the bucket's hub. Only buckets that still hold different components go on: up to 32 members, those of
different components pair; beyond, the members outside the bucket's largest component meet all members in blocks of at most about
128 by 256, whose shared shingles are counted as a matrix product and only whose promising pairs are aligned.

Buckets, texts and classes that many rows have are joined by broadcast, so no task gets the rows of one.

Defined results: class_id is the least doc_id of the class; texts of equal words, so all texts without words, are one
class; null text counts as empty; each row is judged by its own text, so rows that share a doc_id but not their words may be in
different classes; of a class, the rows of class_id stay whose words are those of its first text, and repeated rows stay or go
together; a row without doc_id is compared with none: its class_id is null and it is kept; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, map_arrow, stash, table, without_rows
from .components import components
from .textnum import K1, K2, Words, blocks, mix, texts

SHINGLE, BANDS, PICK = 5, 22, 5
MIDDLE, MIDDLE_BANDS = 32, 26
SMALL, SMALL_BANDS, SMALL_PICK = 15, 16, 3
PAIRED, SIDE = 32, (128, 256)  # buckets up to PAIRED members list their pairs; larger ones are compared in blocks of these sizes
COLUMNS = 8192
ORDERS = mix(np.arange(1, 200, dtype=np.uint64) * K2) | np.uint64(1)
SKETCH = "doc_id long, mark long, words binary, n int, bands array<long>"


def shingles(words: Words) -> list[np.ndarray]:
    """Each text's shingle hashes, in text order."""
    h, first = words.hashes, words.first
    rolled = h.copy()
    for k in range(1, SHINGLE):
        rolled[:-k] = rolled[:-k] * K1 + h[k:]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(rolled[a : b - SHINGLE + 1])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                short = short * K2 + h[k : k + 1]
            out.append(mix(short))
        else:
            out.append(h[:0])
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence numbers mixed in: unique in a text."""
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return mix(s)
    at = np.arange(len(s))
    occurrence = np.empty(len(s), dtype=np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return mix(s + occurrence * K2)


def sketch(s: np.ndarray, marks: np.ndarray, bands: int, pick: int, salt: int) -> np.ndarray:
    """bands hashes, each of the pick least labelled shingles in text order."""
    out = np.empty(bands, dtype=np.uint64)
    step = bands if len(s) < 20_000 else 1
    for k in range(0, bands, step):
        ranks = marks[None, :] * ORDERS[salt + k : salt + k + step, None]
        at = np.sort(np.argpartition(ranks, pick - 1, axis=1)[:, :pick], axis=1) if len(s) > pick else np.broadcast_to(np.arange(len(s)), (step, len(s)))
        hashed = np.arange(salt + k, salt + k + step, dtype=np.uint64) * K2
        for column in s[at].T:
            hashed = mix(hashed + column)
        out[k : k + step] = hashed
    return out


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch.column(2))
        whole, sizes, bands = [], [], []
        for i, j in blocks(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            place = np.arange(len(words.hashes), dtype=np.uint64) - np.repeat(words.first[:-1], np.diff(words.first)).astype(np.uint64)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(words.hashes ^ mix(place + np.uint64(salt))), dtype=np.uint64)]) for salt in (1, 1 << 40)]
            for k, s in enumerate(shingles(words)):
                a, b = words.first[k], words.first[k + 1]
                whole.append(b"".join((x[b : b + 1] - x[a : a + 1]).tobytes() for x in sums))
                sizes.append(len(s))
                if not len(s):
                    bands.append([])
                    continue
                marks = labelled(s)
                keys = sketch(s, marks, BANDS if len(s) > MIDDLE else MIDDLE_BANDS, PICK, 0)
                if len(s) <= SMALL:
                    keys = np.concatenate([keys, sketch(s, marks, SMALL_BANDS, SMALL_PICK, MIDDLE_BANDS)])
                bands.append(keys.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "mark", "words", "n", "bands"])


def aligned(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two labelled sequences are alike to 0.8 or more."""
    n, m = len(a), len(b)
    if not n or not m:
        return n == m
    band = (n + m) // 9  # insertions and deletions that 9 L >= 4 (n + m) leaves room for
    order = np.argsort(a)
    at = np.searchsorted(a[order], b)
    at[at == n] = 0
    place = order[at]
    matched = (a[place] == b) & (np.abs(place - np.arange(m)) <= band)
    if 9 * int(matched.sum()) < 4 * (n + m):
        return False
    tails: list[int] = []
    for x in place[matched].tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return 9 * len(tails) >= 4 * (n + m)


def aligned_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the (a, b) that are alike."""
    for batch in batches:
        sides = [texts(batch.column(k)) for k in (2, 3)]
        keep, last, marks_a = [], None, None
        keys = batch.column(0).to_pylist()
        for k, key in enumerate(keys):
            one = [Words(data[offsets[k] : offsets[k + 1]], offsets[k : k + 2] - offsets[k]) if side or key != last else None for side, (data, offsets) in enumerate(sides)]
            if key != last:
                marks_a, last = labelled(shingles(one[0])[0]), key
            if aligned(marks_a, labelled(shingles(one[1])[0])):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])


def alike(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike. candidates: node, text."""
    side = lambda x: candidates.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    return map_arrow(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b"), aligned_batches, "a long, b long")


def shared_counts(sides: list[list[np.ndarray]]) -> np.ndarray:
    """How many labelled shingles each text of the first side shares with each of the second, by blocks of columns."""
    which = np.concatenate([np.full(len(x), k) for k, x in enumerate(sides[0] + sides[1])]) if sides[0] + sides[1] else np.zeros(0, int)
    codes = np.concatenate([*sides[0], *sides[1], np.zeros(0, np.uint64)])
    _, codes, often = np.unique(codes, return_inverse=True, return_counts=True)
    keep = often[codes] > 1
    codes, which = codes[keep], which[keep]
    n_a, n_b = len(sides[0]), len(sides[1])
    out = np.zeros((n_a, n_b), dtype=np.float32)
    order = np.argsort(codes, kind="stable")
    codes, which = codes[order], which[order]
    fresh = np.concatenate([[0], np.cumsum(codes[1:] != codes[:-1])]) if len(codes) else codes
    for start in range(0, int(fresh[-1]) + 1 if len(fresh) else 0, COLUMNS):
        i, j = np.searchsorted(fresh, [start, start + COLUMNS])
        block = np.zeros((n_a + n_b, COLUMNS), dtype=np.float32)
        block[which[i:j], fresh[i:j] - start] = 1
        out += block[:n_a] @ block[n_a:].T
    return out


def compare_blocks(key: tuple, found: pa.Table) -> pa.Table:
    """Links that join the components of two blocks of one bucket: (side, node, comp, text) to (a, b)."""
    data, offsets = texts(found.column("text").combine_chunks())
    side, node, comp = (found.column(c).to_numpy() for c in ("side", "node", "comp"))
    marks: list[np.ndarray] = []
    for i, j in blocks(offsets):
        marks += [labelled(s) for s in shingles(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))]
    at = [np.flatnonzero(side == k) for k in (0, 1)]
    sides = [[marks[k] for k in x] for x in at]
    counts = shared_counts(sides)
    sizes = [np.array([len(x) for x in s], dtype=np.int64) for s in sides]
    might = (9 * counts >= 4 * (sizes[0][:, None] + sizes[1][None, :])) & (comp[at[0]][:, None] != comp[at[1]][None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    links = []
    rows, columns = np.nonzero(might)
    for k in np.argsort(-counts[rows, columns], kind="stable").tolist():
        a, b = int(at[0][rows[k]]), int(at[1][columns[k]])
        ra, rb = root(int(comp[a])), root(int(comp[b]))
        if ra != rb and aligned(marks[a], marks[b]):
            parent[max(ra, rb)] = min(ra, rb)
            links.append((int(node[a]), int(node[b])))
    return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])


def alike_in_blocks(buckets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links between the components of large buckets (key, node, comp, members, top)."""
    parts = lambda n, size: F.ceil(n / F.lit(size)).cast("int")
    dealt = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    n_a, n_b = parts(F.col("members") - F.col("top.size"), SIDE[0]), parts(F.col("members"), SIDE[1])
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    outside = buckets.filter(F.col("comp") != F.col("top.comp")).select("key", "node", "comp", F.lit(0).alias("side"), dealt(n_a, 1).alias("i"), every(n_b).alias("j"))
    whole = buckets.select("key", "node", "comp", F.lit(1).alias("side"), every(n_a).alias("i"), dealt(n_b, 2).alias("j"))
    sent = outside.unionByName(whole).join(candidates, "node")
    return sent.groupBy("key", "i", "j").applyInArrow(compare_blocks, "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, kept."""
    return classes(docs, id_col, text_col).drop("mark")


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """near_classes' rows, with mark, a 64-bit hash of the text."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"), F.col(text_col).cast("string").alias("text"))
    sketches = stash(map_arrow(plain, sketch_batches, SKETCH), "sketches")
    # a node is a text of its own; `first` says where to find it
    grouped = sketches.filter("doc_id IS NOT NULL").groupBy("words").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = stash(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select(F.explode("bands").alias("key"), "node", "n")
    hubs = stash(members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "hubs")
    met = join_counted(members, hubs, ["key"], "size", hubs.agg(F.sum("size")).first()[0] or 0)
    shared = stash(met.select("key", "node", "n", "hub").distinct(), "shared")
    candidates = texts_of(plain, nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "first.doc_id", "first.mark"))

    fits = lambda x, y: (F.least(x, y) * 5 >= F.greatest(x, y) * 4)  # noqa: E731  at 0.8 lengths differ by a quarter at most
    to_hub = shared.filter(F.col("node") != F.col("hub.node")).filter(fits(F.col("n"), F.col("hub.n"))).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    links = stash(alike(to_hub, candidates), "links")
    comps = components(links)

    named = stash(shared.join(comps, "node", "left").select("key", "node", "n", F.col("hub.node").alias("hub"), F.coalesce("comp", "node").alias("comp")), "named")
    counted = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    mixed = stash(counted.groupBy("key").agg(F.sum("size").alias("members"), F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").drop("comps"), "mixed-keys")
    left = stash(join_counted(named, mixed, ["key"], "members", named.count()), "mixed")

    few = left.filter((F.col("members") <= PAIRED) & (F.col("node") != F.col("hub")))  # pairs with the hub are done
    x, y = few.alias("x"), few.alias("y")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & fits(F.col("x.n"), F.col("y.n")))
    more = alike(across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), candidates)
    more = stash(more.union(alike_in_blocks(left.filter(F.col("members") > PAIRED), candidates)), "links")
    if not more.isEmpty():
        comps = components(links.union(more))

    linked = stash(comps.join(nodes.select("node", F.col("first.doc_id").alias("id")), "node"), "linked")
    best = stash(linked.groupBy("comp").agg(F.min(F.struct("id", "node")).alias("keeper"), F.count(F.lit(1)).alias("size")), "keepers")
    kept = join_counted(linked, best, ["comp"], "size", linked.count()).select("node", "keeper")
    own = F.struct(F.col("first.doc_id").alias("id"), F.col("node"))
    of_words = stash(nodes.join(kept, "node", "left").select("words", "rows", "node", F.coalesce("keeper", own).alias("keeper")), "classes")
    named_rows = sketches.filter("doc_id IS NOT NULL").select("doc_id", "mark", "words")
    out = join_counted(named_rows, of_words, ["words"], "rows", sketches.count())
    out = out.select("doc_id", "mark", F.col("keeper.id").alias("class_id"), ((F.col("doc_id") == F.col("keeper.id")) & (F.col("node") == F.col("keeper.node"))).alias("kept"))
    return out.unionByName(sketches.filter("doc_id IS NULL").select("doc_id", "mark", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept")))


def texts_of(plain: DataFrame, wanted: DataFrame, bound: int = 500_000) -> DataFrame:
    """(node, text) of the wanted (node, doc_id, mark). Up to `bound` of them, 24 bytes each, are broadcast; more are joined by a shuffle."""
    wanted = stash(wanted, "wanted")
    small = wanted.limit(bound + 1).count() <= bound
    found = stash(plain.join(F.broadcast(wanted) if small else wanted.hint("shuffle_hash"), ["doc_id", "mark"]).select("node", "text"), "candidates")
    return found if found.count() == wanted.count() else stash(found.groupBy("node").agg(F.first("text").alias("text")), "candidates")  # of repeated rows one


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents of which each class keeps one, with all their columns. Rows are told apart by doc_id and a 64-bit hash of the text."""
    judged = classes(docs.select("doc_id", "text"), "doc_id", "text").filter("NOT kept").select("doc_id", F.col("mark").alias("row"))
    return without_rows(docs, judged, F.xxhash64(docs["text"].cast("string")))


def op7_minhash_dedup(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents"))
