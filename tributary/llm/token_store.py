"""Token files with a minimal-perfect-hash index.

Writing: documents are dealt into parts by ranges of (doc_id, hash of the text), sorted in each, tokenised, and written as
shards, one Parquet row each, of whole documents with about 1 MiB of ids:

  place    part, shard, first (ids of the part before the shard), n_docs, n_null (documents without id, which come first), n_ids,
           width, low and high (the least and the greatest key)
  index    seeds: the displacement of each bucket of the minimal perfect hash; for each slot: keys, prints (a 32-bit
           fingerprint of the key), rows (the document's number in the shard), offsets (its first id in the shard)
  payload  lengths (of all documents, in order); data: their ids one after another, as little-endian unsigned 16-bit integers
           (32-bit if the vocabulary needs them)

Uncompressed, so ids are raw. Parts and shards ascend by doc_id, and so do documents in a shard. A key's shard is found by low
and high, which Parquet's statistics prune by; in it, the key costs two hashes and one read of each of the slot's arrays: seed,
slot, fingerprint, offset. All reading goes this way. Rows go through Spark's own writer: task retries and lost executors
leave no half shard.

Tokenising encodes each distinct piece of text once per worker where that can't change the result: byte-level
pre-tokens never cross the place between a non-space and a single space before a non-space. Texts and tokenizers for
which that can't be told are encoded whole.

Defined results: a null or empty text has the end id alone; documents without id come first and have no key; ties in id are
ordered by the text's hash, so an id that many rows share is spread over parts; rows repeated under one id stand one after
another, a shard's slot leads to its first of them, and lookup gives all; a key that isn't there gives no row; an empty
table gives empty files and an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, shared_dir, table
from .textnum import mix

END = 2
BLOCK = 1 << 20
TEXTS = 4 << 20  # bytes of text that are encoded together, but for single texts
PIECES = 900_000  # distinct pieces in each of two generations that a worker keeps
FILE = "part int, shard int, first long, n_docs long, n_null long, n_ids long, width int, low long, high long, seeds binary, keys binary, prints binary, rows binary, offsets binary, lengths binary, data binary"


class Encoder:
    """Texts to little-endian id bytes."""

    def __init__(self, tokenizer_json: str, width: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.kind = np.dtype(f"<u{width}")
        self.code = next(c for c in "HIL" if array(c).itemsize == width)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        said = json.loads(tokenizer_json)
        pre = said.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not said.get("normalizer") and not said.get("truncation") and not said.get("padding") and not any(" " in x for x in self.special)
        if self.by_piece and hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # it would only see what this class's own store lacks
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.opens[[k for x, k in vocabulary.items() if x.startswith("Ġ")]] = True  # how byte-level vocabularies write a blank
        self.known: dict[str, bytes | bool] = {}
        self.older: dict[str, bytes | bool] = {}

    def packed(self, pieces: list[str]) -> list[bytes]:
        code = self.code
        return [array(code, e.ids).tobytes() for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; none may be null. Words are told apart, looked up and put together by Arrow, each distinct one once."""
        if not self.by_piece:
            return [self.packed([x.as_py()])[0] for x in texts]
        split = pc.split_pattern(texts, " ")
        words, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        rest = np.ones(len(words), dtype=bool)
        rest[ends[:-1]] = False
        firsts = words.take(pa.array(ends[:-1])).to_pylist()
        coded = words.filter(pa.array(rest)).dictionary_encode()  # but for a text's first, each stands for itself with a blank before it
        ends -= np.arange(len(ends))
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # sooner than to_pylist
        found = list(map(self.known.get, pieces))
        if None in found:
            self.learn(pieces, found)
        whole = np.zeros(len(texts), dtype=bool)
        if False in found:
            apart = np.fromiter((x is not False for x in found), bool, len(found))
            bad = np.cumsum(np.append(False, ~apart[coded.indices.to_numpy()]))
            whole = bad[ends[1:]] != bad[ends[:-1]]
            found = [x or b"" for x in found]
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], "<i8")[ends].tolist() if len(ids) else [0] * len(ends)
        data = memoryview(ids.buffers()[2] or b"")
        short = [x for x in firsts if len(x) <= 64]
        head = dict(zip(short, self.packed(short), strict=True))
        out = []
        for k, first in enumerate(firsts):
            if whole[k] or (ends[k] < ends[k + 1] and not self.alone(first)):
                out.append(self.packed([texts[k].as_py()])[0])
            else:
                out.append((head[first] if len(first) <= 64 else self.packed([first])[0]) + data[at[k] : at[k + 1]])
        return out

    def learn(self, pieces: list[str], found: list) -> None:
        """Fill in what is None; False marks a piece that can't stand alone. Two generations: what was asked for lately stays."""
        if len(self.known) + found.count(None) > PIECES:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        fresh = []
        for k, x in enumerate(found):
            if x is None:
                p = pieces[k]
                if (x := older.get(p)) is None and self.alone(p):
                    fresh.append(k)
                else:
                    known[p] = found[k] = x or False
        for k, x in zip(fresh, self.joined([pieces[k] for k in fresh]), strict=True):
            known[pieces[k]] = found[k] = x

    def joined(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece with a blank before it. Some dozen pieces are encoded as one text: a call and a result for each cost more
        than its encoding. A piece's ids begin where a token begins with a blank."""
        out: list[bytes] = []
        at = 0
        while at < len(pieces):
            rows, size, start = [], 0, at
            while at < len(pieces) and size < 1 << 16:
                rows.append(" " + " ".join(pieces[at : at + 48]))
                size += len(rows[-1])
                at += 48
            raw = b"".join(self.packed(rows))
            cut = np.flatnonzero(self.opens[np.frombuffer(raw, self.kind)])
            if len(cut) == len(pieces[start:at]):
                cut = [*(cut * self.kind.itemsize).tolist(), len(raw)]
                out += [raw[a:b] for a, b in pairwise(cut)]
            else:  # a vocabulary without a token for some byte
                out += self.packed([" " + p for p in pieces[start:at]])
        return out

    def alone(self, piece: str) -> bool:
        """Text that neither begins nor ends with white space and holds no special token."""
        if not piece or piece.strip() != piece:
            return False
        for x in self.special:
            if x in piece:
                return False
        return True


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds by bucket, slot of each key) for distinct keys: hash and displace, largest buckets first."""
    n = len(keys)
    n_buckets = max(1, n // 4)
    slots, seeds = np.empty(n, dtype=np.int64), np.zeros(n_buckets, dtype=np.uint32)
    if not n:
        return seeds, slots
    bucket = bucket_of(keys, n_buckets)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    taken = np.zeros(n, dtype=bool)
    for b in np.argsort(-np.diff(cut), kind="stable").tolist():
        mine = order[cut[b] : cut[b + 1]]
        if not len(mine):
            break
        first = np.uint64(0)
        while True:
            tries = np.arange(first, first + np.uint64(64), dtype=np.uint64)
            at = slot_of(keys[mine][None, :], tries[:, None], n)
            free = ~taken[at].any(axis=1)
            if len(mine) > 1:
                ranked = np.sort(at, axis=1)
                free &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if free.any():
                k = int(np.argmax(free))
                seeds[b], slots[mine] = tries[k], at[k]
                taken[at[k]] = True
                break
            first += np.uint64(64)
    return seeds, slots


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E37)) % np.uint64(n_buckets)).astype(np.int64)


def slot_of(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mix(mix(keys.astype(np.int64).view(np.uint64)) + seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def print_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x5BD1E995)) >> np.uint64(32)).astype("<u4")


class Shard:
    """One shard: keyed access in constant time."""

    KINDS = {"seeds": "<u4", "keys": "<i8", "prints": "<u4", "rows": "<u4", "offsets": "<i8", "lengths": "<i8"}

    def __init__(self, row: dict):
        for name, kind in self.KINDS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.n_docs, self.n_null = row["n_docs"], row["n_null"]
        self.ends = np.cumsum(self.lengths)
        #: Where each key's rows end: where the next one's begin.
        self.order = np.argsort(self.rows, kind="stable")
        self.after = np.empty(len(self.rows), dtype=np.int64)
        self.after[self.order] = np.append(self.rows[self.order][1:], self.n_docs)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key by seed and hash, or -1 where the fingerprint or then the key differs."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = slot_of(keys, self.seeds[bucket_of(keys, len(self.seeds))], len(self.keys))
        return np.where((self.prints[at] == print_of(keys)) & (self.keys[at] == keys), at, -1)

    def documents(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, first id, ids) of the documents of each key; a key's further documents follow its first."""
        at = self.slots(keys)
        at = at[at >= 0]
        counts = self.after[at] - self.rows[at]
        of = np.repeat(at, counts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        row = self.rows[of].astype(np.int64) + nth
        before = self.ends - self.lengths
        return self.keys[of], self.offsets[of] + before[row] - before[self.rows[of]], self.lengths[row]

    def without_key(self) -> tuple[np.ndarray, np.ndarray]:
        """(first id, ids) of the documents without id."""
        n = self.lengths[: self.n_null]
        return self.ends[: self.n_null] - n, n


def shards_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, Shard, np.ndarray]]:
    """(row without its payload, index, ids) of each shard; nothing is copied."""
    for r in range(len(batch)):
        row = {n: batch.column(n)[r].as_buffer() if pa.types.is_binary(batch.schema.field(n).type) or pa.types.is_large_binary(batch.schema.field(n).type) else batch.column(n)[r].as_py() for n in batch.schema.names}
        yield row, Shard(row), np.frombuffer(row["data"], f"<u{row['width']}")


def encoder_of_worker(tokenizer_json: str, width: int) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    import tokenizers

    name = (zlib.crc32(tokenizer_json.encode()), len(tokenizer_json), width)
    kept = tokenizers.__dict__.setdefault("_encoders_of_worker", {})
    if name not in kept:
        kept.clear()
        kept[name] = Encoder(tokenizer_json, width)
    return kept[name]


def shard_row(part: int, shard: int, first: int, ids: list[int | None], held: list[bytes], width: int) -> pa.RecordBatch:
    """A shard of the documents with these ids (None first, then ascending) and packed token ids."""
    n_null = sum(x is None for x in ids)
    every = np.array(ids[n_null:], dtype=np.int64)
    lengths = np.array([len(x) // width for x in held], dtype="<i8")
    fresh = np.ones(len(every), dtype=bool)
    fresh[1:] = every[1:] != every[:-1]
    keys, rows = every[fresh], np.flatnonzero(fresh) + n_null
    starts = np.cumsum(lengths) - lengths
    seeds, slots = perfect_hash(keys)
    by_slot = {"keys": (keys, "<i8"), "prints": (print_of(keys), "<u4"), "rows": (rows, "<u4"), "offsets": (starts[rows], "<i8")}
    row = dict(part=part, shard=shard, first=first, n_docs=len(ids), n_null=n_null, n_ids=int(lengths.sum()), width=width, low=int(keys[0]) if len(keys) else None, high=int(keys[-1]) if len(keys) else None)
    for name, (values, kind) in by_slot.items():
        placed = np.empty(len(keys), dtype=kind)
        placed[slots] = values
        row[name] = placed.tobytes()
    row |= dict(seeds=seeds.astype("<u4").tobytes(), lengths=lengths.tobytes(), data=b"".join(held))
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in FILE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[n]], kinds[t]) for n, t in fields], names=[n for n, _ in fields])


def encoded(encoder: Encoder, texts: pa.Array) -> Iterator[bytes]:
    """The ids of each text (null: empty), some MB of text at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // TEXTS
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    for a, b in pairwise(cuts):
        yield from encoder.encode_all(texts.slice(a, b - a).fill_null(""))


def shard_batches(batches: Iterator[pa.RecordBatch], tokenizer_json: str, width: int, end: int) -> Iterator[pa.RecordBatch]:
    """Sorted (doc_id, text) of one part to its shards."""
    from pyspark import TaskContext

    part, encoder = TaskContext.get().partitionId(), encoder_of_worker(tokenizer_json, width)
    closing = np.array([end], dtype=encoder.kind).tobytes()
    ids: list[int | None] = []
    held: list[bytes] = []
    shard, size, first = 0, 0, 0
    for batch in batches:
        for key, packed in zip(batch.column(0).to_pylist(), encoded(encoder, batch.column(1)), strict=True):
            held.append(packed + closing)
            ids.append(key)
            size += len(held[-1])
            if size >= BLOCK:
                yield shard_row(part, shard, first, ids, held, width)
                shard, first = shard + 1, first + size // width
                ids, held, size = [], [], 0
    if held:
        yield shard_row(part, shard, first, ids, held, width)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end: int = END, shards: int | None = None) -> None:
    """docs (doc_id, text) to token files under path. The driver reads the tokenizer's file and sends its text with the tasks."""
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    width = 2 if Tokenizer.from_str(tokenizer_json).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    by = [F.asc_nulls_first("doc_id"), F.asc("mark")]
    dealt = plain.repartitionByRange(shards, *by) if shards else plain.repartitionByRange(*by)
    rows = map_arrow(dealt.sortWithinPartitions(*by).select("doc_id", "text"), lambda b: shard_batches(b, tokenizer_json, width, end), FILE)
    rows.write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(path)


def digest_batches(batches: Iterator[pa.RecordBatch], before: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Shards to one row per document, each found by its key: seed, slot, fingerprint, offset."""
    for batch in batches:
        for row, shard, data in shards_of(batch):
            starts, lengths = shard.without_key()
            keys, at, n = shard.documents(shard.keys[shard.order])
            if len(starts) + len(keys) != shard.n_docs:
                raise ValueError(f"the index of part {row['part']}, shard {row['shard']} doesn't lead to all of its documents")
            starts, lengths = np.concatenate([starts, at]), np.concatenate([lengths, n])
            crcs = [zlib.crc32(data[a : a + k].astype("<u4")) for a, k in zip(starts.tolist(), lengths.tolist(), strict=True)]
            ids = pa.concat_arrays([pa.nulls(shard.n_null, pa.int64()), pa.array(keys, pa.int64())])
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts + (before[row["part"]] + row["first"]), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    shards = read_shards(spark, path)
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # two numbers for each task that wrote
    sums = np.cumsum([0, *(n for _, n in totals)]).tolist()
    before = {part: start for (part, _), start in zip(totals, sums[:-1], strict=True)}
    return map_arrow(shards, lambda b: digest_batches(b, before), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, start, ids) of the documents of some keys (sent with the tasks; give at most some 100,000). start: place in its part.

    Shards are pruned by low and high in the scan: up to 64 keys by each one's place, more by their range.
    """
    wanted = np.unique(np.array(keys, dtype=np.int64))
    if not len(wanted):
        return spark.createDataFrame([], "doc_id long, start long, ids array<int>")
    spans = [(k, k) for k in wanted.tolist()] if len(wanted) <= 64 else [(int(wanted[0]), int(wanted[-1]))]
    holds = reduce(lambda x, y: x | y, [(F.col("low") <= b) & (F.col("high") >= a) for a, b in spans])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, shard, data in shards_of(batch):
                a, b = np.searchsorted(wanted, [row["low"], row["high"] + 1])
                ids, at, n = shard.documents(wanted[a:b])
                lists = pa.array([data[s : s + k].astype(np.int32) for s, k in zip(at.tolist(), n.tolist(), strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at + row["first"], pa.int64()), lists], names=["doc_id", "start", "ids"])

    return map_arrow(read_shards(spark, path).filter(holds), found, "doc_id long, start long, ids array<int>")


def op9_token_store(spark, sf_dir):
    import public_tokenizers

    path = f"{shared_dir(spark)}/tributary-tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, path)
