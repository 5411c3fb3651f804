"""N-best SentencePiece segmentation, encoding and decoding.

A text, with a blank before it and `▁` for blanks, is a lattice: an edge for every piece of the vocabulary that stands
at a place, with the piece's stored score, and for a character that no piece covers its bytes, with the least score less 10.
Forward Viterbi scores give each node the best score from the start; these are exact heuristics for a backward A-star
search, which pops the N best segmentations in order. No piece has a blank after another character, or a line feed among
others, so the lattice falls apart at such places: the parts are searched one by one (each distinct short part once per
worker), and the N best of the whole are taken from the parts' alternatives by their losses, best first.

Where all scores are whole numbers, so that sums are exact, the forward pass runs over many new short parts at once, and carries
each node's second best score: this gives a part's best segmentation and the loss of its second best. A part whose best is
no better than another, or holds bytes, is searched by A-star alone; so are the parts whose alternatives are asked for.

Decoding turns ids back into bytes, `▁` into blanks, and drops the blank before the text. `round_trip` says whether the
best segmentation decodes to the text (a text with `▁` itself doesn't).

Defined results: a null or empty text has one segmentation without pieces, of score 0; segmentations of equal score come in
the order of the parts' places and ids; fewer than N are returned where there are no more; rows repeated each get
their rows; an empty table gives an empty result; texts of any length are searched whole.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_arrow, table

BLANK = "▁"
N_BEST, PARTS, SHORT = 3, 450_000, 64
TEXTS, TOGETHER = 2_000_000, 20_000  # characters of texts, but for single ones, and short parts that are searched together
SCHEMA = "doc_id long, rank int, n_pieces long, score double, ids_crc32 long, round_trip boolean"
IDS = SCHEMA + ", ids array<int>"
#: A blank run with what follows it up to the next blank or line feed; or a line feed.
PART = re.compile(r"\n| *[^ \n]+| +")


class Walks:
    """Forward Viterbi over many parts at once, with each node's second best score. For models of whole scores."""

    def __init__(self, model: Model):
        chars = sorted({c for p in model.pieces for c in p})
        self.code = np.zeros(0x110000, np.uint16 if len(chars) < 1 << 16 else np.uint32)  # 0: in no piece
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n_codes, self.floor = len(chars) + 1, model.floor
        at, keys, nodes, n_nodes = {c: k + 1 for k, c in enumerate(chars)}, [], [], 1
        piece, score = {}, {}
        stack = [(model.trie, 0)]
        while stack:
            children, node = stack.pop()
            for c, child in children.items():
                if c == "":
                    (piece[node],), score[node] = child
                else:
                    keys.append(node * self.n_codes + at[c])
                    nodes.append(n_nodes)
                    stack.append((child, n_nodes))
                    n_nodes += 1
        self.piece, self.score = np.full(n_nodes, -1, np.int32), np.zeros(n_nodes)
        self.piece[list(piece)], self.score[list(score)] = list(piece.values()), list(score.values())
        # the steps (node, character) to nodes, in a hash table with linear probing, a quarter full at most
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        key, node = np.array(keys, np.int64), np.array(nodes, np.int32)
        slot = self.slot(key)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]
            placed = self.keys[slot] == key
            self.nodes[slot[placed]] = node[placed]
            key, node, slot = key[~placed], node[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The node that each step leads to, or 0."""
        keys = nodes * np.int64(self.n_codes) + codes
        slot = self.slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.nodes[slot], 0)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[left]]
            same = held == keys[left]
            out[left[same]] = self.nodes[slot[left[same]]]
            left = left[~same & (held >= 0)]
        return out

    def best(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(loss of the second best, ids of the best, ends of each part's ids) of parts that aren't empty (blanks written as ▁).

        The loss is NaN where this can't tell the best: it is no better than another, or holds a character that no piece covers.
        """
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        last = np.cumsum(sizes + 1) - 1  # each part's last node, where its first is the one after the last of the part before
        firsts = last - sizes
        codes = np.zeros(last[-1] + 1, np.int64)  # the character after each node; 0 at the last, so walks end there
        inner = np.ones(len(codes), dtype=bool)
        inner[last] = False
        codes[inner] = self.code[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")]
        place = np.arange(len(codes)) - np.repeat(firsts, sizes + 1)
        start, node, depth = np.flatnonzero(inner), np.zeros(inner.sum(), np.int64), 0
        starts, ends, pieces, scores = [], [], [], []
        while len(start):
            node = self.step(node, codes[start + depth])
            depth += 1
            found = self.piece[node] >= 0
            found &= node > 0
            if depth == 1:  # no piece covers the character
                none = start[~found]
                starts, ends, pieces, scores = [none], [none + 1], [np.full(len(none), -1, np.int32)], [np.full(len(none), self.floor)]
            starts.append(start[found])
            ends.append(start[found] + depth)
            pieces.append(self.piece[node[found]])
            scores.append(self.score[node[found]])
            start, node = start[node > 0], node[node > 0].astype(np.int64)
        start, end, piece, score = map(np.concatenate, (starts, ends, pieces, scores))
        order = np.lexsort((end, place[end]))
        start, end, piece, score = start[order], end[order], piece[order], score[order]
        heads = np.flatnonzero(np.append(True, end[1:] != end[:-1]))  # the first edge into each node
        at = place[end[heads]]
        cuts = np.searchsorted(at, np.arange(1, at[-1] + 2))
        tails = np.append(heads, len(end))
        first, second, back = np.zeros(len(codes)), np.full(len(codes), -np.inf), np.zeros(len(codes), np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # nodes by their place in the part
            lo, hi = tails[a], tails[b]
            into, begin = heads[a:b] - lo, start[lo:hi]
            through = first[begin] + score[lo:hi]
            most = np.maximum.reduceat(through, into)
            hits = np.flatnonzero(through == np.repeat(most, np.diff(tails[a : b + 1])))
            hits = hits[np.searchsorted(hits, into)]  # the first of the best edges
            to = end[heads[a:b]]
            first[to], back[to] = most, hits + lo
            through[hits] = second[begin[hits]] + score[lo:hi][hits]
            second[to] = np.maximum.reduceat(through, into)
        loss = first[last] - second[last]
        loss[loss == 0] = np.nan
        of, node, seen, ids = np.arange(len(parts)), last, [], []
        while len(of):  # from the ends back
            edge = back[node]
            seen.append(of)
            ids.append(piece[edge])
            node = start[edge]
            of, node = of[node > firsts[of]], node[node > firsts[of]]
        of, ids = np.concatenate(seen[::-1]), np.concatenate(ids[::-1])
        loss[of[ids < 0]] = np.nan
        return loss, ids[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=len(parts)))


class Model:
    """Pieces, their scores, and byte pieces of a SentencePiece model."""

    def __init__(self, proto: bytes):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        every = range(lib.get_piece_size())
        self.of_byte = {}
        self.bytes_of: list[bytes] = []
        self.pieces: dict[str, tuple[int, float]] = {}
        for k in every:
            piece = lib.id_to_piece(k)
            if lib.is_byte(k):
                value = int(piece[3:5], 16)
                self.of_byte[value] = k
                self.bytes_of.append(bytes([value]))
            elif lib.is_control(k) or lib.is_unknown(k) or lib.is_unused(k):
                self.bytes_of.append(b"")
            else:
                self.pieces[piece] = (k, lib.get_score(k))
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
        self.unknown = lib.unk_id()
        self.floor = min((score for _, score in self.pieces.values() if score > -1e8), default=0.0) - 10.0
        self.trie: dict = {}
        for piece, (k, score) in self.pieces.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = ((k,), score)
        self.kind = np.dtype("<u2" if lib.get_piece_size() <= 1 << 16 else "<u4")
        #: What an id adds to a score; of a character's bytes the leading one bears it.
        self.score_of = np.zeros(lib.get_piece_size())
        for k, score in self.pieces.values():
            self.score_of[k] = score
        for byte, k in self.of_byte.items():
            self.score_of[k] = 0.0 if 128 <= byte < 192 else self.floor
        self.score_of[self.unknown] = self.floor
        self.apart = not any(re.search(f"[^{BLANK}]{BLANK}", p) or ("\n" in p and len(p) > 1) for p in self.pieces)

        scores = [score for _, score in self.pieces.values()] + [self.floor]
        #: Whole scores add up without rounding, in any order: then many parts can be searched at once.
        self.whole = all(score == int(score) and abs(score) < 1 << 40 for score in scores if math.isfinite(score)) and all(map(math.isfinite, scores))

    def walks(self) -> Walks:
        if not hasattr(self, "_walks"):
            self._walks = Walks(self)
        return self._walks

    def lattice(self, text: str) -> tuple[list[list[tuple[int, tuple[int, ...], float]]], list[float]]:
        """The edges (start, ids, score) into each node, and the nodes' forward Viterbi scores."""
        n = len(text)
        into: list[list] = [[] for _ in range(n + 1)]
        forward = [0.0] + [-math.inf] * n
        for start in range(n):
            base, node, single = forward[start], self.trie, False
            for end in range(start, n):
                node = node.get(text[end])
                if node is None:
                    break
                found = node.get("")
                if found is not None:
                    single = single or end == start
                    ids, score = found
                    into[end + 1].append((start, ids, score))
                    if base + score > forward[end + 1]:
                        forward[end + 1] = base + score
            if not single:
                into[start + 1].append((start, self.bytes_or_unknown(text[start]), self.floor))
                forward[start + 1] = max(forward[start + 1], base + self.floor)
        return into, forward

    def bytes_or_unknown(self, char: str) -> tuple[int, ...]:
        return tuple(self.of_byte[b] for b in char.encode()) if len(self.of_byte) == 256 else (self.unknown,)

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a part (blanks written as ▁): (score, ids), best first.

        As the heuristic is exact, a hypothesis' estimate is the score of its best completion; once n different
        completions are known to be as good or better, a worse one is not queued.
        """
        into, forward = self.lattice(text)
        # (-(backward + forward), node, order, backward, rest): rest links the pieces towards the end; ties go depth first
        agenda: list[tuple] = [(-forward[-1], len(text), 0, 0.0, None)]
        popped = [0] * (len(text) + 1)
        known = [forward[-1]]  # the n best completions known, as a heap
        out, order, push, pop = [], 0, heapq.heappush, heapq.heappop
        while agenda and len(out) < n:
            _, node, _, backward, rest = pop(agenda)
            if node == 0:
                ids: list[int] = []
                while rest is not None:
                    ids += rest[0]
                    rest = rest[1]
                out.append((backward, tuple(ids)))
                continue
            if popped[node] == n:  # the n best go on from here already
                continue
            popped[node] += 1
            best, same = forward[node], True  # the first edge of the best completion goes on with its parent's place in known
            for start, piece, score in into[node]:
                through = score + forward[start]
                if same and through == best:
                    same = False
                elif len(known) < n:
                    push(known, backward + through)
                elif backward + through < known[0]:
                    continue
                else:
                    heapq.heapreplace(known, backward + through)
                order += 1
                push(agenda, (-(backward + through), start, order, backward + score, (piece, rest)))
        return out


class Segmenter:
    """What is kept of a part is its loss, eight bytes, and its ids behind it."""

    def __init__(self, proto: bytes, n: int = N_BEST):
        self.model, self.n = Model(proto), n
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def part(self, key: str) -> bytes:
        """The loss of a part's second best segmentation, and the ids of the best."""
        best = self.model.n_best(key.replace(" ", BLANK), 2 if self.n > 1 else 1)
        loss = best[0][0] - best[1][0] if len(best) > 1 else math.inf
        return struct.pack("<d", loss) + np.array(best[0][1], self.model.kind).tobytes()

    def learn(self, texts: list[list[str]]) -> None:
        """Search the short parts of some texts that aren't known all at once; what is left out here is searched when it is asked for."""
        if not self.model.whole:
            return
        fresh = [k for k in set().union(*texts) if k not in self.known and len(k) <= SHORT]
        if len(self.known) + len(fresh) > PARTS:
            self.older, self.known = self.known, {}
        for k in fresh:
            if (x := self.older.get(k)) is not None:
                self.known[k] = x
        fresh = [k for k in fresh if k not in self.known]
        for at in range(0, len(fresh), TOGETHER):
            some = fresh[at : at + TOGETHER]
            loss, ids, ends = self.model.walks().best([k.replace(" ", BLANK) for k in some])
            told = ~np.isnan(loss)
            if self.n == 1:
                loss[:] = np.inf
            raw, losses, cut = ids.astype(self.model.kind).tobytes(), loss.astype("<f8").tobytes(), (ends * self.model.kind.itemsize).tolist()
            for i, (k, sure, a, b) in enumerate(zip(some, told.tolist(), [0, *cut], cut, strict=False)):
                self.known[k] = losses[8 * i : 8 * i + 8] + raw[a:b] if sure else self.part(k)

    def keys(self, text: str) -> list[str]:
        whole = " " + text
        if not self.model.apart:
            return [whole]
        if "  " in whole or "\0" in whole:
            return PART.findall(whole)
        keys = whole.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return list(filter(None, keys))

    def parts(self, keys: list[str]) -> list[bytes]:
        found = list(map(self.known.get, keys))
        if None not in found:
            return found
        if len(self.known) > PARTS:
            self.older, self.known = self.known, {}
        known, older, long = self.known, self.older, {}
        for i, x in enumerate(found):
            if x is None:
                k = keys[i]
                part = known.get(k) or long.get(k)
                if part is None:
                    part = older.get(k) or self.part(k)
                    (known if len(k) <= SHORT else long)[k] = part
                found[i] = part
        return found

    def segment(self, text: str, keys: list[str] | None = None) -> list[tuple[float, np.ndarray]]:
        """The N best segmentations: (score, ids)."""
        kind = self.model.kind
        if not text:
            return [(0.0, np.zeros(0, kind))]
        keys = keys or self.keys(text)
        parts = self.parts(keys)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        heads = (np.concatenate([[0], ends[:-1]])[:, None] + np.arange(8)).ravel()
        loss, rest = raw[heads].view("<f8"), np.ones(len(raw), dtype=bool)
        rest[heads] = False
        ids = raw[rest].view(kind)
        score = float(self.model.score_of[ids].sum())
        out = [(score, ids)]
        if self.n == 1:
            return out
        # of the parts only the n - 1 whose second best loses least can differ from their best in the n best
        most = np.partition(loss, self.n - 2)[self.n - 2] if len(loss) >= self.n else np.inf
        least = np.concatenate([np.flatnonzero(loss < most), np.flatnonzero(loss == most)])[: self.n - 1]
        single = []
        for k in least.tolist():
            others = self.model.n_best(keys[k].replace(" ", BLANK), self.n)
            single += [(others[0][0] - s, k, r, other) for r, (s, other) in enumerate(others) if r]
        single = sorted(single, key=lambda x: x[:3])[: self.n - 1]
        cut = np.concatenate([[0], (ends - 8 * np.arange(1, len(parts) + 1)) // kind.itemsize])
        agenda: list[tuple] = [(x[0], (i,)) for i, x in enumerate(single)]
        heapq.heapify(agenda)
        while agenda and len(out) < self.n:
            lost, chosen = heapq.heappop(agenda)
            if len({single[i][1] for i in chosen}) == len(chosen):
                pieces, at = [], 0
                for _, k, _, found in sorted((single[i] for i in chosen), key=lambda x: x[1]):
                    pieces += [ids[at : cut[k]], np.array(found, kind)]
                    at = cut[k + 1]
                out.append((score - lost, np.concatenate([*pieces, ids[at:]])))
            for i in range(chosen[-1] + 1, len(single)):
                heapq.heappush(agenda, (lost + single[i][0], (*chosen, i)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.model.bytes_of.__getitem__, ids.tolist())).decode(errors="replace")[1:]


def segmenter_of_worker(proto: bytes, n: int) -> Segmenter:
    """One segmenter for all tasks of a Python worker."""
    import sentencepiece

    name = (zlib.crc32(proto), len(proto), n)
    kept = sentencepiece.__dict__.setdefault("_segmenters_of_worker", {})
    if name not in kept:
        kept.clear()
        kept[name] = Segmenter(proto, n)
    return kept[name]


def prepared(segmenter: Segmenter, texts: pa.Array) -> Iterator[tuple[str, list[str]]]:
    """Each text (null: empty) with its parts; the parts of some MB of texts are searched together."""
    some: list[tuple[str, list[str]]] = []
    size = 0
    for k, x in enumerate(texts):
        text = x.as_py() or ""
        some.append((text, segmenter.keys(text) if text else []))
        size += len(text)
        if size >= TEXTS or k + 1 == len(texts):
            segmenter.learn([keys for _, keys in some])
            yield from some
            some, size = [], 0


def segment_batches(batches: Iterator[pa.RecordBatch], proto: bytes, n: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    segmenter = segmenter_of_worker(proto, n)
    names = [x.split()[0] for x in (IDS if with_ids else SCHEMA).split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
    for batch in batches:
        rows = []
        for doc_id, (text, keys) in zip(batch.column(0).to_pylist(), prepared(segmenter, batch.column(1)), strict=True):
            best = segmenter.segment(text, keys)
            same = segmenter.decode(best[0][1]) == text
            rows += [(doc_id, k + 1, len(ids), score, zlib.crc32(ids.astype("<u4")), same, *([ids.astype(np.int32)] if with_ids else [])) for k, (score, ids) in enumerate(best)]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names)


def read_model(model_path: str) -> bytes:
    """The driver reads the model and sends it with the tasks."""
    with open(model_path, "rb") as f:
        return f.read()


def n_best_pieces(docs: DataFrame, model_path: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document and segmentation; ids only if asked for."""
    proto = read_model(model_path)
    plain = docs.selectExpr(f"cast({id_col} as long) AS doc_id", f"cast({text_col} as string) AS text")
    return map_arrow(plain, lambda b: segment_batches(b, proto, n, with_ids), IDS if with_ids else SCHEMA)


def decode_pieces(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """rows with `decoded`, the text of their ids. Null ids, as ids that the model doesn't have, give null; no ids give an empty text."""
    proto, at = read_model(model_path), rows.columns.index(ids_col)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = segmenter_of_worker(proto, 1)
        most = len(segmenter.model.bytes_of)
        for batch in batches:
            lists = batch.column(at).to_pylist()
            out = [None if x is None or any(k is None or not 0 <= k < most for k in x) else segmenter.decode(np.array(x, dtype=np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return map_arrow(rows, decoded, StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def op6_sentencepiece_n_best(spark, sf_dir):
    import public_tokenizers

    return n_best_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
