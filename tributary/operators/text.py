"""Texts of documents at versions, and the edits that lead from one version to another; one kernel run for each question."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..kernels.text import Merge, Op
from .graph import history_of, ints

BLOCK = 1 << 22  # characters of answers that a task holds at once


def _edits(text: pd.DataFrame) -> list[Op]:
    return [Op(int(r.lv), int(r.n), r.kind, int(r.pos), r.content, bool(r.fwd)) for r in text.itertuples()]


def _names(agents: pd.DataFrame) -> list[tuple[int, int, str, int]]:
    return [(int(a.lv_start), int(a.lv_end), a.agent, int(a.seq_start)) for a in agents.itertuples()]


def _merge(runs: pd.DataFrame, text: pd.DataFrame, agents: pd.DataFrame) -> Merge:
    return Merge(history_of(runs), _edits(text), _names(agents))


def _merges(runs: pd.DataFrame, text: pd.DataFrame, agents: pd.DataFrame) -> dict[int, Merge]:
    """A document's texts, each with its own edits, over one history."""
    history, who = history_of(runs), _names(agents)
    return {int(crdt): Merge(history, _edits(own), who) for crdt, own in text.groupby("crdt")}


#: The tables of a document in the order in which its rows come, and their columns, the questions' beside them.
PARTS = {"runs": ["start", "end", "parents"], "agents": ["lv_start", "lv_end", "agent", "seq_start"], "text": ["lv", "n", "kind", "pos", "content", "fwd"]}


def _rows(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables' rows as (doc, part, row of each table): a document's lie together, a partition's by document and table."""
    names = list(tables)
    whole = None
    for k, (name, df) in enumerate(tables.items()):
        own = F.struct(*[c for c in df.columns if c != "doc"])
        cells = [(own if n == name else F.lit(None).cast(tables[n].select(F.struct(*[c for c in tables[n].columns if c != "doc"]).alias("x")).schema["x"].dataType)).alias(n) for n in names]
        rows = df.select("doc", F.lit(k).alias("part"), *cells)
        whole = rows if whole is None else whole.union(rows)
    return whole.repartition("doc").sortWithinPartitions("doc", "part")


def _documents(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, dict[str, list[dict]]]]:
    """(doc, rows by table) of sorted rows, a document at a time."""
    doc, held = None, {n: [] for n in names}
    for batch in batches:
        columns = [batch.column(n) for n in ("doc", "part")]
        for k, (at, part) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
            if at != doc:
                if doc is not None:
                    yield doc, held
                doc, held = at, {n: [] for n in names}
            held[names[part]].append(batch.column(names[part])[k].as_py())
    if doc is not None:
        yield doc, held


def _ask(runs: DataFrame, text: DataFrame, agents: DataFrame, questions: DataFrame, answer, schema: str, build=_merge) -> DataFrame:
    """The rows that answer(merge, question) gives. A document is the unit of work, as its merge is sequential: a task holds one at a time, and of the answers
    some BLOCK characters."""
    columns = [x.split()[0] for x in schema.split(", ")]
    tables = {"runs": runs, "agents": agents, "text": text}
    tables = {n: df.select("doc", *(c for c in df.columns if c in PARTS[n] or c == "crdt")) for n, df in tables.items()} | {"questions": questions}
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = list(tables)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=arrow.field(k).type) for k in range(len(columns))], schema=arrow)

    def answered(batches):
        rows, size = [], 0
        for doc, held in _documents(batches, names):
            if not all(held[n] for n in names):
                continue
            merge = build(*(pd.DataFrame(held[t]) for t in ("runs", "text", "agents")))
            for q in held["questions"]:
                for row in answer(merge, q):
                    rows.append((doc, *row))
                    size += 64 + sum(len(x) for x in row if isinstance(x, str | list))
                    if size > BLOCK:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return _rows(tables).mapInArrow(answered, schema)


def checkouts(runs: DataFrame, text: DataFrame, agents: DataFrame, versions: DataFrame) -> DataFrame:
    """versions (doc, q, version) to (doc, q, content)."""
    return _ask(runs, text, agents, versions, lambda m, q: [(q["q"], m.checkout(ints(q["version"])))], "doc long, q long, content string")


def transformed(runs: DataFrame, text: DataFrame, agents: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (doc, q, a, b) to (doc, q, step, lv, n, kind, pos, content): the edits, in order, from the text at a to that at a and b; pos null where all was deleted before."""

    def answer(m: Merge, q: dict):
        yield from ((q["q"], step, *row) for step, row in enumerate(m.transformed(ints(q["a"]), ints(q["b"]))))

    return _ask(runs, text, agents, pairs, answer, "doc long, q long, step long, lv long, n long, kind string, pos long, content string")


def merged_branches(runs: DataFrame, text: DataFrame, agents: DataFrame, branches: DataFrame) -> DataFrame:
    """branches (doc, q, content, a, b), content the text at a, to (doc, q, content, version) after merging b."""
    return _ask(runs, text, agents, branches, lambda m, q: [(q["q"], *m.merged(q["content"], ints(q["a"]), ints(q["b"])))], "doc long, q long, content string, version array<long>")


def conflicting(runs: DataFrame, text: DataFrame, agents: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (doc, q, a, b) to (doc, q, conflicts): whether concurrent inserts meet at one place."""
    return _ask(runs, text, agents, pairs, lambda m, q: [(q["q"], m.conflicts(ints(q["a"]), ints(q["b"])))], "doc long, q long, conflicts boolean")


def embedded_checkouts(runs: DataFrame, text: DataFrame, agents: DataFrame, versions: DataFrame) -> DataFrame:
    """Texts inside documents: text also names each edit's text, `crdt`. (doc, q, crdt, content) of all of a document's texts at versions (doc, q, version)."""
    each = lambda texts, q: [(q["q"], crdt, m.checkout(ints(q["version"]))) for crdt, m in texts.items()]
    return _ask(runs, text, agents, versions, each, "doc long, q long, crdt long, content string", _merges)


def embedded_transformed(runs: DataFrame, text: DataFrame, agents: DataFrame, pairs: DataFrame) -> DataFrame:
    """As `transformed`, for all texts inside documents: (doc, q, crdt, step, lv, n, kind, pos, content)."""

    def answer(texts: dict[int, Merge], q: dict):
        for crdt, m in texts.items():
            yield from ((q["q"], crdt, step, *row) for step, row in enumerate(m.transformed(ints(q["a"]), ints(q["b"]))))

    return _ask(runs, text, agents, pairs, answer, "doc long, q long, crdt long, step long, lv long, n long, kind string, pos long, content string", _merges)


def linear_positions(pieces: DataFrame, order: str) -> DataFrame:
    """pieces (doc, ..., content) appended one after another: each one's first operation and place."""
    w = Window.partitionBy("doc").orderBy(order)
    n = F.length("content").cast("long")
    return pieces.withColumns({"n": n, "lv": F.sum(n).over(w) - n}).withColumn("pos", F.col("lv"))
