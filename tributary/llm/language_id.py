"""Language identification by Bayesian evidence fusion.

Text: a naive Bayes likelihood over hashed byte trigrams. The languages are all that any row with letters or digits is labelled
with, counted over all rows; each is fitted on an equal share of `rows` documents, or on all it has if these are fewer, and
on 5 at least, so that rare ones are fitted at every size. A text counts as at most 100 trigrams, as neighbours depend on each other. Declared language: how often each is declared, given the
language that the text speaks for, counted over all rows. Address suffix and host: how often each language is found
there, counted over all rows without the row itself by grouped aggregation, and smoothed: a host towards its suffix, a suffix
towards all rows, by the weight of 8 rows. The posterior is the normalised product.

A row is rejected if its text has no letters or digits or its best posterior is under 0.5.

Defined results: null and empty texts have no text evidence, are rejected and get their best guess from the rest; null
declarations are no evidence; unknown declarations count as one value, `other`; null hosts and suffixes count as one
each; blank labels are none; without any labelled row there is one language, `und`, and all is rejected, but keep_identified
then drops only texts without letters or digits; repeated rows each get their row;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, lower_az, map_arrow, small_table, stash, table, without_rows
from .textnum import _LOWER, _WORD, blocks, texts

ROWS, BITS, LEAST_ROWS = 6000, 15, 5
PLACES = 1 << 40
SPAN, WEIGHT, ACCEPT = 100.0, 8.0, 0.5
TAGS = r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>"
WORDED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # a letter or digit
URL = r"(?s)^.*?://([^/?#]*)"


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-cased bytes, others than word bytes being blanks, and their texts; those of blanks only are left out."""
    x = np.where(_WORD[_LOWER[data]], _LOWER[data], 32).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    keep = code != 0x202020
    ends = offsets[1:]
    cut = np.concatenate([ends - 1, ends - 2])  # those that reach into the next text
    keep[cut[(cut >= 0) & (cut < len(keep))]] = False
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:-2]
    return ((code[keep] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), owner[keep]


def count_batches(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(languages), 1 << BITS), dtype=np.int64)
    number = {x: k for k, x in enumerate(languages)}
    for batch in batches:
        data, offsets = texts(batch.column(1))
        which = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()])
        for i, j in blocks(offsets):
            grams, owner = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for k in range(len(languages)):
                counts[k] += np.bincount(grams[which[i:j][owner] == k], minlength=1 << BITS)
    if counts.any():
        yield pa.RecordBatch.from_arrays([pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["counts"])


def share(counts: list[int], rows: int) -> int:
    """How many rows each language may give, so that `rows` are taken in all: small languages give all theirs, the others as many each."""
    left = rows
    for k, n in enumerate(sorted(counts)):
        if n * (len(counts) - k) > left:
            return max(left // (len(counts) - k), LEAST_ROWS)
        left -= n
    return max(counts)


def train(docs: DataFrame, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods of each trigram): all languages that are given to a text, from at most `rows` rows or 5 a language."""
    given = docs.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("_id"))
    given = given.filter((F.trim("_lang") != "") & F.col("_text").rlike(WORDED)).withColumn("_at", F.pmod(F.xxhash64("_id", "_text"), F.lit(PLACES)))
    counted = given.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("least")).collect()  # one row a language
    languages = sorted(r["_lang"] for r in counted)
    if not languages:
        return ["und"], np.zeros((1, 1 << BITS))
    most = share([r["n"] for r in counted], rows)
    enough = most + 6 * most**0.5 + 20  # more than `most` rows of a language lie below this part of the places
    bound = [max(r["least"], int(PLACES * min(1.0, enough / r["n"]))) for r in counted]
    bounds = small_table(docs.sparkSession, _lang=pa.array([r["_lang"] for r in counted], pa.string()), bound=pa.array(bound, pa.int64()))
    near = given.join(F.broadcast(bounds), "_lang").filter(F.col("_at") <= F.col("bound"))  # one row a language is broadcast
    first = Window.partitionBy("_lang").orderBy("_at", "_id", "_text")
    joined = near.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= most).select("_lang", "_text")
    # each task's counts are 2**15 numbers a language, so merge them by position before they leave the cluster
    parts = map_arrow(joined, lambda b: split_counts(count_batches(b, languages), len(languages)), "lang int, gram int, n long")
    merged = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), 1 << BITS))
    counts[merged["lang"], merged["gram"]] = merged["n"]
    smooth = counts + 0.5
    return languages, np.log(smooth / smooth.sum(axis=1, keepdims=True))


def split_counts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0).to_pylist():
            counts = np.frombuffer(x, "<i8").reshape(n, -1)
            lang, gram = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(gram, pa.int32()), pa.array(counts[lang, gram], pa.int64())], names=["lang", "gram", "n"])


def likelihood_batches(batches: Iterator[pa.RecordBatch], table_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with text last to rows with n (trigrams), ll (by language, of 100 trigrams at most) and guess."""
    by_gram = np.ascontiguousarray(table_.T)
    n_lang = by_gram.shape[1]
    for batch in batches:
        data, offsets = texts(batch.column(batch.num_columns - 1))
        n, ll = np.zeros(len(batch), dtype=np.int64), np.zeros((len(batch), n_lang))
        for i, j in blocks(offsets, (1 << 22) // n_lang):
            grams, owner = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n[i:j] = np.bincount(owner, minlength=j - i)
            for k in range(n_lang):
                ll[i:j, k] = np.bincount(owner, weights=by_gram[grams, k], minlength=j - i)
        ll *= np.minimum(1.0, SPAN / np.maximum(n, 1))[:, None]
        ll = np.round(ll - ll.max(axis=1, keepdims=True), 9) + 0.0
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, ll.size + 1, n_lang), pa.int32()), pa.array(ll.ravel()))
        guess = np.where(n > 0, ll.argmax(axis=1), -1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), flat, pa.array(guess, pa.int32())], names=[*batch.schema.names[:-1], "n", "ll", "guess"])


def fuse(rows: DataFrame, model: tuple[list[str], np.ndarray], ids: list[str]) -> DataFrame:
    """rows (ids..., declared, host, suffix, text) to (ids..., lang, posterior, text_lang, declared, accepted)."""
    languages, table_ = model
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ids), "declared string, host string, suffix string, n long, ll array<double>, guess int"])
    known = F.array_contains(F.array(*map(F.lit, languages)), F.col("tag"))
    tagged = rows.withColumn("tag", lower_az(F.regexp_extract(F.trim("declared"), r"^([A-Za-z]+)", 1)))
    declared = F.when(F.col("declared").isNull() | (F.trim("declared") == ""), None).when(known, F.col("tag")).otherwise("other")
    given = tagged.select(*ids, declared.alias("declared"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix"), "text")
    seen = stash(map_arrow(given, lambda b: likelihood_batches(b, table_), schema), "evidence")

    # counts of each language by host, by suffix and over all, as arrays with an element a language
    width = len(languages)
    each = F.sequence(F.lit(0), F.lit(width - 1))
    counts = lambda: F.map_from_entries(F.collect_list(F.struct("guess", "hits")))
    dense = lambda m: F.transform(each, lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0)).cast("double"))
    by_place = stash(seen.groupBy("suffix", "host", "guess").agg(F.count(F.lit(1)).alias("hits")), "places")
    hosts = by_place.groupBy("suffix", "host").agg(F.sum("hits").alias("rows"), counts().alias("m")).select("suffix", "host", "rows", dense(F.col("m")).alias("h"))
    hosts = stash(hosts, "hosts")
    suffixes = by_place.groupBy("suffix", "guess").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("places"))
    n_hosts = hosts.groupBy("suffix").agg(F.count(F.lit(1)).alias("hosts"))
    suffixes = suffixes.groupBy("suffix").agg(counts().alias("m")).join(n_hosts, "suffix").select("suffix", "hosts", dense(F.col("m")).alias("s"))
    priors = stash(join_counted(hosts, stash(suffixes, "suffixes"), ["suffix"], "hosts", hosts.count()).drop("hosts"), "priors")
    whole = {r["guess"]: r["hits"] for r in by_place.groupBy("guess").agg(F.sum("hits").alias("hits")).collect()}  # one row a language
    g = F.lit([float(whole.get(k, 0)) for k in range(width)])
    total = float(sum(n for k, n in whole.items() if k >= 0))

    values = [*languages, "other"]
    counted = {(r["guess"], r["declared"]): r["count"] for r in seen.filter("declared IS NOT NULL AND guess >= 0").groupBy("guess", "declared").count().collect()}  # languages x (languages + 1)
    spoken = [sum(counted.get((k, v), 0) for v in values) for k in range(width)]
    log_said = [[float(np.log((counted.get((k, v), 0) + 1.0) / (spoken[k] + len(values)))) for k in range(width)] for v in values]
    said = F.when(F.col("declared").isNotNull(), F.element_at(F.lit(log_said), F.array_position(F.lit(values), F.col("declared")).cast("int")))

    added = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    met = join_counted(seen, priors, ["suffix", "host"], "rows", seen.count())
    met = met.select(*ids, "declared", "n", "ll", "guess", "h", "s", said.alias("said"), (F.col("guess") >= 0).cast("double").alias("own"), added("s").alias("s_all"), added("h").alias("h_all"))

    def log_score(k):
        at = lambda x: F.element_at(x, k + 1)
        mine = (F.col("guess") == k).cast("double")  # the row's own part of the counts
        base = (at(g) - mine + 1.0) / (F.lit(total + width) - F.col("own"))
        by_suffix = (at(F.col("s")) - mine + WEIGHT * base) / (F.col("s_all") - F.col("own") + WEIGHT)
        by_host = (at(F.col("h")) - mine + WEIGHT * by_suffix) / (F.col("h_all") - F.col("own") + WEIGHT)
        return F.log(by_host) + at(F.col("ll")) + F.coalesce(at(F.col("said")), F.lit(0.0))

    names = F.lit(languages)
    scored = met.withColumn("scores", F.transform(each, lambda k: F.struct(log_score(k).alias("v"), F.element_at(names, k + 1).alias("lang")))).withColumn("best", F.array_max("scores"))
    posterior = 1.0 / F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x["v"] - F.col("best.v")))
    out = scored.select(*ids, F.col("best.lang").alias("lang"), posterior.alias("posterior"), F.when(F.col("guess") >= 0, F.element_at(names, F.greatest("guess", F.lit(0)) + 1)).alias("text_lang"), "declared", "n")
    return out.withColumn("accepted", (F.col("n") > 0) & (F.col("posterior") >= ACCEPT) & F.lit(languages != ["und"])).drop("n")


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as evidence: the lang column is what is declared, the source the host; there is no suffix."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"), F.lit("").alias("suffix"), F.col("text").cast("string").alias("text"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as evidence: the html element's lang, the url's host and its last label, the text between the tags."""
    host = lower_az(F.regexp_replace(F.regexp_extract("url", URL, 1), r"^.*@|:\d*$", ""))
    lang = F.regexp_extract("html", r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), lang.alias("declared"), host.alias("host"), F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"), F.regexp_replace("html", TAGS, " ").alias("text"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns. Each row is judged by its own text, lang and source, and rows
    are told apart by doc_id (null or not) and a 64-bit hash of these."""
    model = train(docs)
    row = lambda d: F.xxhash64(d["text"].cast("string"), d["lang"].cast("string"), d["source"].cast("string"))
    judged = fuse(document_rows(docs).withColumn("row", F.xxhash64("text", "declared", "host")), model, ["doc_id", "row"])
    rejected = "text_lang IS NULL" if model[0] == ["und"] else "NOT accepted"  # nothing to learn a language from is no reason to reject
    return without_rows(docs, judged.filter(rejected), row(docs))


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = document_rows(docs).union(page_rows(table(spark, sf_dir, "pages")))
    return fuse(rows, train(docs), ["doc_id", "page_id"])
