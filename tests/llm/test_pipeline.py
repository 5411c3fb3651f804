"""The pipeline against a plain version of each stage's decisions, and on odd inputs."""

import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm import brute_classes, plain_features, plain_ftrl

from tributary.llm import packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_language(docs):
    """Rows whose language a naive Bayes over character trigrams of all rows can tell: here, those with letters or digits."""
    return [r for r in docs if re.search(r"[^\W_]", r["text"] or "")]


def plain_toxicity(docs, labels, place):
    rows = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 and i in {r["doc_id"] for r in docs}]
    text_of = {r["doc_id"]: r["text"] for r in docs}
    rows.sort(key=lambda x: (place[x[0]], x[1]))
    weights = plain_ftrl([(plain_features(text_of[i]), y) for i, y in rows], 2.0, 1.0, 5.0, 4, 2.0)
    score = lambda t: 1 / (1 + math.exp(-sum(weights.get(k, 0.0) for k in plain_features(t)) - weights[None]))
    return [r for r in docs if score(r["text"]) < 0.5]


def plain_exact(docs):
    best = {}
    for r in docs:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
        rank = (-len(r["text"]), r["doc_id"])
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    return [r for _, r in best.values()]


def plain_near(docs):
    of = brute_classes([(r["doc_id"], r["text"]) for r in docs])
    return [r for r in docs if of[r["doc_id"]] == r["doc_id"]]


def plain_pack(docs, capacity=packing.CAPACITY):
    """The pieces of one shard: bins of (source, cluster) by best fit, each item into the fullest that takes it."""
    bins, out = [], Counter()
    size = lambda r: len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"])) + 1
    for r in sorted(docs, key=lambda r: (-(size(r) % capacity), r["doc_id"])):
        whole, left = divmod(size(r), capacity)
        out.update([(r["doc_id"], piece, 0, capacity) for piece in range(whole)])
        if left:
            fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= left and (r["source"] is None or r["source"] not in b["sources"])]
            if fits:
                b = bins[min(fits)[1]]
            else:
                b = {"left": capacity, "sources": set()}
                bins.append(b)
            out[r["doc_id"], whole, capacity - b["left"], left] += 1
            b["left"] -= left
            b["sources"].add(r["source"])
    return out


def test_stages_and_run(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    place = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("p")).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "minhash_dedup", "best_fit_packing"]
    plain = [plain_language, lambda rows: plain_toxicity(rows, labels, place), plain_exact, plain_near]
    at = docs
    for k, ((_, stage), keep) in enumerate(zip(corpus_pipeline.STAGES, plain, strict=False)):
        out = stage(spark, at, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert sorted(map(tuple, after.collect())) == sorted(map(tuple, keep(at.collect())))
        at = after
    assert 0 < at.count() < docs.count()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["n"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == plain_pack(at.collect())


def test_odd_rows(spark, sf):
    rows = [(1, "some words that are here", "en", "a", 1), (1, "some words that are here", "en", "a", 1), (None, None, None, None, None), (2, "", "en", "a", 0), (3, None, None, None, None), (4, "other words than those", "en", "b", 2)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("_id", F.lit(1)).withColumn("kept", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), sf).count() == 0
        assert stage(spark, docs, sf).count() >= 1
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_exact(spark, docs, sf).filter("doc_id IN (1, 4)").collect()) == [1, 4]


def test_repeated_ids_and_long_texts(spark, sf):
    # rows that share an id go or stay for their own texts; a text of 200,000 words goes through whole
    word = lambda seed: random.Random(seed).randrange(10**6)
    text = lambda seed, n=40: " ".join(f"w{word(seed)}x{k}" for k in range(n))
    rows = [(1, text(1), "en", "a", 1), (1, "--", "en", "a", 1), (1, text(2), "en", "b", 1), (2, text(1), "en", "a", 1), (3, text(2) + " more", "en", "b", 1), (4, text(4, 200_000), "en", "c", 1)]
    at = spark.createDataFrame(rows, COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
    assert sorted((r["doc_id"], r["text"]) for r in at.collect()) == sorted([(1, text(1)), (1, text(2)), (4, text(4, 200_000))])
    packed = corpus_pipeline.pack(spark, at, sf).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {1: 82, 4: 200_001}


WORKERS = """
import psutil
from pyspark.sql import SparkSession

import corpus_pipeline
from tributary.llm.common import stash, table

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = table(spark, SF, "documents")
for name, stage in corpus_pipeline.STAGES:
    docs = stash(stage(spark, docs, SF), name)
    java = next(p for p in psutil.Process().children(recursive=True) if "java" in p.name())
    print(name, len([p for p in java.children() if "python" in p.name()]), sum(len(p.children()) for p in java.children()))
"""


def test_one_python_worker_a_core(sf):
    # workers stay and keep their memory, so a core must never need two, nor a second kind of them
    out = subprocess.run([sys.executable, "-c", f"SF = {sf!r}{WORKERS}"], cwd=corpus_pipeline.__file__.rpartition("/")[0], capture_output=True, text=True, timeout=300, check=True).stdout
    assert [x.split() for x in out.splitlines()] == [[name, "1", "1"] for name, _ in corpus_pipeline.STAGES]
