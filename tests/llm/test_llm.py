"""Training-data operators: SQL twins, brute force, round trips, held-out accuracy, and odd inputs."""

import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.llm import common, components, exact_dedup, language_id, license_scan, maxscore, minhash_dedup, packing, pieces, token_store, toxicity, url_filter
from tributary.llm.registry import QUERIES, SQL

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "One two three four five six seven eight nine ten", "en", "a", 1),
    (1, "One two three four five six seven eight nine ten", "en", "a", 1),  # repeated
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "No id here", "en", "a", 1),
    (None, None, None, None, None),
    (4, "  spaces \t and\nlines \u00a0 \u2028x", "en", "b", 1),
    (5, "one  two three four five six seven eight nine ten", "en", "b", 1),
    (6, "𐆐 ünïcode ▁ <|endoftext|> \x00 nul 你好", "zz", "b", 1),
    (7, "x" * 70_000, "en", "b", 1),
    (8, "long words " * 20_000, "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    # further columns, some with the operators' inner names
    for c in ("n", "key", "count", "kind", "node", "bin", "words", "fit", "host", "score", "_id", "uid", "recipe"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, same):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, SQL[name])
    else:
        assert df.count() > 0


# --- 1 URL filter -----------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        ("http://A.com/x", "a.com", "/x", "com/", "allow"),
        ("https://m.example.com/en/1?q#f", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("ftp://b.net/es/", "b.net", "/es/", "net/es/", "block"),
        ("http://b.net/es", "b.net", "/es", None, None),
        ("http://notcom/x", "notcom", "/x", None, None),
        ("http://a.com", "a.com", "", None, None),
        ("http://a.com?x=/y", "a.com", "", None, None),
        ("http://É.ORG/p://q", "É.org", "/p://q", None, None),
        ("no scheme", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ]
    df = spark.createDataFrame([(k, u[0], "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.url_filter(df).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] == (verdict or got[k]["verdict"]) and got[k]["verdict"] in ("allow", "block")
    assert url_filter.url_filter(df.filter("false")).count() == 0
    assert url_filter.url_filter(df.union(df)).count() == 2 * len(urls)


def test_url_templates(spark):
    # numbered pages become one template; a template of blocked pages takes its unlabelled page along
    rules = [("h.org", "/a/bad", "block"), ("h.org", "/b", "allow")]
    urls = [f"http://h.org/a/bad{k}x" for k in range(20)] + [f"http://h.org/b/{k}" for k in range(20)] + ["http://h.org/a/b-ad1", "http://h.org/c/1"]
    got = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    by = {r["page_id"]: r for r in got}
    assert by[0]["template"] == "/a/bad#x" and by[0]["purity"] > 0.9 and by[20]["template"] == "/b/#" and by[20]["purity"] < 0.2
    assert by[41]["verdict"] == "allow"


def templates_brute(pages, rules):
    """Verdicts of (host, path) by plain recursion over the tree."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = lambda h, p: next((v for rh, rp, v in ordered if (h == rh or h.endswith("." + rh)) and p.startswith(rp)), None)
    out = {}

    def walk(host, prefix, group):  # group: (rest, path, verdict or None) of each page
        for _, path, _ in (x for x in group if not x[0]):
            out[host, path] = prefix
        children = {}
        for rest, path, v in group:
            if rest:
                children.setdefault(rest[0], []).append((rest[1:], path, v))
        pages_, shapes = sum(map(len, children.values())), {re.sub("[0-9]+", "#", c) for c in children}
        labels = {c: [v == "block" for _, _, v in g if v] for c, g in children.items()}
        every = [x for g in labels.values() for x in g]
        made = {}
        for c, g in children.items():
            mine, rest = labels[c], len(every) - len(labels[c])
            name = c
            if len(children) >= 3 and len(children) * 2 > pages_:
                name = re.sub("[0-9]+", "#", c) if len(shapes) * 2 <= len(children) else "*"
            elif len(mine) >= 5 and rest >= 5:
                share = sum(every) / len(every)
                if abs(sum(mine) / len(mine) - (sum(every) - sum(mine)) / rest) <= 1.96 * math.sqrt(share * (1 - share) * (1 / len(mine) + 1 / rest)):
                    name = "*"
            made.setdefault(name, []).extend(g)
        for name, g in made.items():
            walk(host, f"{prefix}/{name}", g)

    hosts = {}
    for h, p in pages:
        hosts.setdefault(h, []).append((p.split("/")[1:], p, rule(h, p)))
    for h, g in hosts.items():
        walk(h, "", g)
    known = [v == "block" for g in hosts.values() for _, _, v in g if v]
    prior = sum(known) / len(known) if known else 0.0
    of = {}
    for h, g in hosts.items():
        for _, p, v in g:
            of.setdefault((h, out[h, p]), []).append(v)
    purity = {t: (sum(v == "block" for v in vs) + 2 * prior) / (sum(v is not None for v in vs) + 2) for t, vs in of.items()}
    return {(h, p): (out[h, p], rule(h, p) or ("block" if purity[h, out[h, p]] >= 0.8 else "allow")) for h, p in pages}


def test_url_deep_paths_brute(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "join_counted", lambda rows, groups, keys, size, total: common.join_counted(rows, groups, keys, size, 0))
    monkeypatch.setattr(common, "HOT", 3)  # nearly every key is split
    rules = [("h.org", "/a/bad", "block"), ("h.org", "/b", "allow"), ("g.org", "/x/y/z/p1", "block"), ("g.org", "/x/y/z/p2", "allow")]
    r = random.Random(5)
    words = ["a", "b", "bad1", "bad2", "x", "y", "", "*", "long" * 20, "p1", "p2"]
    pages = [("h.org", "/" + "/".join(r.choice(words) for _ in range(r.randint(0, 7)))) for _ in range(150)]
    pages += [("g.org", f"/x/y/z/p{k % 3}/{k}/deep/{'same/' * 40}{k % 2}") for k in range(60)] + [("g.org", ""), ("g.org", "/"), ("g.org", "/x"), ("h.org", "/a/" + "s" * 5000)]
    pages += r.choices(pages, k=100)
    df = spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p) in enumerate(pages)], "page_id long, url string")
    want = templates_brute(pages, rules)
    for x in url_filter.url_filter(df, rules).collect():
        assert (x["template"], x["verdict"]) == want[x["host"], x["path"]]


# --- 2 exact dedup ----------------------------------------------------------------------------------------------------


def test_exact_brute(spark, odd, documents):
    for docs in (odd, documents):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
        groups: dict[str, list] = {}
        for i, t in rows:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((i, t))
        got = exact_dedup.exact_dedup(docs).collect()
        want = []
        for g in groups.values():
            best = min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
            for k, x in enumerate(sorted(g, key=lambda x: (x != best,))):
                want.append((x[0], best[0], len(g), k == 0))
        key = lambda x: tuple((v is None, v or 0) for v in x)
        assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got], key=key) == sorted(want, key=key)
    assert exact_dedup.exact_dedup(odd.filter("false")).count() == 0
    assert sum(r["kept"] for r in got) == exact_dedup.drop_copies(documents).count()


def test_exact_drop(spark, monkeypatch):
    # the row stays that is marked kept, by row and not by id; repeated rows leave one
    rows = [(1, "ab"), (1, "a  b"), (2, "ab"), (3, "c d"), (3, "c d"), (3, "cd"), (3, "other"), (None, "x"), (None, "x"), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    for bound in (500_000, 1):
        got = exact_dedup.drop_copies(docs, bound=bound)
        assert got.columns == docs.columns
        assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(repr, [(1, "a  b"), (3, "c d"), (3, "other"), (None, "x"), (4, "")]))
    monkeypatch.setattr(common, "HOT", 1)  # every group with copies is hot
    same = exact_dedup.exact_dedup(docs).collect()
    assert sorted(r["group_size"] for r in same) == [1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3] and sum(r["kept"] for r in same) == 5


def test_chunks_and_collisions(spark, documents):
    whole = documents.select(exact_dedup.normalised(F.col("text")).alias("norm"))
    assert whole.filter(F.array_join(exact_dedup.chunks(F.col("norm")), "") != F.col("norm")).count() == 0
    shifted = spark.createDataFrame([("".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=9000)),)], "norm string")
    both = shifted.union(shifted.select(F.concat(F.lit("zzz"), "norm")))
    a, b = (set(r[0]) for r in both.select(exact_dedup.chunks(F.col("norm"))).collect())
    assert len(a & b) > len(a) // 2  # an insertion moves only the chunks around it
    weak = lambda c: F.length(c).cast("long")  # noqa: E731  stands for many chunks at once
    assert not exact_dedup.verified(whole, weak)
    cols = ["doc_id", "keep_id", "group_size", "kept"]
    x, y = exact_dedup.exact_dedup(documents), exact_dedup.exact_dedup(documents, ident=weak)
    assert x.select(cols).exceptAll(y.select(cols)).isEmpty()


# --- 3 packing --------------------------------------------------------------------------------------------------------


def best_fit_brute(items, capacity):
    """Bins as plain lists, each item into the fullest that fits and has no conflict; ties to the first."""
    bins, out = [], []
    for doc, source, cluster, n in sorted(items, key=lambda x: (-(x[3] % capacity), x[0] is None, x[0] or 0, x[1] or "", x[2] or 0, x[3])):
        left = n % capacity
        if not left:
            continue
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= left and (source is None or source not in b["sources"]) and (cluster is None or cluster not in b["clusters"])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        out.append((doc, k, capacity - bins[k]["left"], left))
        bins[k]["left"] -= left
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
    return out


def test_packing_brute():
    for seed in range(60):
        r = random.Random(seed)
        items = [(k, r.choice(["a", "a", "b", "c", "d", None]), r.choice([None, r.randrange(5), 100 + k]), r.randint(1, 90)) for k in range(r.randint(0, 120))]
        got = packing.pack(items, 32)
        assert [x for x in best_fit_brute(items, 32)] == [(d, b, s, n) for d, p, b, s, n in got if n < 32]
        assert sum(x[4] for x in got) == sum(x[3] for x in items)
        for d, _, _, n in items:
            assert sorted(p for i, p, *_ in got if i == d) == list(range(-(-n // 32)))


def test_packing_odd(spark, odd):
    got = packing.best_fit(odd, capacity=64, shard=4).collect()
    want = sorted(len((t or "").split()) + 1 for _, t, *_ in ODD if not t or "\u00a0" not in t)
    total: dict = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n"]
        assert 0 < r["n"] <= 64 and r["start"] + r["n"] <= 64
    assert total[1] == 22 and total[3] == 1 and total[8] == 40_001 and len(want) == len(ODD) - 1
    assert packing.best_fit(odd.filter("false")).count() == 0
    # the bins depend on the items only; lengths may be given
    again = packing.best_fit(odd.repartition(7), capacity=64, shard=4).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    given = packing.best_fit(odd, length=F.when(F.col("doc_id") == 4, 5).when(F.col("doc_id") == 5, -1)).collect()
    assert [(r["doc_id"], r["n"]) for r in given] == [(4, 5)]


# --- 4 licence scan ---------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_license_brute(spark, odd, documents):
    extra = spark.createDataFrame([(100, "MIT License. mit license, the MIT-LICENSE", "en", "s", 1), (101, "Äpache license apache license x", "en", "s", 1), (102, "licensed under CC BY-NC 4.0 and the Apache License, Version 2.0", "en", "s", 1), (103, "submit license", "en", "s", 1)], DOCS)
    docs = odd.select(documents.columns).union(documents).union(extra)
    rows = docs.select("doc_id", "text").collect()
    got = sorted(map(repr, ([r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")] for r in license_scan.license_scan(docs).collect())))
    want = []
    for i, t in rows:
        words = WORD.findall((t or "").translate(LOW))
        places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        want.append(repr([i, len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))]))
    assert got == sorted(want)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.license_scan(extra).collect()}
    assert labels[102] == ("apache,cc-by-nc", 1.0) and labels[103] == ("", 0.0) and labels[100][0] == "mit"


def test_license_at_the_border_of_texts():
    # a text's last letters and the next one's first make no anchor of their own
    texts = ["words", "Apache License 2.0", "the last of it has no n", "c MIT License", "licensed under cc by s", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    index = license_scan.Index()
    whole = next(license_scan.scan_batches(iter([batch]), index)).to_pylist()
    alone = [next(license_scan.scan_batches(iter([batch.slice(k, 1)]), index)).to_pylist()[0] for k in range(len(texts))]
    assert whole == alone
    assert [(x["n_base"], x["base_labels"], x["score"]) for x in whole] == [(0, "", 0.0), (1, "apache", 1.0), (0, "", 0.0), (1, "mit", 1.0), (0, "", 0.0), (0, "", 0.0)]


def test_license_templates():
    index = license_scan.Index()
    for label, phrase, _ in license_scan.TEMPLATES:
        _, found = index.scan(["x", "y", *phrase.split(), "z"])
        assert found.get(label) == 1.0
    assert index.scan("permission is hereby granted to no one".split())[1].get("mit", 0) < 0.6


def test_license_frequencies_and_labels_brute(spark, documents):
    # document frequencies by plain counting; labels and scores by trying each template at each place
    r = random.Random(3)
    rows = []
    for k in range(40):
        label, text, _ = r.choice(license_scan.TEMPLATES)
        words = text.split()
        for _ in range(r.choice([0, 0, 3, len(words) // 2])):
            words[r.randrange(len(words))] = r.choice(["x", "the", "license"])
        a = r.choice([0, 0, len(words) // 3])
        rows.append((1000 + k, " ".join(["The", "start", *words[a:], "end."]), "en", "s", 1))
    docs = documents.union(spark.createDataFrame(rows, DOCS))
    texts = {x["doc_id"]: WORD.findall((x["text"] or "").translate(LOW)) for x in docs.collect()}
    words = license_scan.vocabulary()
    df, n = license_scan.document_frequencies(docs, words)
    assert n == len(texts) and df == {w: sum(w in t for t in map(set, texts.values())) for w in words}
    index = license_scan.Index(df=df, n=n)
    got = {x["doc_id"]: x for x in license_scan.license_scan(docs).collect()}
    for i, t in texts.items():
        best = {}
        for label, text, key in license_scan.TEMPLATES:
            w, key = text.split(), key.split()
            rare = sorted(set(w), key=lambda x: (-index.idf[x], -len(x), x))[: license_scan.RARE]
            at = next(k for k in range(len(w)) if w[k : k + len(key)] == key)
            for origin in range(-len(w), len(t)) if set(key) <= set(t) else ():
                stands = [0 <= origin + k < len(t) and t[origin + k] == x for k, x in enumerate(w)]
                votes = sum(ok for ok, x in zip(stands, w, strict=True) if x in rare)
                if all(stands[at : at + len(key)]) and votes * 2 >= min(license_scan.RARE, len(set(w))):
                    best[label] = max(best.get(label, 0.0), sum(stands) / len(w))
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert got[i]["labels"] == ",".join(sorted(base | best.keys())) and got[i]["score"] == pytest.approx(1.0 if base else max(best.values(), default=0.0)), i


# --- 5 toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", "toxic").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 0.01 * len(got)
    order = got.score.rank()
    n1, n0 = (got.toxic == 1).sum(), (got.toxic == 0).sum()
    assert (order[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.9


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got if r["doc_id"]} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in ODD if i}
    none = toxicity.toxicity(odd, labels.filter("false")).collect()
    assert {round(r["score"], 9) for r in none} == {0.1}
    assert toxicity.toxicity(odd.filter("false"), labels).count() == 0


def plain_ftrl(rows, alpha, beta, l1, epochs, positive):
    """FTRL-proximal, one coordinate at a time; the intercept is the coordinate None, without L1."""
    z, n = {}, {}

    def weight(k):
        if k is not None and abs(z.get(k, 0.0)) <= l1:
            return 0.0
        shrunk = z.get(k, 0.0) - (0.0 if k is None else math.copysign(l1, z[k]))
        return -shrunk * alpha / (beta + math.sqrt(n.get(k, 0.0)))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for j in order.permutation(len(rows)):
            at, y = rows[j]
            w = {k: weight(k) for k in [*at, None]}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values())))))
            g = (p - y) * (positive if y else 1.0)
            for k in w:
                old = n.get(k, 0.0)
                n[k] = old + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(old)) / alpha * w[k]
    return {k: weight(k) for k in z}


def plain_features(text):
    data, offsets = toxicity.texts(pa.array([text]))
    h = [int(x) for x in toxicity.Words(data, offsets).hashes]
    full = 1 << 64
    mixed = lambda x: int(toxicity.mix(np.array([x % full], np.uint64))[0])
    out = set(h)
    for gap, salt in ((1, 0x51ED270B), (2, 0xA5CB9243)):
        out |= {mixed(a * 3 + b + salt) for a, b in zip(h, h[gap:])}  # noqa: B905
    return {x >> (64 - toxicity.BITS) for x in out}


def test_toxicity_brute(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "toxic")
    text_of = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = [(x["doc_id"], x["toxic"]) for x in labels.collect() if zlib.crc32(str(x["doc_id"]).encode()) % 5 and x["doc_id"] in text_of]
    place = {r["doc_id"]: r["p"] for r in documents.select("doc_id", F.xxhash64("doc_id", "text").alias("p")).collect()}
    rows.sort(key=lambda x: (place[x[0]], x[1]))
    weights = plain_ftrl([(plain_features(text_of[i]), y) for i, y in rows], 2.0, 1.0, 5.0, 4, 2.0)
    for r in toxicity.toxicity(documents, labels).collect():
        s = sum(weights.get(k, 0.0) for k in plain_features(text_of[r["doc_id"]])) + weights[None]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-6)


def test_toxicity_bounds(spark, documents):
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 60)], "doc_id long, toxic int")
    known = toxicity.train(documents, labels, rows=20)
    assert (known == toxicity.train(documents, labels, rows=20)).all() and (known != toxicity.train(documents, labels, rows=40)).any()
    small = toxicity.train(documents, labels, size=4)  # no text is that short
    assert np.count_nonzero(small) == 1


# --- 6 SentencePiece --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def segmenter():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        return pieces.Segmenter(f.read(), 4)


def test_pieces_brute(segmenter):
    model, r = segmenter.model, random.Random(1)

    def every(text):
        into, _ = model.lattice(text)
        ways = {0: [0.0]}
        for end in range(1, len(text) + 1):
            ways[end] = [w + score for start, _, score in into[end] for w in ways[start]]
        return sorted(ways[len(text)], reverse=True)

    for _ in range(300):
        text = "".join(r.choice(["a", "th", "e", " ", "\n", "in", "q", "ß", "\U00010186"]) for _ in range(r.randint(1, 7)))
        got = segmenter.segment(text)
        assert [round(x, 6) for x in every((" " + text).replace(" ", pieces.BLANK))[:4]] == [round(s, 6) for s, _ in got]
        assert all(segmenter.decode(ids) == text for _, ids in got) and len({ids.tobytes() for _, ids in got}) == len(got)


def test_pieces_round_trip(spark, segmenter, odd, documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in documents.select("text").limit(50).collect():
        ids = segmenter.segment(r["text"])[0][1]
        assert segmenter.decode(ids) == r["text"] == lib.decode(ids.tolist())
    got = pieces.n_best_pieces(odd, P.path("piece_bpe_32k.model"))
    best = {r["doc_id"]: r for r in got.filter("rank = 1").collect()}
    assert best[3]["n_pieces"] == 0 and best[4]["round_trip"] and not best[6]["round_trip"] and best[7]["round_trip"]
    text_of = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    model = P.path("piece_bpe_32k.model")
    decoded = pieces.decode_pieces(pieces.n_best_pieces(documents, model).withColumn("extra", F.lit(1)), model).collect()
    assert all(r["decoded"] == text_of[r["doc_id"]] and r["n_pieces"] == len(r["ids"]) for r in decoded) and len(decoded) >= len(text_of)
    ids = spark.createDataFrame([(1, [10**6]), (2, None), (3, []), (4, [-1]), (5, [None])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in pieces.decode_pieces(ids, model).orderBy("doc_id").collect()] == [None, None, "", None, None]
    assert got.filter("rank = 1").count() == len(ODD) and pieces.n_best_pieces(odd.filter("false"), P.path("piece_bpe_32k.model")).count() == 0


def test_new_parts_are_searched_together(monkeypatch):
    proto, asked, search = pieces.read_model(P.path("piece_bpe_32k.model")), [], pieces.Model.n_best
    r = random.Random(4)
    word = lambda: "".join(r.choice(["th", "in", "er", "a", "on", "Q", ".", "ß"]) for _ in range(r.randint(1, 12)))
    texts = [" ".join(word() for _ in range(500)) + "\n" for _ in range(4)] + ["", None, "x" * 70, "\U00010186 \U00010186a 你好 ▁"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    plain = pieces.Segmenter(proto)
    want = [(k, i + 1, len(ids), score, zlib.crc32(ids.astype("<u4")), plain.decode(best[0][1]) == (t or ""), ids.tolist()) for k, t in enumerate(texts) for best in [plain.segment(t or "")] for i, (score, ids) in enumerate(best)]
    monkeypatch.setattr(pieces.Model, "n_best", lambda *x: asked.append(x[1]) or search(*x))
    for n in (len(texts), 1):  # rows a batch
        import sentencepiece

        sentencepiece.__dict__.pop("_segmenters_of_worker", None)
        got = [tuple(x.values()) for b in pieces.segment_batches((batch.slice(k, n) for k in range(0, len(texts), n)), proto, 3, True) for x in b.to_pylist()]
        assert got == want
    assert len(asked) < 600  # of about 3,000 different parts in two runs


def test_walks_are_the_search(segmenter):
    r, model = random.Random(8), segmenter.model
    parts = ["".join(r.choice(["▁", "th", "e", "in", "q", "ß", "\U00010186", "▁the", "ing", "\n", "0", "00"]) for _ in range(r.randint(1, 9))) for _ in range(2000)]
    loss, ids, ends = model.walks().best(parts)
    for k, part in enumerate(parts):
        best = model.n_best(part, 2)
        if math.isnan(loss[k]):
            assert (len(best) > 1 and best[0][0] == best[1][0]) or not all(c in model.pieces for c in part)
        else:
            assert tuple(ids[ends[k - 1] if k else 0 : ends[k]]) == best[0][1] and loss[k] == (best[0][0] - best[1][0] if len(best) > 1 else math.inf)
    assert np.isnan(loss).any() and np.isinf(loss).any() and np.isfinite(loss).any()


def test_scores_with_fractions_are_searched_one_by_one(monkeypatch):
    seg = pieces.Segmenter(pieces.read_model(P.path("piece_bpe_32k.model")))
    assert seg.model.whole
    monkeypatch.setattr(seg.model, "whole", False)
    seg.learn([[" the", " thing"]])
    assert not seg.known and not hasattr(seg.model, "_walks")


# --- 7 near duplicates ------------------------------------------------------------------------------------------------


def shingle_sets(texts):
    data, offsets = minhash_dedup.texts(pa.array(texts, pa.string()))
    return [minhash_dedup.labelled(s) for s in minhash_dedup.shingles(minhash_dedup.Words(data, offsets))]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_brute():
    r = random.Random(4)
    for _ in range(300):
        a = [r.choice("abcdefgh") * 3 for _ in range(r.randint(0, 40))]
        b = list(a)
        for _ in range(r.randint(0, 3)):
            if b:
                k = r.randrange(len(b))
                b[k : k + r.randint(0, 1)] = r.choices(["x", "y"], k=r.randint(0, 2))
        x, y = shingle_sets([" ".join(a), " ".join(b)])
        n = longest_common(x.tolist(), y.tolist())
        assert minhash_dedup.aligned(x, y) == (9 * n >= 4 * (len(x) + len(y)))


def brute_classes(rows):
    """Union-find over all pairs."""
    ids = [i for i, _ in rows]
    sets = shingle_sets([t for _, t in rows])
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets, strict=True), 2):
        if (not len(a) and not len(b)) or (len(a) and len(b) and minhash_dedup.aligned(a, b)):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return {i: root(i) for i in ids}


def test_near_brute(spark, documents):
    rows = [(r["doc_id"], r["text"] or "") for r in documents.collect()]
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_classes(documents).collect()}
    assert got == brute_classes(rows)


def test_near_chain_in_large_buckets(spark, monkeypatch):
    # a family of copies of copies, whose ends are unlike; small blocks, so that the block comparison runs
    monkeypatch.setattr(minhash_dedup, "PAIRED", 4)
    monkeypatch.setattr(minhash_dedup, "SIDE", (3, 5))
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(60):
        rows.append((k, " ".join(words)))
        words = list(r.choice(rows)[1].split())
        words[r.randrange(120)] = f"n{k}"
    rows += [(100 + k, " ".join(f"u{r.randrange(10**6)}" for _ in range(50))) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in minhash_dedup.near_classes(docs).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("n, shared, m", [(4, 4, 5), (9, 8, 9), (8, 8, 10), (12, 12, 15), (16, 16, 20), (29, 28, 34)])
def test_near_sketches_meet_at_every_length(n, shared, m):
    # pairs of similarity 0.8 or little more, equal at one end: a chance of at most 4 in 10,000 that no sketch is shared
    r, pairs = random.Random(n * 100 + m), 4000
    rows = []
    for _ in range(pairs):
        words = [f"w{r.randrange(10**9)}" for _ in range(shared + 4)]
        rows += [" ".join(words + [f"x{r.randrange(10**9)}" for _ in range(x - shared)]) for x in (n, m)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(rows)], names=["doc_id", "mark", "text"])
    found = next(minhash_dedup.sketch_batches(iter([batch])))
    assert found.column("n").to_pylist() == [n, m] * pairs
    bands = [set(x) for x in found.column("bands").to_pylist()]
    assert sum(a.isdisjoint(b) for a, b in zip(bands[::2], bands[1::2], strict=True)) <= 5  # 1.6 expected at most


def test_near_odd(spark, odd):
    got = [(r["doc_id"], r["class_id"], r["kept"]) for r in minhash_dedup.near_classes(odd).collect()]
    assert len(got) == len(ODD)
    by = {i: (c, k) for i, c, k in got if i is not None}
    assert by[1] == (1, True) and by[5] == (1, False) and by[2] == (2, True) and by[3] == (2, False)
    assert all(c is None and k for i, c, k in got if i is None)
    assert minhash_dedup.near_classes(odd.filter("false")).count() == 0


def test_near_rows_of_one_id(spark, monkeypatch):
    # rows are judged by their own texts: B's only text stays, C's copies under one id stay together
    monkeypatch.setattr(common, "HOT", 1)
    text = lambda seed: " ".join(f"w{random.Random(seed).randrange(10**6) + k}" for k in range(30))
    rows = [(3, text(1)), (5, text(1)), (5, text(2)), (7, text(3)), (7, text(3)), (8, text(3) + " more"), (9, text(4)), (3, text(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in minhash_dedup.near_classes(docs).collect())
    assert got == [(3, 3, True), (3, 3, True), (5, 3, False), (5, 5, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 3, False)]
    left = minhash_dedup.drop_near_copies(docs.withColumn("row", F.lit("clash")))
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted([(3, text(1)), (3, text(4)), (5, text(2)), (7, text(3)), (7, text(3))])


def test_components(spark):
    r = random.Random(2)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    got = {x["node"]: x["comp"] for x in components.components(spark.createDataFrame([x for x in links if x[0] != x[1]], "a long, b long")).collect()}
    up = {x: x for pair in links for x in pair}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert all(got[k] == root(k) for k in got)


# --- 8 MaxScore -------------------------------------------------------------------------------------------------------


def test_max_score_brute(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 40)
    monkeypatch.setattr(maxscore, "BLOCK", 3)
    r = random.Random(6)
    rows = [(k, [r.choice([r.gauss(0, 1), 0.0, 0.5]) for _ in range(8)]) for k in range(300)]
    rows += [(1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8), (1003, [1.0, 2.0]), (None, [0.0] * 8), (1004, [math.inf] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(tuple(x) for x in maxscore.max_score(df, every=10, k=7).collect())
    good = {i: [math.floor(1024 * x) for x in v] for i, v in rows[:300]}
    want = []
    for q in range(0, 300, 10):
        best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert maxscore.max_score(df.filter("false")).count() == 0
    assert maxscore.max_score(df.filter("vec_id IN (0, 1)"), every=10).count() == 1


def test_max_score_wide(spark, monkeypatch):
    # components of any finite size, as candidates and as queries, with exact sums
    monkeypatch.setattr(maxscore, "SHARD", 40)
    r = random.Random(12)
    rows = [(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(100)]
    for k, size in enumerate((131072.0, -200000.5, 5e5, 1e7, -1e9, 2.0**43 + 1, 1e15 + 1, -1e15, 2.0**53 + 2, 3e38, -3e38, 1.7e308, -1.7e308, 1.6e308)):
        rows += [(200 + 10 * k, [size, 1.0, 0.5, -2.0]), (201 + 10 * k, [size, 1.0 + k, 0.25, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in maxscore.max_score(df, every=10, k=7).collect())
    good = {i: [int(Fraction(x) * 1024 // 1) for x in v] for i, v in rows}
    want = []
    for q in (i for i in good if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:7]
        want += [(q, k + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_max_score_ties_and_repeats(spark, monkeypatch):
    # many equal scores at rank k, in different shards; ids with several rows; thresholds from a seed shard
    monkeypatch.setattr(maxscore, "SHARD", 50)
    monkeypatch.setattr(maxscore, "STEP", 2)
    r = random.Random(21)
    rows = [(k, [float(r.choice([0, 1, 2])) for _ in range(5)]) for k in range(400)]
    rows += [(20, rows[20][1]), (20, [2.0] * 5), (7, [2.0] * 5), (7, [2.0] * 5), (0, [0.0] * 5)]
    got = sorted(tuple(x) for x in maxscore.max_score(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10, k=6).collect())
    want = []
    for q in range(0, 400, 10):
        asked = {tuple(v) for i, v in rows if i == q}
        best = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(x, v, strict=True)), i) for x in asked for i, v in rows if i != q)[:6]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_max_score_prunes():
    # a few strong dimensions: with a threshold the others are non-essential, and only posted candidates are scored
    r = np.random.default_rng(3)
    shard = r.integers(-5, 6, (16, 1000)).astype(np.float64)
    shard[:2] = np.where(r.random((2, 1000)) < 0.1, r.integers(500, 1000, (2, 1000)), 0)
    query = np.ones(16)
    every = query @ shard
    least = np.sort(every)[-10]
    postings = maxscore.Postings(np.arange(1000), shard)
    asked = []
    probed = postings.probed
    postings.probed = lambda *x: asked.append((len(x[1]), len(x[2]))) or probed(*x)
    at, scores = postings.best(query, -1, 10, int(least))
    assert sorted(at.tolist()) == np.flatnonzero(every >= least).tolist() and (scores == every[at]).all()
    assert asked and asked[0][0] >= 10 and asked[0][1] < 100
    assert len(postings.best(query, -1, 10, int(every.max()) + 100)[0]) == 0


# --- 9 token store ----------------------------------------------------------------------------------------------------


def test_perfect_hash():
    for n in (0, 1, 2, 7, 1000, 5000):
        keys = np.array(random.Random(n).sample(range(-(10**9), 10**9), n), dtype=np.int64)
        seeds, slots = token_store.perfect_hash(keys)
        assert sorted(slots.tolist()) == list(range(n))
        if n:
            assert (token_store.slot_of(keys, seeds[token_store.bucket_of(keys, len(seeds))], n) == slots).all()


def test_token_files(spark, odd, documents, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for name, docs in (("odd", odd), ("all", documents), ("none", odd.filter("false"))):
        path = f"file://{tmp_path}/{name}"
        token_store.write_tokens(docs, path, P.path("byte_bpe_50k.json"), shards=3)
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text")).collect()
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
        want, start = [], 0
        for i, t, _ in rows:
            ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = sorted((tuple(r) for r in token_store.read_digests(spark, path).collect()), key=lambda x: x[1])
        assert got == want
    ids_of = lambda t: [*lib.encode(t or "", add_special_tokens=False).ids, 2]
    some = [(r["doc_id"], ids_of(r["text"])) for r in documents.select("doc_id", "text").limit(90).collect()]
    for part in (some[:3], some):
        found = token_store.lookup(spark, f"file://{tmp_path}/all", [i for i, _ in part] + [10**12, -5])
        assert sorted((r["doc_id"], r["ids"]) for r in found.collect()) == sorted(part)
    found = token_store.lookup(spark, f"file://{tmp_path}/odd", [1, 2])
    assert sorted((r["doc_id"], r["ids"]) for r in found.collect()) == sorted([(1, ids_of(ODD[0][1]))] * 2 + [(2, [2])])
    assert token_store.lookup(spark, f"file://{tmp_path}/odd", []).count() == 0


@pytest.mark.parametrize("name", ["offsets", "seeds", "prints"])
def test_token_index_is_what_is_read_by(spark, documents, tmp_path, name):
    token_store.write_tokens(documents, f"file://{tmp_path}/a", P.path("byte_bpe_50k.json"), shards=1)
    good = sorted(map(tuple, token_store.read_digests(spark, f"file://{tmp_path}/a").collect()))
    # one number of the index is off by one
    bent = token_store.read_shards(spark, f"file://{tmp_path}/a").withColumn(name, F.concat(F.unhex(F.lit("01")), F.substring(name, 2, 1 << 30)))
    bent = bent.withColumn(name, F.when(F.lit(name == "offsets"), F.concat(F.unhex(F.lit("0700000000000000")), F.substring(name, 9, 1 << 30))).otherwise(F.col(name)))
    bent.write.parquet(f"file://{tmp_path}/b")
    try:
        bad = sorted(map(tuple, token_store.read_digests(spark, f"file://{tmp_path}/b").collect()))
    except Exception as e:
        assert "doesn't lead to all of its documents" in str(e)
    else:
        assert bad != good


def test_pieces_of_texts_are_whole_texts(documents):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = token_store.Encoder(f.read(), 2)
    r = random.Random(9)
    for _ in range(500):
        text = "".join(r.choice([" ", "  ", "\n", "a", "It's", " x", "\t", "\u00a0", "1", "!", "é", "<|endoftext|>", "\u2028", "\x1c", "\0"]) for _ in range(r.randint(0, 12)))
        ids = encoder.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == ids == np.frombuffer(encoder.encode(text), "<u2").tolist()


def test_new_words_are_encoded_together(monkeypatch):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = token_store.Encoder(f.read(), 2)
    asked, packed = [], encoder.packed
    monkeypatch.setattr(encoder, "packed", lambda x: asked.extend(x) or packed(x))
    text = "".join(f"w{k}é.\n{k}x, " for k in range(1000)) + "end"
    want = encoder.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u2").tolist() == want and len(asked) < 100
    asked.clear()
    assert np.frombuffer(encoder.encode(text), "<u2").tolist() == want and len(asked) == 1  # the first word


def test_texts_are_encoded_in_batches(monkeypatch):
    monkeypatch.setattr(token_store, "TEXTS", 40)
    monkeypatch.setattr(token_store, "PIECES", 9)
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = token_store.Encoder(f.read(), 2)
    r = random.Random(5)
    some = [" ", " ", "  ", "\n", "a", "It's", "Ġ", "Ġa", "\t", "\u00a0", "1", "é", "<|endoftext|>", "你好", "x" * 70]
    for _ in range(200):
        texts = [r.choice([None, "".join(r.choice(some) for _ in range(r.randint(0, 14)))]) for _ in range(r.randint(0, 30))]
        got = [np.frombuffer(x, "<u2").tolist() for x in token_store.encoded(encoder, pa.array(texts, pa.string()))]
        assert got == [encoder.library.encode(x or "", add_special_tokens=False).ids for x in texts]


# --- 10 language ID ---------------------------------------------------------------------------------------------------


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fitted = language_id.train(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    held = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    got = language_id.fuse(language_id.document_rows(held.withColumn("lang", F.lit(None).cast("string"))), fitted, ["doc_id"]).join(held.select("doc_id", F.col("lang").alias("is")), "doc_id").toPandas()
    assert (got.lang == got["is"]).mean() > 0.99 and got.accepted.mean() > 0.99


def test_language_fusion(spark):
    # the same short text is decided by what is declared, and by what its host speaks
    rng = random.Random(3)
    word = {"en": ["the", "and", "with"], "de": ["und", "der", "nicht"]}
    train = [(k, " ".join(rng.choices(word[x], k=30)), x, "h", 1) for k, x in enumerate(["en", "de"] * 20)]
    model = language_id.train(spark.createDataFrame(train, DOCS))
    rows = [(k, None, x, f"{x}.host", "net", " ".join(rng.choices(word[x], k=9))) for k, x in enumerate(["en", "de"] * 40)]
    rows += [(900, None, None, "de.host", "net", "zz qq"), (901, None, None, "en.host", "net", "zz qq"), (902, None, "de-DE", "x", None, "zz qq"), (903, None, "EN", None, None, "zz qq"), (904, None, "fr", None, None, "")]
    got = {r["doc_id"]: r for r in language_id.fuse(spark.createDataFrame(rows, "doc_id long, page_id long, declared string, host string, suffix string, text string"), model, ["doc_id", "page_id"]).collect()}
    assert [got[k]["lang"] for k in (900, 901, 902, 903)] == ["de", "en", "de", "en"]
    assert got[904]["declared"] == "other" and not got[904]["accepted"] and all(got[k]["lang"] == rows[k][2] for k in range(80))


def test_language_posterior_brute(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 2)
    rng = random.Random(11)
    word = {"en": ["the", "and", "with", "so"], "de": ["und", "der", "nicht", "so"], "fr": ["le", "et", "avec", "so"]}
    langs = sorted(word)
    train = [(k, " ".join(rng.choices(word[x], k=20)), x, "h", 1) for k, x in enumerate(langs * 10)]
    model = language_id.train(spark.createDataFrame(train, DOCS))
    rows = [(k, rng.choice([None, "en", "DE-at", "xx", " "]), rng.choice(["a", "b", None]), rng.choice(["net", None]), rng.choice([None, "", "?", " ".join(rng.choices(word[rng.choice(langs)], k=rng.randint(1, 6)))])) for k in range(80)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, declared string, host string, suffix string, text string")
    got = sorted(((r["doc_id"], r["lang"], round(r["posterior"], 7), r["accepted"]) for r in language_id.fuse(df, model, ["doc_id"]).collect()), key=repr)

    def evidence(text):
        data, offsets = language_id.texts(pa.array([text or ""]))
        grams, _ = language_id.trigrams(data, offsets)
        ll = [sum(model[1][k][g] for g in grams.tolist()) * min(1.0, 100 / max(len(grams), 1)) for k in range(3)]
        return len(grams), [round(x - max(ll), 9) for x in ll]

    seen = []
    for i, d, h, s, t in rows:
        n, ll = evidence(t)
        d = None if d is None or not d.strip() else {"en": "en", "DE-at": "de"}.get(d, "other")
        seen.append((i, d, h or "", s or "", n, ll, ll.index(max(ll)) if n else -1))
    want = []
    for j, (i, d, h, s, n, ll, guess) in enumerate(seen):
        others = [x for k, x in enumerate(seen) if k != j and x[6] >= 0]
        count = lambda k, place: sum(x[6] == k and place(x) for x in others)  # noqa: E731, B023
        score = []
        for k in range(3):
            prior = (count(k, lambda x: True) + 1) / (len(others) + 3)
            prior = (count(k, lambda x: x[3] == s) + 8 * prior) / (sum(x[3] == s for x in others) + 8)  # noqa: B023
            prior = (count(k, lambda x: x[3] == s and x[2] == h) + 8 * prior) / (sum(x[3] == s and x[2] == h for x in others) + 8)  # noqa: B023
            speak = [x for x in seen if x[6] == k and x[1] is not None]
            said = 0.0 if d is None else math.log((sum(x[1] == d for x in speak) + 1) / (len(speak) + 4))
            score.append(math.log(prior) + ll[k] + said)
        p = [math.exp(x) for x in score]
        best = max(range(3), key=lambda k: (score[k], langs[k]))
        want.append((i, langs[best], round(p[best] / sum(p), 7), n > 0 and p[best] / sum(p) >= 0.5))
    assert got == sorted(want, key=repr)


def test_language_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "words", "en", "a", 1), (1, "--", "en", "a", 1), (None, "??", "en", "a", 1), (None, "words", "en", "a", 1)], DOCS)
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in language_id.keep_identified(docs).collect()))) == sorted(map(repr, [(1, "words"), (None, "words")]))


def test_language_odd(spark, odd):
    got = language_id.fuse(language_id.document_rows(odd), language_id.train(odd), ["doc_id"])
    by = {r["doc_id"]: r["accepted"] for r in got.collect()}
    assert got.count() == len(ODD) and not by[2] and not by[3]
    assert not any(r["accepted"] for r in language_id.fuse(language_id.document_rows(odd), language_id.train(odd.filter("false")), ["doc_id"]).collect())
    assert language_id.fuse(language_id.document_rows(odd.filter("false")), language_id.train(odd), ["doc_id"]).count() == 0
    pages = spark.createDataFrame([(1, "https://u@A.de:80/x", '<HTML class=a lang="DE-at"><script>var x="<p>"</script><p>und</p>'), (2, None, None)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in language_id.page_rows(pages).collect()}
    assert (rows[1]["declared"], rows[1]["host"], rows[1]["suffix"], rows[1]["text"].split()) == ("DE-at", "a.de", "de", ["und"])


def test_language_rare_and_small(spark):
    rng = random.Random(7)
    word = {"en": ["the", "and", "with"], "de": ["und", "der", "nicht"], "fi": ["joka", "mutta", "kanssa"]}
    row = lambda k, x: (k, " ".join(rng.choices(word[x], k=30)), x, "h", 1)
    # a language with a share of 0.2 % in a table far larger than the sample
    rows = [row(k, "fi" if k % 500 == 0 else "de" if k % 3 == 0 else "en") for k in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.train(docs, rows=60)
    assert model[0] == ["de", "en", "fi"]
    got = {r["doc_id"]: (r["lang"], r["declared"]) for r in language_id.fuse(language_id.document_rows(docs), model, ["doc_id"]).collect()}
    assert all(got[r[0]] == (r[2], r[2]) for r in rows)
    # fewer than 5 rows a language, one of them without doc_id; no labels at all
    few = spark.createDataFrame([row(1, "en"), row(2, "de"), row(3, "en"), row(None, "fi"), (4, "--", "en", "h", 1), (5, None, "xx", "h", 1)], DOCS)
    assert language_id.train(few)[0] == ["de", "en", "fi"]
    assert {r["doc_id"] for r in language_id.keep_identified(few).collect()} == {None, 1, 2, 3}
    bare = few.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in language_id.keep_identified(bare).collect()} == {None, 1, 2, 3}


def test_language_shares():
    assert language_id.share([10, 10**6, 10**6], 6000) == 2995 and language_id.share([3, 4], 6000) == 4
    assert language_id.share([10**6] * 5000, 6000) == language_id.LEAST_ROWS
