"""Operators for training data: brute force, exact round trips, held-out accuracy, and defined edge cases."""

import collections
import gzip
import io
import itertools
import math
import os
import sys
import uuid
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from check import TABLES, compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from tablemirror.llm import (  # noqa: E402
    components, decontaminate, hmm, html_text, licenses, minhash, packing, topk, toxicity, urls, warc)
from tablemirror.llm.queries import LLM_ORACLES, LLM_QUERIES  # noqa: E402
from tablemirror.plans.registry import scratch  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LONG = " ".join(f"word{i % 977} under" for i in range(30_000))
ROWS = [(1, "Released under the MIT License.\nAll rights reserved."), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, "one two"),
        (6, "one two"), (None, "no id at all but some words here"), (7, "İK ÀB\u2003 <|endoftext|> 漢字 \U0001F600 cc by-nc"), (8, "one two")]
CLASH = ("score", "labels", "_text", "_key", "_id", "n_words", "kept", "component_id", "length", "piece", "_row", "url", "html")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns of clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, name, LLM_QUERIES[name], LLM_ORACLES[name], SMALL).startswith("ok")


def python_words(text):
    import re
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


# License scan

def test_license_edges(spark, odd, none):
    got = [r.asDict() for r in licenses.scan_licenses(odd).collect()]
    assert len(got) == len(ROWS) and licenses.scan_licenses(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_base"] == 1 and by[1]["first_word"] == by[1]["last_word"] == 1
    assert by[1]["base_labels"] == "mit" and by[1]["labels"] == "all-rights-reserved,mit" and by[1]["score"] == 1
    assert by[2]["n_words"] == 0 and by[2]["first_word"] is None and by[2]["labels"] == "" and by[2]["score"] == 0
    assert by[7]["base_labels"] == "cc-by-nc"
    assert all(by[i]["n_words"] == len(python_words(t)) for i, t in ROWS)


def test_license_places_across_blocks(spark):
    phrase, filler = "under the mit license".split(), "x"
    for at in (0, 1, 126, 127, 128, 129, 254, 255, 256, 380, 500, 508):
        words = [filler] * 512
        words[at:at + 4] = phrase
        r = licenses.scan_licenses(spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")).first()
        assert (r["n_base"], r["first_word"], r["last_word"], r["n_words"]) == (1, at, at, 512)


def test_license_template_containment(spark):
    words = dict(licenses.TEMPLATES)["isc"].split()
    rows = [(1, " ".join(words)), (2, " ".join(words[:len(words) // 2])), (3, "x " * 100 + " ".join(reversed(words)) + " y" * 300)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1] == got[3] == "isc" and got[2] == ""


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, yes.</div>
<div id="wrap"><div class="content"><h1>Head &amp; line</h1><p>First, <b>bo</b>ld para&shy;graph&nbsp;with   space,<br>broken.<p>Second &lt;p&gt;, unclosed
<ul><li>item one</li><li>item two</ul><form><p>Your mail, please</p></form></div>
<aside>Other, things, here, with, many, commas, to, score, high, really, high</aside><div class="ad">Buy, buy, buy</div>
<section class="comments"><p>I, as a reader, disagree, strongly, with, this, all, of, it</p></section></div>
<footer>&copy; Site</footer></body></html>"""


def test_html_page():
    assert html_text.main_text(PAGE) == ("Head & line First, bold para\xadgraph with space, broken. Second <p>, unclosed "
                                         "item one item two")


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<nav><a>x</a></nav>", ""), ("plain text, only", "plain text, only"), ("<p>a<p>b</i>c", "a bc"),
    ("<p>x<script>bad()", "x"), ("<article><p>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<p>a &unknown; &#x41;&#66;</p>< p>", "a &unknown; AB < p>"), ("<div hidden><p>h</p></div><p>seen</p>", "seen"),
    ("<body class=menu><article><header><h1>H</h1></header><p>t</p></article></body>", "H t")])
def test_html_cases(page, text):
    assert html_text.main_text(page) == text


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (None, "u", "<p>é\U0001F600</p>")],
                                  "page_id long, url string, html string").select("*", F.lit(1).alias("text"), F.lit(2).alias("_key"))
    got = html_text.extract_main_text(pages).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


# Packing

def test_packing(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(odd, with_ids=True).collect()
    assert packing.pack(none).count() == 0
    texts = collections.Counter()
    for i, t in ROWS:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [2]
        for n, (start, length) in enumerate(packing.pieces_of(len(ids), 1024)):
            part = ids[start:start + length]
            texts[i, n, start, length, zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert texts == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["_ids"])) for r in got)
    assert_packed(got)


def assert_packed(rows, capacity=1024, slack=1.05):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in groups.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(groups) <= math.ceil(sum(r["length"] for r in rows) / capacity) * slack + 1


def test_packing_plan_against_best_fit():
    rng = np.random.default_rng(3)
    for shape in (rng.integers(1, 1024, 3000), rng.exponential(200, 3000).astype(int) % 1023 + 1, np.full(1000, 3), np.full(99, 513)):
        counts = collections.Counter(int(x) for x in shape)
        plan = packing.plan_rounds(counts, 1024)
        placed, fill = collections.Counter(), collections.defaultdict(list)
        for length, first, n, sequence, offset in plan:
            placed[length] += n
            for i in range(n):
                fill[sequence + i].append((offset, length))
        assert placed == counts
        for parts in fill.values():
            assert all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(sorted(parts))) and sum(x for _, x in parts) <= 1024
        gaps = []       # sequential best-fit decreasing
        for x in sorted(shape.tolist(), reverse=True):
            fits = [g for g in gaps if g >= x]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - x)
            else:
                gaps.append(1024 - x)
        assert len(fill) <= len(gaps) * 1.01 + 1


def test_encoders_agree():
    encode = packing.Encoder("byte_bpe_50k")
    encode("漢字")
    for code in (*range(0x250), *range(0x2010, 0x2028)):
        text = f"a{chr(code)}b 1{chr(code)}2 {chr(code)}  {chr(code)}{chr(code)}'s\n\n x"
        assert encode.fast.encode_ordinary(text) == encode.exact.encode(text, add_special_tokens=False).ids


def test_long_runs_of_white_space():
    encode = packing.Encoder("byte_bpe_50k")
    for text in (" " * 2_000_000, "\n" * packing.RUN, "a" * 300_000, " " * (packing.RUN - 1) + "x  y", "a b\n" * 9000 + "\t" * 50_000 + "z"):
        got = encode(text)
        encode("漢字")
        assert got == encode.exact.encode(text, add_special_tokens=False).ids


# Top k

def test_top_k(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 6)) * rng.exponential(1, (700, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(1000 + i, [0.5, -0.25, 0.1, 0.0, 0.3, 0.2]) for i in range(400)]
    rows += [(2000, None), (2050, [1.0, None, 2.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, [1.0] * 6), (2200, []),
             (50, [float(x) for x in base[50]]), (2250, [0.0] * 6), (2300, [0.4, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("_v", F.lit(2))
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
               if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for settings in ({}, {"bucket_rows": 40, "query_rows": 7}):
        got = collections.defaultdict(list)
        for r in topk.top_k(df, **settings).collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        for q in {i for i, _ in vectors if i % 50 == 0}:
            for own in [v for i, v in vectors if i == q][:1]:
                best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in vectors if i != q)[:5]
                if q != 50:
                    assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0)).count() == 0


# URLs

def test_url_filter(spark):
    known = ["https://a.example.org/es/1", "https://example.org/en/12", "http://EXAMPLE.org/en/2", "http://x.com/fr/", "http://x.com/de/a",
             "https://notexample.org?x", "http://org/", "ftp://y.net/a?b#c", None, "", "no scheme", "http://", "http://x.com" + "/a" * 5000,
             "http://u:p@h.com:80/fr/x", "a://b://c/d", "http://x\n.com/de/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(known)] + [(0, known[0])], "page_id long, url string").withColumn("host", F.lit(1))
    got = urls.url_filter(df).collect()
    assert len(got) == len(known) + 1
    for r in got:
        u = known[r["page_id"]] or ""
        host = path = ""
        if "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = rest[:cut].lower(), rest[cut:]
            path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(s + p), s + p, v) for v, s, p in urls.RULES if (host == s or host.endswith("." + s)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else ("block" if r["block_score"] >= 0.5 else "allow"))
    assert urls.url_filter(df.limit(0)).count() == 0


def test_url_model_tells_hosts_apart(spark):
    bad, good = ["casino-spins", "cheap-pill-shop", "spam-farmers"], ["city-museum", "open-library", "thorne"]
    df = spark.createDataFrame([(i, f"http://www.{h}.example.net/en/5") for i, h in enumerate(bad + good)], "page_id int, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.url_filter(df).collect()}
    assert [got[i] for i in range(6)] == ["block"] * 3 + ["allow"] * 3


# Near duplicates

def brute_components(rows, size, percent):
    sets, same = {}, collections.defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else [])
    for i, s in sets.items():
        same[s].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = [s for s in same if s]
    for s in nodes:
        for i in same[s]:
            parent[find(i)] = find(same[s][0])
    for a, b in itertools.combinations(nodes, 2):
        if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
            n = len(a & b)
            if 100 * n >= percent * (len(a) + len(b) - n):
                parent[find(same[a][0])] = find(same[b][0])
    least = {}
    for i in sorted(sets):
        least.setdefault(find(i), i)
    return {i: (len(sets[i]), least[find(i)]) for i in sets}


@pytest.mark.parametrize("size,percent,block", [(3, 85, 512), (3, 85, 16), (5, 80, 512)])
def test_near_duplicates(spark, size, percent, block):
    rng = np.random.default_rng(11)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    seed = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    for i in range(70):     # a group of near copies at all distances, larger than a block
        words = list(seed)
        for at in rng.integers(0, 150, i % 9):
            words[at] = f"n{rng.integers(0, 10**6)}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, "Two words"), (20_001, "two  WORDS"), (20_002, ""), (20_003, None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent, block=block).collect()}
    assert got == brute_components(rows, size, percent)


def test_near_duplicate_edges(spark, odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS) and minhash.near_duplicates(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[8]["component_id"] == 6 and not by[8]["kept"] and by[6]["kept"] and by[None]["kept"]
    assert by[2]["n_shingles"] == by[4]["n_shingles"] == 0 and by[2]["component_id"] == 2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}}


# Decontamination

def test_decontamination(spark, odd, none):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    bench = spark.read.parquet(f"{MIDDLE}/benchmark.parquet")
    items = {r["item_id"]: python_words(r["text"]) for r in bench.collect()}
    exact, got = set(), set()
    texts = {r["doc_id"]: " ".join(python_words(r["text"])) for r in docs.select("doc_id", "text").collect()}
    for d, t in texts.items():
        exact |= {(d, i) for i, w in items.items() if f" {' '.join(w)} " in f" {t} "}
    for slice_chars in (decontaminate.SLICE_CHARS, 3000):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, bench, slice_chars=slice_chars).collect()}
        assert got == exact
    assert decontaminate.contamination(odd, bench).count() == 0 and decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_decontamination_of_changed_passages(spark):
    rng = np.random.default_rng(2)
    words = [f"k{x}" for x in rng.integers(0, 10**6, 60)]
    noise = [f"z{x}" for x in rng.integers(0, 10**6, 300)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "short one"), (4, " ".join(noise[:3]))], "item_id long, text string")
    one, many = list(words), list(words)
    one[30] = "changed"
    for at in range(0, 60, 6):
        many[at] = f"c{at}"
    docs = spark.createDataFrame([(1, " ".join(noise[:100] + one + noise[100:])), (2, " ".join(noise + many)),
                                  (3, ", ".join(words).upper()), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    assert set(got) == {1, 3} and got[1]["first_word"] == 100 and got[1]["n_words"] == 60 and got[3]["similarity"] == 1
    # The same when a text's windows are taken in short stretches.
    assert {r["doc_id"]: r for r in decontaminate.contamination(docs, bench, stretch=7).collect()} == got


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(4)
    items = [(str(i), rng.integers(0, 2**63, 20).astype(np.uint64)) for i in range(12)]
    index = decontaminate.Index(items, lambda s: np.ones(len(s)), 27)
    flips = rng.random((4000, 64)) < rng.random((4000, 1)) * 0.6
    prints = np.packbits(np.unpackbits(index.prints[rng.integers(0, 12, 4000)], axis=1) ^ flips, axis=1)
    distance = np.bitwise_count(prints[:, None] ^ index.prints[None]).sum(axis=2)
    assert {(a, b) for a, b, _ in index.near(prints)} == set(zip(*np.nonzero(distance <= 27)))


# Toxicity

def test_toxicity_held_out(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.toxicity(docs, labels, model=model).join(labels, "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    order = np.argsort(np.argsort(s + np.random.default_rng(0).random(len(s)) * 1e-9))
    auc = (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / y.sum() / (len(y) - y.sum())
    assert auc > 0.93 and y[s >= 0.7].mean() > 0.95 and (s[y == 1] >= 0.7).mean() > 0.75
    got = {r["doc_id"]: r for r in toxicity.toxicity(odd, labels, model=model).collect()}
    assert got[2]["score"] == got[3]["score"] == model.rate and got[2]["predicted"] == 0 and got[None]["held_out"] is False
    empty = labels.limit(0)
    assert [r["score"] for r in toxicity.toxicity(odd, empty).collect()] == [0.0] * len(ROWS)
    assert toxicity.toxicity(none, labels).count() == 0


def test_toxicity_examples_once_per_id(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(ids[0], f"text {i}", 1.0) for i in range(300)] + [(i, f"other {i}", 1.0) for i in ids[1:]]
                                 + [(None, "no id", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] * 2 + [(ids[0], 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 20_000).collect()
    assert sorted(r["_id"] for r in got) == ids
    assert {r["_id"]: (r["_text"], r["_y"]) for r in got}[ids[0]] == ("text 0", 1)


def test_block_max_index_is_exact():
    rng = np.random.default_rng(9)
    vectors = []
    for i in range(900):
        terms = rng.choice(40, rng.integers(1, 6), replace=False)
        w = rng.random(len(terms)) + 0.1
        vectors.append(({**{int(t): float(x) for t, x in zip(terms, w / np.linalg.norm(w))}, 40: 0.0}, i, 1, int(i % 2)))
    index = toxicity.BlockMaxIndex.build(vectors, 41)
    for q in range(60):
        query = vectors[q * 7][0]
        at, cosine = index.nearest(query, 15)
        full = np.array([sum(query.get(t, 0) * np.float32(x) for t, x in v[0].items()) for v in vectors])
        best = sorted((-round(c, 6), i) for i, c in enumerate(full) if c > 1e-9)[:15]
        assert np.allclose(cosine, [-c for c, _ in best], atol=1e-5)


# WARC

def test_warc_round_trip(spark):
    page = "<p>é" + "x" * 120 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(5, "http://a/ b\nc", page), (3, None, page), (9, "http://c", page), (9, "http://c", page), (None, "http://d", page), (7, "u", None),
            (8, "u", ""), (10, "u", "short"), (11, "u", "short"), (12, "", "y" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))
    folder = scratch(spark, f"warc-{uuid.uuid4().hex}")
    got = warc.warc_round_trip(df, folder).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert {i for i, r in by.items() if r["record_type"] == "revisit"} == {5, 9, None}
    assert all(by[i]["refers_to"] == 3 for i in (5, 9, None)) and by[3]["refers_to"] is None
    import hashlib
    for i, _, h in rows:
        assert by[i]["payload_bytes"] == len((h or "").encode()) and by[i]["payload_digest"] == hashlib.sha256((h or "").encode()).hexdigest()
    index = warc.read_index(spark, f"{folder}/archives").collect()
    assert len(index) == len(rows)
    for r in index:     # each record is a gzip member of its own
        with open(r["archive"].removeprefix("file://").removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            record = gzip.decompress(f.read(r["length"]))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    assert warc.warc_round_trip(df.limit(0), scratch(spark, f"warc-{uuid.uuid4().hex}")).count() == 0


def test_warc_stream_in_small_chunks():
    records = [f"WARC/1.1\r\nContent-Length: {n}\r\n\r\n".encode() + b"\r\n" * (n // 2) + b"z" * (n % 2) for n in (0, 1, 7, 5000)]
    stream = b"\r\n\r\n".join(records) + b"\r\n\r\n"
    for packed in (gzip.compress(stream), b"".join(gzip.compress(r + b"\r\n\r\n") for r in records)):
        data = b"".join(warc.inflated(io.BytesIO(packed)))
        for step in (1, 3, 64, 10**6):
            assert list(warc.split_stream(iter([data[i:i + step] for i in range(0, len(data), step)]))) == records
    with pytest.raises(ValueError):
        list(warc.split_stream(iter([stream[:-10]])))


# Language model

def test_language_model_counts(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0        # noqa: E731
    c = collections.Counter(w for i, words in rows if not held(i) for w in words)
    ends = sum(not held(i) for i, _ in rows)
    total, kinds = sum(c.values()) + ends, len(c) + 1
    lg = lambda n: math.log10((n + 0.1) / (total + 0.1 * (kinds + 1)))      # noqa: E731
    want = sorted((str(i), held(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, total, round(sum(lg(c[x]) for x in w) + lg(ends), 5))
                  for i, w in rows)
    out = hmm.score_texts(docs.withColumn("score", F.lit(1))).collect()
    assert want == sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out)
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert hmm.score_texts(none).count() == 0


def test_rare_words_are_looked_up(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    full = {r["doc_id"]: r for r in hmm.score_texts(docs, iterations=1).collect()}
    monkeypatch.setattr(hmm, "FREQUENT", 3000)
    for r in hmm.score_texts(docs, iterations=1).collect():
        assert r["n_known"] == full[r["doc_id"]]["n_known"] and math.isclose(r["base_score"], full[r["doc_id"]]["base_score"], rel_tol=1e-9)


def small_model():
    rng = np.random.default_rng(1)
    parts = [rng.random(s) + 0.1 for s in ((3,), (3, 3), (3, 5))]
    return hmm.Model(*[p / p.sum(axis=-1, keepdims=True) for p in parts])


def test_forward_equals_sum_over_paths():
    model, texts = small_model(), [[0, 1, 4], [2], [3, 3, 1, 0, 2], [1, 2]]
    import pandas as pd
    for at, padded, lengths in hmm.lanes(pd.Series([np.array(t) for t in texts])):
        total = hmm.forward(model, padded, lengths, False)[0]
        starts, moves, emits, log = hmm.expected(model, padded, lengths)
        assert math.isclose(log, total.sum()) and math.isclose(starts.sum(), len(at)) and math.isclose(emits.sum(), sum(map(len, texts)))
        assert math.isclose(moves.sum(), sum(len(t) - 1 for t in texts))
        want_moves = np.zeros((3, 3))
        for i, value in zip(at, total):
            t, p = texts[i], 0.0
            for path in itertools.product(range(3), repeat=len(t)):
                q = model.start[path[0]] * model.emit[path[0], t[0]]
                for a, b, s in zip(path, path[1:], t[1:]):
                    q *= model.move[a, b] * model.emit[b, s]
                p += q
                for a, b in itertools.pairwise(path):
                    want_moves[a, b] += q / math.exp(value)
            assert math.isclose(math.log(p), value)
        assert np.allclose(moves, want_moves)


def test_training_raises_the_likelihood(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.lit(False).alias("_held"),
                       F.monotonically_increasing_id().alias("_row"))
    vocab = hmm.vocabulary(hmm.word_counts(rows), docs.count())
    _, path = hmm.train(hmm.read_documents(rows, vocab).cache(), vocab, iterations=4)
    assert all(b > a - abs(a) * 1e-3 for a, b in itertools.pairwise(path)) and path[-1] > path[0]


# Pipeline

def test_pipeline_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("text", F.when(F.col("doc_id") == 3, None).otherwise(F.col("text")))
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL))
        at[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    start = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(start, spark.read.parquet(f"{SMALL}/labels.parquet"))
    judged = toxicity.with_toxicity(start, model).collect()
    assert {r["doc_id"] for r in at["toxicity"]} - {3} == {r["doc_id"] for r in judged if r["score"] < 0.7} - {3}
    kept = [(r["doc_id"], r["text"]) for r in at["toxicity"]]
    assert {r["doc_id"] for r in at["near_duplicates"]} == {i for i, (_, c) in brute_components(kept, 5, 80).items() if c == i}
    items = [" ".join(python_words(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in at["near_duplicates"] if not any(f" {i} " in f" {' '.join(python_words(r['text']))} " for i in items)}
    assert {r["doc_id"] for r in at["decontamination"]} == clean
    assert {r["doc_id"] for r in at["packing"]} == clean
    assert_packed(at["packing"])
    assert len(corpus_pipeline.run(spark, SMALL).collect()) > 0


def test_pipeline_edges(spark, odd, none):
    for docs in (odd, none):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, SMALL))
            assert name == "packing" or docs.columns == columns
        assert docs.filter("doc_id IS NULL").count() == (1 if columns and docs.count() else 0)


def test_candidate_groups_do_not_chain_lists(spark):
    """Nodes in a row, each sharing one posted pair with the next but few coordinates: no group. Similar ones: groups."""
    rng = np.random.default_rng(5)
    coordinates, matches = 32, 17
    base = (rng.integers(1, 1 << 50, (60, coordinates)) << 8) | np.arange(coordinates)
    for i in range(59):
        base[i + 1, i % 32] = base[i, i % 32]
    base[20:23, :18] = base[20, :18]
    base[22, :2] = base[40, :2]
    base[40:42, 10:] = base[40, 10:]
    rows = [(f"n{i:02d}", [int(v) for v in r]) for i, r in enumerate(base)]
    nodes = spark.createDataFrame(rows, "_node string, _signature array<long>")
    posted = minhash.postings(nodes, coordinates, matches)
    # Every node in one long list too, longer than a batch.
    long = nodes.select(F.lit(7).cast("long").alias("_token"), "_node", F.col("_signature").alias("_tokens"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for lists in (posted, posted.select("_token", "_node", "_tokens").unionByName(long)):
            groups: dict = {}
            for r in minhash.candidate_groups(lists, coordinates, matches).collect():
                groups.setdefault(r["component"], set()).add(r["node"])
            want = {i: {j for j in range(60) if j != i and (base[i] == base[j]).sum() >= matches} for i in range(60)}
            assert want[20] and want[40] and sum(bool(w) for w in want.values()) < 8
            for i, near in want.items():
                for j in near:
                    assert any({f"n{i:02d}", f"n{j:02d}"} <= g for g in groups.values())
            assert sorted(x for g in groups.values() for x in g) == sorted(f"n{i:02d}" for i in range(60) if want[i])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
