"""Source divergence audit, token counts and phrase collocations: SQL twins, brute force and defined edge cases."""

import collections
import os
import sys
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from check import TABLES, compare  # noqa: E402

from tablemirror.llm import collocations, divergence, token_counts  # noqa: E402
from tablemirror.llm.queries import LLM_ORACLES, LLM_QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} under" for i in range(30_000))
ROWS = [(1, "Released under the MIT License.\nAll rights reserved.", "en", "a"), (2, None, None, None), (3, "", "en", "b"),
        (4, " \t\n", "en", None), (5, LONG, "en", "a"), (6, "one two", "de", "a"), (6, "one two", "de", "a"),
        (None, "no id at all but some words here", "en", "b"),
        (7, "İK ÀB  <|endoftext|> 漢字 \U0001F600 cc by-nc 12345x", None, "c"), (8, "one two", "de", "b")]
CLASH = ("text", "lang", "source", "terms", "term", "count", "tid", "p", "q", "N", "V", "ws", "s", "weight", "w0", "w1",
         "phrase", "a", "l", "r", "n", "score", "rank", "_task", "_split", "_splits", "n_tokens", "n_bytes", "item", "part")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns of clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(i).alias(f"x_{c}") for i, c in enumerate(CLASH)],
                     F.lit(1).alias("_row"), F.lit("z").alias("_judged"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_phrase_collocations"])
def test_sql_twins(spark, con, name):
    assert compare(spark, con, name, LLM_QUERIES[name], LLM_ORACLES[name], SMALL).startswith("ok")


# --- op11 -----------------------------------------------------------------------------------------------------------

def audit_by_hand(rows, least=10):
    """Dense brute force: every pair prices every kept term in Python integers."""
    import regex
    norm = [((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), lang or "",
             src or "") for t, lang, src in rows]
    terms = [(regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t), lang, src) for t, lang, src in norm]
    df = collections.Counter((lang, w) for ws, lang, _ in terms for w in set(ws))
    kept = collections.defaultdict(set)
    for (lang, w), c in df.items():
        if c >= least:
            kept[lang].add(w)
    groups = sorted({(lang, src) for _, lang, src in terms})
    count = collections.defaultdict(collections.Counter)
    for ws, lang, src in terms:
        count[(lang, src)].update(w for w in ws if w in kept[lang])
    out = []
    for lang in sorted({g[0] for g in groups}):
        V, srcs = len(kept[lang]), [s for g, s in groups if g == lang]
        p = {s: {w: 1 + 10**9 * (count[(lang, s)][w] + 2) // (sum(count[(lang, s)].values()) + 2 * V) for w in kept[lang]} for s in srcs}
        whole = collections.Counter()
        for s in srcs:
            whole.update(count[(lang, s)])
        q = {w: 1 + 10**9 * (whole[w] + 2) // (sum(whole.values()) + 2 * V) for w in kept[lang]}
        for s in srcs:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // (p[s][w] + p[o][w]) for w in kept[lang])) for o in srcs if o != s]
            for i, (o, v) in enumerate(sorted(pairs, key=lambda x: (-x[1], x[0].encode()))):
                out.append((lang, s, "pair", o, v, i + 1))
            ts = [(w, (p[s][w] - q[w]) ** 2 // (p[s][w] + q[w])) for w in kept[lang] if count[(lang, s)][w] > 0 and p[s][w] > q[w]]
            for i, (w, v) in enumerate(sorted(ts, key=lambda x: (-x[1], x[0].encode()))[:10]):
                out.append((lang, s, "term", w, v, i + 1))
    return sorted(out)


def test_audit_edge_cases(spark, odd):
    got = divergence.audit(odd, least_rows=1)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [(t, lang, src) for _, t, lang, src in ROWS]
    assert sorted(tuple(r) for r in got.collect()) == audit_by_hand(rows, least=1)
    assert divergence.audit(odd.limit(0)).count() == 0


def test_audit_without_kept_terms_gives_zero_pairs(spark):
    df = spark.createDataFrame([("x y", "en", "a"), ("z", "en", "b"), ("", "en", "c")], "text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.audit(df).collect())
    assert got == audit_by_hand([tuple(r) for r in df.collect()])
    assert {r[4] for r in got} == {0} and len(got) == 6


def test_gallop_and_pair_value():
    rng = np.random.default_rng(3)
    for _ in range(50):
        V = 200
        a = np.sort(rng.choice(V, rng.integers(0, 60), replace=False)).astype(np.int64)
        b = np.sort(rng.choice(V, rng.integers(0, 120), replace=False)).astype(np.int64)
        ap, bp = rng.integers(1, 10**9, len(a)), rng.integers(1, 10**9, len(b))
        az, bz = int(rng.integers(1, 10**6)), int(rng.integers(1, 10**6))
        pa, pb = dict(zip(a.tolist(), ap.tolist())), dict(zip(b.tolist(), bp.tolist()))
        want = sum((pa.get(t, az) - pb.get(t, bz)) ** 2 // (pa.get(t, az) + pb.get(t, bz)) for t in range(V))
        assert divergence.pair_value(a, ap, az, b, bp, bz, V) == want
        assert divergence.pair_value(b, bp, bz, a, ap, az, V) == want


# --- op12 -----------------------------------------------------------------------------------------------------------

def test_token_counts_equal_whole_encoding(spark, odd):
    from tokenizers import Tokenizer
    import public_tokenizers
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", F.lit(None).cast("long").alias("n_chars")))
    got = token_counts.count_tokens(docs, piece_chars=40, batch_bytes=5000).collect()
    texts = [r["text"] or "" for r in docs.select("text").collect()]
    assert [r["n_tokens"] for r in got] == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [r["n_bytes"] for r in got] == [len(t.encode()) for t in texts]
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert any(r["over_limit"] for r in got)


def test_token_count_cases(spark, odd):
    got = token_counts.count_tokens(odd).collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in ROWS]
    by = [(r["n_bytes"], r["n_tokens"]) for r in got]
    assert by[1] == (0, 0) and by[2] == (0, 0) and by[3] == (3, 0)
    assert by[5] == by[6]
    special = token_counts.Counter("word_bpe_49k.json")(["<|endoftext|>"], 10, 10)
    assert special == [1]
    assert token_counts.count_tokens(odd.limit(0)).count() == 0
    assert token_counts.safe_pieces("a b c d", 1) == ["a ", "b ", "c ", "d"]
    assert token_counts.safe_pieces("abc123", 2) == ["abc", "12", "3"]
    assert token_counts.safe_pieces("abcdef", 2) == ["abcdef"]


# --- op13 -----------------------------------------------------------------------------------------------------------

def test_quicksort_equals_counting():
    rng = np.random.default_rng(1)
    m = 5000
    keys = rng.integers(0, 12, (m, 4))
    keys[rng.random(m) < 0.3, 3] = -1
    keys[rng.random(m) < 0.1, 2:] = -1
    w = rng.integers(1, 4, m)
    got = {tuple(keys[r, :d + 1].tolist()): c for r, d, c in collocations.frequent_prefixes(keys, w, 30, 1)}
    cnt = collections.Counter()
    for k, ww in zip(keys.tolist(), w.tolist()):
        for d in range(1, 4):
            if k[d] < 0:
                break
            cnt[tuple(k[:d + 1])] += ww
    assert got == {p: c for p, c in cnt.items() if c >= 30}
    assert collocations.frequent_prefixes(np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.int64), 30, 1) == []


def test_collocations_hot_word_split_gives_the_same(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    base = sorted(tuple(r) for r in collocations.collocations(docs, least=5).collect())
    split = sorted(tuple(r) for r in collocations.collocations(docs, least=5, task_rows=50).collect())
    assert base == split and len(base) > 50


def test_collocations_of_split_words_and_open_vocabulary_are_the_same(spark):
    """Leading words split by second and third word, small runs, and words that only travel as text."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    base = sorted(tuple(r) for r in collocations.collocations(docs, least=5).collect())
    for options in ({"task_rows": 20}, {"vocabulary": 40, "task_rows": 50, "chunk": 500}, {"vocabulary": 0, "chunk": 1000}):
        assert sorted(tuple(r) for r in collocations.collocations(docs, least=5, **options).collect()) == base


def test_collocation_suffixes_are_shuffled_as_small_numbers():
    """Suffixes of infrequent words go nowhere, equal ones once, and the others take a few bytes each."""
    rng = np.random.default_rng(5)
    vocabulary = collocations.Vocabulary(["en"] * 2000, [b"w%d" % i for i in range(2000)], np.ones(2000, dtype=np.int64), True)
    codes = rng.integers(0, 2000, 100_000)
    blocks = collocations._blocks(codes, [], vocabulary, 4)
    assert sorted(blocks.column("_task").to_pylist()) == [0, 1, 2, 3]
    columns = [collocations._unpacked(b, 5) for b in blocks.column("data").to_pylist()]
    assert sum(c[4].sum() for c in columns) == 99_999
    squeezed = sum(len(zlib.compress(b, 1)) for b in blocks.column("data").to_pylist())
    assert squeezed < 10 * 100_000
    twice = collocations._blocks(np.concatenate([codes, [-1], codes]), [], vocabulary, 4)
    assert sum(map(len, twice.column("data").to_pylist())) == sum(map(len, blocks.column("data").to_pylist()))
    rare = np.where(np.arange(100_000) % 2 == 0, codes, -1)
    assert collocations._blocks(rare, [], vocabulary, 4).num_rows == 0


def test_collocation_words_of_long_texts_are_cut_at_spaces(monkeypatch):
    text = "One two,three\tfour  \u00e9t\u00e9\u00a0x\u2003y; " * 50 + "z" * 300 + " end"
    whole = [w for part in collocations.tokens(text.encode()) for w in part if w]
    monkeypatch.setattr(collocations, "SLICE", 16)
    parts = list(collocations.tokens(text.encode()))
    assert len(parts) > 50 and [w for part in parts for w in part if w] == whole
    assert whole[:7] == [b"one", b"two", b"\n", b"three", b"four", "\u00e9t\u00e9\u00a0x\u2003y".encode(), b"\n"]


def test_collocation_cases(spark, odd):
    text = "Alpha beta gamma delta. " * 40 + "alpha beta, gamma delta; x\ty. " * 35
    rows = [(1, text, None), (2, None, "en"), (3, "", "en"), (1, text, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select(
        "*", *[F.lit(i).alias(c) for i, c in enumerate(("phrase", "weight", "w0", "s", "ws", "_task"))])
    got = {r["phrase"]: r.asDict() for r in collocations.collocations(df).collect()}
    # 'alpha beta gamma delta' occurs 80 times; inside it, 'beta gamma' (80) and 'beta gamma delta' are dropped, 'alpha beta'
    # (150) and 'gamma delta' (150) stay: 100 * 80 < 80 * 150.
    assert set(got) == {"alpha beta gamma delta", "alpha beta", "gamma delta", "x y"}
    g = got["alpha beta gamma delta"]
    assert (g["lang"], g["a"], g["n"]) == ("und", 80, 2 * (40 * 4 + 35 * 6))
    assert (g["l"], g["r"], g["score"]) == (150, 150, 2_000_000 * 80 // 300)
    assert collocations.collocations(odd).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(odd.limit(0)).count() == 0


# --- pipeline stages with columns of clashing names ------------------------------------------------------------------

def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline
    from tablemirror.llm import toxicity
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = ("_judged", "_toxic_score", "_toxic_evidence", "_row_key", "_row_key1")
    marked = docs.select("*", *[F.concat(F.lit(c + ":"), F.col("doc_id").cast("string")).alias(c) for c in extra])
    for stage in (corpus_pipeline.reject_toxic, corpus_pipeline.drop_leaks):
        plain = sorted(r["doc_id"] for r in stage(spark, docs, SMALL).select("doc_id").collect())
        got = stage(spark, marked, SMALL)
        assert got.columns == marked.columns
        rows = got.collect()
        assert sorted(r["doc_id"] for r in rows) == plain
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in extra)
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    judged = toxicity.with_toxicity(marked, model, "text", "score", "evidence")
    assert judged.columns == [*marked.columns, "score", "evidence"]
