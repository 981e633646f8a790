"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

``fit`` takes a bounded, hash-chosen sample of labelled documents (``SAMPLE``). Terms are words and beginnings of words;
those that labelled documents mark as telling (z-score and lift) become the vocabulary (at most ``TERMS``). Document
frequencies of the vocabulary are counted over all documents. The examples' TF-IDF vectors, equal ones merged with
their label counts, form the index: postings per term, cut into blocks with each block's largest weight.

A document's vector asks the index for its ``NEAREST`` most similar examples. A block's score cannot exceed the sum of
query weight times block maximum, so blocks are opened from the highest bound down until the next bound is below the
last neighbour kept: the result is exact. Neighbours vote with weight 1 / (distance + 0.05) for each labelled document
behind them, drawn towards the rate of documents without any term. A logistic fit to the examples' own votes, each with
its own label left out, turns votes into probabilities. Evidence is the ids of the nearest examples.

Scoring is one pass over the texts without a shuffle; only the model, bounded by its parameters, goes to all tasks.

Defined cases: null and empty texts, and texts without a term, get the rate of toxic labels among examples without terms;
without any labels every score is 0; several labels of a document count as toxic if one is; null labels and ids take no
part in learning; a repeated id is learnt from once, by its smallest text; equal similarities go by the smaller example
id; extra columns are left out or passed through.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.llm.common import doc_remainder, fresh, lower_ascii, only, plain_words
from tablemirror.session import cut, written

SAMPLE = 20_000         # labelled documents that are learnt from, at most (about)
TERMS = 512
BEGINNINGS = (5, 6, 7)
NEAREST = 15
BLOCK = 64
OTHER = 6.0             # weight that stands for a document's other words; keeps how often a term occurs in the direction
LEAST_Z, LEAST_LIFT, LEAST_DOCS = 5.0, 4.0, 4
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """_id, _text, _y of at most about ``sample`` labelled documents outside the held-out third."""
    known = only(labels, _id=key, _y=label).filter("_y IS NOT NULL AND _id IS NOT NULL")
    known = known.filter(doc_remainder(F.col("_id"), 3) != 1).groupBy("_id").agg(F.max(F.col("_y").cast("int")).alias("_y"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = cut(known.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    rows = only(docs, _id=key, _text=text)
    # Bounded by the sample, so every task can hold it; so are the examples, as a repeated id gives one.
    examples = rows.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    return written(examples)


def telling_terms(sample: DataFrame, terms: int) -> tuple[list[tuple[str, bool]], int, int]:
    """(term, is a beginning) of the terms that tell toxic examples, and the numbers of examples of both labels."""
    words = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("_text")), F.lit(WORD), F.lit(0)))
    # A beginning is written with a star, which no word holds.
    starts = [F.transform(_longer(n), _beginning(n)) for n in BEGINNINGS]
    seen = (sample.select("_y", words.alias("_words"))
            .select("_y", F.explode(F.concat("_words", F.array_distinct(F.concat(*starts)))).alias("t")).groupBy("t").agg(
                F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")).filter(F.col("pos") >= LEAST_DOCS))
    n = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("p")).first()
    pos, neg = n["p"], n["n"] - n["p"]
    if not pos or not neg:
        return [], pos, neg
    p1, p0 = F.col("pos") / pos, F.col("neg") / neg
    both = (F.col("pos") + F.col("neg")) / (pos + neg)
    z = (p1 - p0) / F.sqrt(both * (1 - both) * (1 / pos + 1 / neg))
    best = (seen.withColumn("z", z).filter((F.col("z") >= LEAST_Z) & (p1 >= LEAST_LIFT * p0))
            .orderBy(F.col("z").desc(), "t").limit(terms).select("t").collect())
    return [(r["t"].rstrip("*"), r["t"].endswith("*")) for r in best], pos, neg


def _longer(n: int):
    return F.filter("_words", lambda w: F.length(w) > n)


def _beginning(n: int):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))


class Terms:
    """Counts of the vocabulary's terms in a text."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.words = {t.encode(): i for i, (t, start) in enumerate(terms) if not start}
        self.starts = {t.encode(): i for i, (t, start) in enumerate(terms) if start}
        self.lengths = sorted({len(s) for s in self.starts})

    def count(self, text: str | None) -> dict[int, int]:
        found: dict[int, int] = {}
        words, starts, lengths = self.words, self.starts, self.lengths
        for word, n in Counter(plain_words(text)).items():
            if (i := words.get(word)) is not None:
                found[i] = found.get(i, 0) + n
            for length in lengths:
                if len(word) <= length:
                    break
                if (i := starts.get(word[:length])) is not None:
                    found[i] = found.get(i, 0) + n
        return found


@dataclass
class BlockMaxIndex:
    """Inverted index of unit vectors: per term the examples' weights in blocks, and each block's maximum."""

    weights: np.ndarray     # term x example
    largest: np.ndarray     # term x block
    ids: np.ndarray
    toxic: np.ndarray
    rows: np.ndarray

    @classmethod
    def build(cls, vectors: list[tuple[dict[int, float], int, int, int]], terms: int) -> BlockMaxIndex:
        """``vectors``: (unit vector, smallest id, labelled documents, toxic ones)."""
        # Examples with the same heaviest term stand together, which keeps block maxima telling.
        vectors = sorted(vectors, key=lambda v: (max(list(v[0])[:-1], key=v[0].get), v[1]))
        blocks = max(1, math.ceil(len(vectors) / BLOCK))
        weights = np.zeros((terms, blocks * BLOCK), np.float32)
        for j, (vector, *_) in enumerate(vectors):
            for i, w in vector.items():
                weights[i, j] = w
        return cls(weights, weights.reshape(terms, blocks, BLOCK).max(axis=2), np.array([v[1] for v in vectors], np.int64),
                   np.array([v[3] for v in vectors], float), np.array([v[2] for v in vectors], float))

    def nearest(self, vector: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of the k nearest examples with a cosine above 0, exactly."""
        terms = np.fromiter(vector, np.int64, len(vector))
        query = np.fromiter(vector.values(), np.float64, len(vector))
        bounds = query @ self.largest[terms]
        order = np.argsort(-bounds, kind="stable")
        at, scores = np.empty(0, np.int64), np.empty(0)
        kth, step = 0.0, 1
        i = 0
        while i < len(order) and bounds[order[i]] > 0 and bounds[order[i]] >= kth - 1e-6:
            opened = order[i:i + step]
            opened = opened[(bounds[opened] > 0) & (bounds[opened] >= kth - 1e-6)]
            inside = (opened[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            inside = inside[inside < len(self.ids)]
            got = query @ self.weights[np.ix_(terms, inside)].astype(np.float64)
            at, scores = np.concatenate((at, inside[got > 0])), np.concatenate((scores, got[got > 0]))
            if len(at) > k:
                keep = np.lexsort((self.ids[at], -np.round(scores, 9)))[:k]
                at, scores = at[keep], scores[keep]
                kth = scores.min()
            i += step
            step = min(16, step * 2)
        keep = np.lexsort((self.ids[at], -np.round(scores, 9)))[:k]
        return at[keep], scores[keep]


@dataclass
class ToxicityModel:
    terms: list[tuple[str, bool]]
    idf: np.ndarray
    index: BlockMaxIndex | None
    rate: float             # of toxic labels among examples without a term
    k: int = NEAREST
    slope: float = 1.0      # calibration of the votes' log-odds
    shift: float = 0.0

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {i: (1 + math.log(n)) * self.idf[i] for i, n in counts.items()}
        raw[len(self.terms)] = OTHER
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {i: x / norm for i, x in sorted(raw.items())}

    def votes(self, vector: dict[int, float], without: tuple[int, int] | None = None) -> tuple[float, list[int]]:
        """The neighbours' vote before calibration; ``without`` = (position, label) leaves one document out."""
        at, cosine = self.index.nearest(vector, self.k)
        rows, toxic = self.index.rows[at], self.index.toxic[at]
        if without is not None:
            rows, toxic = rows - (at == without[0]), toxic - without[1] * (at == without[0])
        weight = 1 / (np.maximum(0.0, 1 - cosine) + 0.05)
        score = ((weight * toxic).sum() + self.rate) / ((weight * rows).sum() + 1)
        return float(min(1.0, max(0.0, score))), self.index.ids[at[:5]].tolist()

    def judge(self, counts: dict[int, int]) -> tuple[float, list[int]]:
        if not counts or self.index is None:
            return self.rate, []
        score, evidence = self.votes(self.vector(counts))
        return float(1 / (1 + math.exp(-self.slope * log_odds(score) - self.shift))), evidence

    def calibrate(self, vectors: list[tuple[dict[int, float], int]]) -> None:
        """Logistic fit of the examples' labels to their votes, each example's own label left out."""
        place = {int(i): j for j, i in enumerate(self.index.ids)}
        x, y, w = [], [], []
        for vector, first in vectors:
            j = place[first]
            for label, n in ((1, self.index.toxic[j]), (0, self.index.rows[j] - self.index.toxic[j])):
                if n:
                    x.append(log_odds(self.votes(vector, (j, label))[0]))
                    y.append(label)
                    w.append(n)
        x, y, w = (np.array(v, float) for v in (x, y, w))
        if not 0 < (w * y).sum() < w.sum():
            return
        a, b = 1.0, 0.0
        for _ in range(30):     # Newton steps, with a weak pull to the identity
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([(w * (y - p) * x).sum() - (a - 1), (w * (y - p)).sum() - b])
            v = w * p * (1 - p)
            h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]])
            step = np.linalg.solve(h, g)
            a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
        if a > 0:
            self.slope, self.shift = a, b


def log_odds(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: int = SAMPLE, terms: int = TERMS, k: int = NEAREST) -> ToxicityModel:
    examples = labelled_sample(docs, labels, key, text, label, sample)
    vocabulary, pos, neg = telling_terms(examples, terms)
    rate = pos / (pos + neg) if pos + neg else 0.0
    if not vocabulary:
        return ToxicityModel([], np.zeros(0), None, rate, k)
    counter = Terms(vocabulary)

    @F.pandas_udf("map<int,int>")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: counter.count(t), na_action=None)

    rows = only(docs, _text=text)
    total = rows.count()
    df = {r["i"]: r["count"] for r in rows.select(F.explode(F.map_keys(counted("_text"))).alias("i")).groupBy("i").count().collect()}
    idf = np.array([math.log((total + 1) / (df.get(i, 0) + 1)) + 1 for i in range(len(vocabulary))])
    model = ToxicityModel(vocabulary, idf, None, rate, k)
    merged: dict[tuple, list] = {}
    empty = [0, 0]
    ids = examples.schema["_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    number = F.col("_id").cast("bigint") if ids else F.xxhash64("_id")
    # Bounded by the sample.
    for r in examples.select(number.alias("id"), "_y", counted("_text").alias("c")).toLocalIterator():
        if not r["c"]:
            empty = [empty[0] + 1, empty[1] + r["_y"]]
            continue
        at = merged.setdefault(tuple(sorted(r["c"].items())), [r["id"], 0, 0])
        merged[tuple(sorted(r["c"].items()))] = [min(at[0], r["id"]), at[1] + 1, at[2] + r["_y"]]
    model.rate = (empty[1] + rate) / (empty[0] + 1)
    if merged:
        vectors = [(model.vector(dict(c)), *x) for c, x in merged.items()]
        model.index = BlockMaxIndex.build(vectors, len(vocabulary) + 1)
        model.calibrate([v[:2] for v in vectors])
    return model


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score",
                  evidence: str = "evidence") -> DataFrame:
    """``docs`` with the probability of being toxic and the ids of the nearest examples in ``score`` and ``evidence``;
    its other columns stay as they are, whatever their names."""
    counter = Terms(model.terms)
    handle = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, evidence array<bigint>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        known, out = {}, []
        own = handle.value
        for t in texts:
            counts = counter.count(t) if own.terms else {}
            name = tuple(sorted(counts.items()))
            if name not in known:
                known[name] = own.judge(counts)
            out.append(known[name])
        return pd.DataFrame({"score": [x[0] for x in out], "evidence": [x[1] for x in out]})

    held = fresh(docs, "_judged")       # whatever columns docs has stay as they are
    return docs.withColumn(held, judged(F.col(f"`{text}`"))).withColumn(score, F.col(f"`{held}`.score")).withColumn(
        evidence, F.col(f"`{held}`.evidence")).drop(held)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
             threshold: float = 0.7, model: ToxicityModel | None = None) -> DataFrame:
    """key, held_out, score, predicted, evidence of every document."""
    model = model or fit(docs, labels, key, text, label)
    scored = with_toxicity(only(docs, _id=key, _text=text), model, "_text", "score", "evidence")
    return scored.select(F.col("_id").alias(key), (doc_remainder(F.col("_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
