"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact weighted-shingle check.

For every benchmark item, windows of the item's own number of words slide over each document. A window's 64-bit SimHash
is taken from its weighted five-word shingles; a multi-index over eight 8-bit blocks finds all items whose fingerprint is
within ``radius`` bits (some block of such a pair differs in at most ``radius // 8`` bits, and the index lists all
values that near). What it finds is verified: shared shingle weight over the larger of both weights, at least
``similarity``. A shingle weighs ``1 + ln((documents + 1) / (documents with it + 1))``, counted over all documents.

A window without any shingle of the benchmark has similarity 0, so windows are laid only around such shingles; this
loses nothing and leaves most text without fingerprints. A pair just at 0.8 lies beyond 27 of 64 bits with a chance
below 1e-4.

The benchmark is taken in slices of bounded size, one pass over the documents each, and only a slice's index goes to all
tasks. Documents are not shuffled; a task holds one document and the fingerprints of ``STRETCH`` of its windows at a time.

Defined cases: null and empty texts match nothing; items with fewer words than a shingle take no part; items of equal text
are all reported; a document shorter than an item is one window; repeated documents are each reported; extra columns are
left out; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.llm.common import framed, only, plain_words
from tablemirror.session import written

SIZE = 5
SIMILARITY = 0.8
RADIUS = 27
SLICE_CHARS = 20_000_000
STRETCH = 16_384        # windows whose fingerprints a task holds at once
NEAR = {r: [x for x in range(256) if x.bit_count() <= r] for r in range(9)}


def hashed(words: list[bytes], size: int = SIZE) -> np.ndarray:
    """64-bit hashes of the shingles, one per start."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(b" ".join(words[i:i + size])) for i in range(len(words) - size + 1)], np.uint64)


def fingerprints(shingles: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every run of ``width`` shingles."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    signed = np.where(bits, weights[:, None], -weights[:, None])
    sums = np.concatenate((np.zeros((1, 64)), np.cumsum(signed, axis=0)))
    return np.packbits(sums[width:] - sums[:-width] > 1e-9, axis=1)


class Index:
    """Items of one number of words: fingerprints, block tables, shingle sets."""

    def __init__(self, items: list[tuple[str, np.ndarray]], weight_of, radius: int):
        self.ids = [i for i, _ in items]
        self.sets = [np.unique(s) for _, s in items]
        self.totals = np.array([weight_of(s).sum() for s in self.sets])
        self.prints = np.concatenate([fingerprints(s, weight_of(s), len(s)) for _, s in items])
        self.radius = radius
        self.tables = np.zeros((8, 256, len(items)), bool)
        for j, p in enumerate(self.prints):
            for block in range(8):
                self.tables[block, np.array(NEAR[min(8, radius // 8)]) ^ p[block], j] = True

    def near(self, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, item, distance) of all pairs within the radius."""
        out = []
        for at in range(0, len(prints), 1024):
            part = prints[at:at + 1024]
            hit = np.zeros((len(part), len(self.ids)), bool)
            for block in range(8):
                hit |= self.tables[block][part[:, block]]
            window, item = np.nonzero(hit)
            distance = np.bitwise_count(part[window] ^ self.prints[item]).sum(axis=1)
            keep = distance <= self.radius
            out += zip((window[keep] + at).tolist(), item[keep].tolist(), distance[keep].tolist(), strict=True)
        return out


def window_prints(region: np.ndarray, weights: np.ndarray, width: int, stretch: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first window, fingerprints) of stretches of the windows of a text, however long it is."""
    for at in range(0, len(region) - width + 1, stretch):
        end = at + stretch + width - 1
        yield at, fingerprints(region[at:end], weights[at:end], width)


def overlap(a: np.ndarray, b: np.ndarray, total: float, weight_of) -> float:
    """Shared weight over the larger weight."""
    common = np.intersect1d(a, b, assume_unique=True)
    return float(weight_of(common).sum() / max(total, weight_of(a).sum())) if len(common) else 0.0


def regions(docs: DataFrame, items: dict[str, list[bytes]]) -> DataFrame:
    """_key, _at, _shingles, _hits of every stretch of text that windows with a benchmark shingle can cover; _hits are the
    document's distinct benchmark shingles, given once per document."""
    longest = max(len(w) for w in items.values())
    vocabulary = {w for words in items.values() for w in words}
    known = {b" ".join(words[i:i + SIZE]) for words in items.values() for i in range(len(words) - SIZE + 1)}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["_key"], batch["_text"], strict=True):
                words = plain_words(text)
                if len(words) < SIZE:
                    continue
                told = np.fromiter((w in vocabulary for w in words), bool, len(words))
                run = told[:len(words) - SIZE + 1].copy()
                for i in range(1, SIZE):
                    run &= told[i:len(words) - SIZE + 1 + i]
                anchors = [i for i in np.flatnonzero(run).tolist() if b" ".join(words[i:i + SIZE]) in known]
                hits = sorted({xxhash.xxh3_64_intdigest(b" ".join(words[i:i + SIZE])) for i in anchors})
                start = end = -1
                spans = []
                for a in anchors:
                    low, high = max(0, a + SIZE - longest), min(len(words), a + longest)
                    if low <= end:
                        end = high
                    else:
                        spans.append((start, end))
                        start, end = low, high
                spans = [*spans[1:], (start, end)] if anchors else []
                for n, (low, high) in enumerate(spans):
                    rows.append((key, low, hashed(words[low:high]).view(np.int64),
                                 np.array(hits if n == 0 else [], np.uint64).view(np.int64)))
            yield framed(rows, ["_key", "_at", "_shingles", "_hits"])

    return docs.mapInPandas(find, "_key string, _at int, _shingles array<long>, _hits array<long>")


def verified(found: DataFrame, items: dict[str, list[bytes]], counts: dict[int, int], documents: int, similarity: float,
             radius: int, stretch: int = STRETCH) -> DataFrame:
    rare = 1 + math.log((documents + 1) / 2)
    shingles = np.array(sorted({int(s) for words in items.values() for s in hashed(words)}), np.uint64)
    weights = np.array([1 + math.log((documents + 1) / (counts.get(int(s), 0) + 1)) for s in shingles])

    def weight_of(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(shingles, x), len(shingles) - 1)
        return np.where(shingles[at] == x, weights[at], rare)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_size: dict[int, list] = {}
        for item, words in items.items():
            by_size.setdefault(len(words), []).append((item, hashed(words)))
        indexes = {n: Index(group, weight_of, radius) for n, group in by_size.items()}
        sizes_of: dict[int, set[int]] = {}
        for n, group in by_size.items():
            for _, own in group:
                for s in own.tolist():
                    sizes_of.setdefault(s, set()).add(n)
        for batch in batches:
            rows = []
            for key, at, region in zip(batch["_key"], batch["_at"], batch["_shingles"], strict=True):
                region = np.asarray(region, np.int64).view(np.uint64)
                own, best = weight_of(region), {}
                # An item without a shingle in this stretch has similarity 0 with all its windows.
                known = shingles[np.minimum(np.searchsorted(shingles, region), len(shingles) - 1)] == region
                for n in sorted(set().union(*(sizes_of[s] for s in np.unique(region[known]).tolist()))):
                    index = indexes[n]
                    width = min(n - SIZE + 1, len(region))
                    near = ((first + window, item, distance) for first, prints in window_prints(region, own, width, stretch)
                            for window, item, distance in index.near(prints))
                    for window, item, distance in near:
                        share = overlap(np.unique(region[window:window + width]), index.sets[item], index.totals[item], weight_of)
                        if share >= similarity - 1e-9 and share > best.get(index.ids[item], (0.0,))[0]:
                            best[index.ids[item]] = (share, at + window, width + SIZE - 1, distance)
                rows += [(key, item, *x) for item, x in best.items()]
            yield framed(rows, ["_key", "_item", "_share", "_first", "_words", "_distance"])

    return found.select("_key", "_at", "_shingles").mapInPandas(
        check, "_key string, _item string, _share double, _first int, _words int, _distance int")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS,
                  slice_chars: int = SLICE_CHARS, stretch: int = STRETCH) -> DataFrame:
    """key, item_key, similarity, first_word, n_words, distance: the best window of every document and item that match."""
    spark = docs.sparkSession
    rows = only(docs, _key=key, _text=text).withColumn("_key", F.col("_key").cast("string")).filter("_text IS NOT NULL")
    table = only(benchmark, _item=item_key, _text=item_text).filter("_text IS NOT NULL")
    table = table.withColumn("_item", F.coalesce(F.col("_item").cast("string"), F.lit("")))
    documents = rows.count()
    slices = max(1, math.ceil((table.agg(F.sum(F.length("_text"))).first()[0] or 0) / slice_chars))
    schema = "_key string, _item string, _share double, _first int, _words int, _distance int"
    out = spark.createDataFrame([], schema)
    for part in range(slices):
        share = table.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(slices)) == part)
        words = {(r["_item"], n): plain_words(r["_text"]) for n, r in enumerate(share.toLocalIterator())}
        items = {f"{n} {item}": w for (item, n), w in words.items() if len(w) >= SIZE}
        if not items:
            continue
        found = written(regions(rows, items))
        counts = {r["h"] & ((1 << 64) - 1): r["count"] for r in
                  found.select(F.explode("_hits").alias("h")).groupBy("h").count().toLocalIterator()}
        out = out.unionByName(verified(found, items, counts, documents, similarity, radius, stretch))
    best = out.groupBy("_key", "_item").agg(F.max(F.struct("_share", -F.col("_first"), "_words", "_distance")).alias("b"))
    return best.select(
        F.col("_key").cast(docs.schema[key].dataType).alias(key),
        F.regexp_replace("_item", "^[0-9]+ ", "").cast(benchmark.schema[item_key].dataType).alias(item_key),
        F.col("b._share").alias("similarity"), (-F.col("b.col2")).alias("first_word"), F.col("b._words").alias("n_words"),
        F.col("b._distance").alias("distance"))
