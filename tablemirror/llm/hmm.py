"""Hidden Markov language model over words, trained by Baum-Welch with counts added up across partitions.

Words are counted over all training documents (rows of a task are combined first). The ``TOP`` most frequent words,
``FORMS`` form classes of all other words (by their last bytes) and the end of a text are the symbols that the latent
states emit; inside its form class a word has its own share ``(c + 0.1) / (N_class + 0.1 (V_class + 1))``. States start
from anchor words that keep different company in the corpus, then every iteration runs the scaled forward and backward
recursions over all training documents; each task adds up its expected counts, a grouped sum adds the tasks', and the
driver holds the parameters only (``states x symbols`` numbers). The score of a text is the scaled forward recursion
over the whole text: the exact logarithm of the model's probability of its words and its end.

Word counts are as many rows as there are different words. The most frequent ones (``FREQUENT`` at most) are known to all
tasks; the others are looked up by a join on the word's hash, so nothing that grows with the corpus is broadcast.

Defined cases: a null or empty text is the end alone; a document is held out if crc32 of its id as text is divisible by 10,
so a null id is learnt from; repeated rows each count and get their row; extra columns are left out; an empty table gives
no rows, and with no training documents scores rest on the smoothing alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.llm.common import doc_remainder, framed, only, space_words
from tablemirror.session import written

TOP = 2000
FORMS = 128
FREQUENT = 100_000
STATES = 6
ITERATIONS = 3
ANCHORS = 64            # candidates for the words that states start from
CELLS = 400_000         # tokens (with padding) that one recursion holds
LANES = 512
HELD_WORDS = 300_000    # different words that a counting task holds before it hands them on
LN10 = math.log(10)


def form(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % FORMS


@dataclass
class Vocabulary:
    """What every task knows of the counts. Symbols: top words, then forms, then the end."""

    top: dict[bytes, int]
    counts: dict[bytes, int]        # the frequent words
    form_words: np.ndarray          # N and V of each form, top words left out
    form_kinds: np.ndarray
    tokens: int                     # N of all training tokens, ends included
    kinds: int                      # V, the end included
    texts: int                      # training documents

    @property
    def end(self) -> int:
        return TOP + FORMS

    @property
    def symbols(self) -> int:
        return TOP + FORMS + 1

    def shares(self) -> np.ndarray:
        """The symbols' own shares of the training tokens, smoothed."""
        base = np.zeros(self.symbols)
        for w, i in self.top.items():
            base[i] = self.counts[w]
        base[TOP:TOP + FORMS], base[self.end] = self.form_words, self.texts
        return (base + 0.1) / (base + 0.1).sum()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over the training documents; a task's rows are combined batch by batch before the shuffle."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch["_text"]:
                found.update(space_words(text))
            if len(found) > HELD_WORDS:
                yield framed(((w.decode(), n) for w, n in found.items()), ["word", "n"])
                found = Counter()
        yield framed(((w.decode(), n) for w, n in found.items()), ["word", "n"])

    rows = docs.filter("NOT _held").select("_text").mapInPandas(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    # The least count that keeps the known words within the bound; counts are gathered by size classes first.
    level = F.floor(F.log2("n") * 16)
    classes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    kept, least = 0, 0
    for lv, n in classes:
        if kept + n > FREQUENT:
            least = lv + 1
            break
        kept += n
    known = {r["word"].encode(): r["n"] for r in counts.filter(level >= least).toLocalIterator()}
    top = {w: i for i, w in enumerate(sorted(known, key=lambda w: (-known[w], w))[:TOP])}
    tail = F.col("word").cast("binary")
    last = F.crc32(F.substring(tail, F.greatest(F.lit(1), F.octet_length(tail) - 2), F.lit(3))) % FORMS
    words, kinds = np.zeros(FORMS), np.zeros(FORMS)
    for r in counts.groupBy(last.alias("form")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        words[r["form"]], kinds[r["form"]] = r["n"], r["v"]
    tokens, all_kinds = int(words.sum()) + texts, int(kinds.sum()) + (texts > 0)
    for w in top:
        words[form(w)] -= known[w]
        kinds[form(w)] -= 1
    return Vocabulary(top, known, words, kinds, tokens, all_kinds, texts)


def read_documents(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per document: _symbols, _n, and of the known words their number and sums of ln(c + 0.1), for all words and for
    those outside the top; _rare has the hashes of the words to look up."""
    handle = docs.sparkSession.sparkContext.broadcast(vocab)
    names = ["_row", "_id", "_held", "_symbols", "_n", "_known", "_base", "_inner", "_rare"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = handle.value
        place = {w: i for i, w in enumerate(v.counts)}
        end = math.log(v.texts + 0.1)
        share = np.log(v.form_words + 0.1 * (v.form_kinds + 1))
        # One entry per known word, and a last one, which -1 picks, for all others.
        logs = np.append(np.log(np.array(list(v.counts.values()), float) + 0.1), 0.0)
        of = np.array([v.top.get(w, TOP + form(w)) for w in v.counts] + [0], np.int16)
        within = np.where(of >= TOP, logs - share[np.maximum(of - TOP, 0)], 0.0)
        hashed = xxhash.xxh64_intdigest
        for batch in batches:
            rows = []
            for row, key, held, text in zip(batch["_row"], batch["_id"], batch["_held"], batch["_text"], strict=True):
                words = space_words(text)
                at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                symbols = np.append(of[at], np.int16(v.end))
                inner, rare = float(within[at].sum()), []
                for i in np.flatnonzero(at < 0).tolist():
                    f = form(words[i])
                    symbols[i] = TOP + f
                    inner -= share[f]
                    rare.append(hashed(words[i], seed=42))
                rows.append((row, key, held, symbols, len(symbols), int(v.texts > 0) + len(words) - len(rare),
                             end + float(logs[at].sum()), inner, np.array(rare, np.uint64).view(np.int64)))
            yield framed(rows, names)

    kind = docs.schema["_id"].dataType
    return (docs.select("_row", F.col("_id").cast("string").alias("_id"), "_held", "_text").mapInPandas(
        read, "_row long, _id string, _held boolean, _symbols array<smallint>, _n long, _known long, _base double, "
              "_inner double, _rare array<long>").withColumn("_id", F.col("_id").cast(kind)))


def lanes(symbols: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, padded symbols by time, lengths) of groups of texts of similar length."""
    lengths = np.array([len(x) for x in symbols], np.int64)
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = lengths[order[at]]
        group = order[at:at + max(1, min(LANES, CELLS // longest))]
        padded = np.zeros((longest, len(group)), np.int64)
        for lane, i in enumerate(group):
            padded[:lengths[i], lane] = symbols.iloc[i]
        yield group, padded, lengths[group]
        at += len(group)


def gathered(batches: Iterator[pd.DataFrame], tokens: int = 8 * CELLS) -> Iterator[pd.DataFrame]:
    """Batches put together to about ``tokens`` symbols, so that lanes hold texts of nearly equal length."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += sum(map(len, batch["_symbols"]))
        if size >= tokens:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


@dataclass
class Model:
    start: np.ndarray       # state
    move: np.ndarray        # state x state
    emit: np.ndarray        # state x symbol


def forward(model: Model, padded: np.ndarray, lengths: np.ndarray, keep: bool):
    """Log-likelihoods; with ``keep`` also the scaled forward variables and scales of every step. Lanes are sorted by
    falling length, so the ones still running are always the first."""
    steps, width = padded.shape
    by_symbol = np.ascontiguousarray(model.emit.T)
    total = np.zeros(width)
    alphas = np.zeros((steps, width, len(model.start))) if keep else None
    scales = np.ones((steps, width)) if keep else None
    running = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")      # lanes with length > t
    alpha = None
    for t in range(steps):
        n = running[t]
        alpha = (model.start if t == 0 else alpha[:n] @ model.move) * by_symbol[padded[t, :n]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
        if keep:
            alphas[t, :n], scales[t, :n] = alpha, scale
    return total, alphas, scales, running


def expected(model: Model, padded: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of a group of texts, and its log-likelihood."""
    total, alphas, scales, running = forward(model, padded, lengths, True)
    steps, width = padded.shape
    states = len(model.start)
    by_symbol = np.ascontiguousarray(model.emit.T)
    moves = np.zeros((states, states))
    beta = np.ones((width, states))
    gammas = alphas         # alpha times beta, in place
    back = model.move.T
    for t in range(steps - 2, -1, -1):
        n = running[t + 1]
        after = beta[:n] * by_symbol[padded[t + 1, :n]] / scales[t + 1, :n, None]
        moves += alphas[t, :n].T @ after
        gammas[t + 1, :n] *= beta[:n]
        beta[:n] = after @ back
    gammas[0] *= beta
    mask = np.arange(steps)[:, None] < lengths[None, :]
    symbols, weights = padded[mask], gammas[mask]
    emits = np.stack([np.bincount(symbols, weights[:, s], minlength=model.emit.shape[1]) for s in range(states)])
    return gammas[0].sum(axis=0), moves * model.move, emits, float(total.sum())


def added_up(parts: DataFrame) -> np.ndarray:
    """Sum of the tasks' arrays in column ``v``; the driver gets one array of the model's size."""
    sums = parts.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(max((r["i"] for r in sums), default=-1) + 1)
    for r in sums:
        out[r["i"]] = r["x"]
    return out


def anchored(train: DataFrame, vocab: Vocabulary, states: int) -> Model:
    """Starting parameters: each state emits the words that share documents with its anchor word."""
    symbols = vocab.symbols

    def company(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((ANCHORS, symbols), np.float64)
        for batch in batches:
            for at in range(0, len(batch), LANES):
                part = batch["_symbols"].iloc[at:at + LANES]
                counts = np.zeros((len(part), symbols), np.float32)
                for i, x in enumerate(part):
                    counts[i] = np.bincount(x, minlength=symbols)
                total += np.minimum(counts[:, :ANCHORS], 1).T @ counts
        yield pd.DataFrame({"v": [total.ravel()]})

    flat = added_up(train.mapInPandas(company, "v array<double>"))
    base = vocab.shares()
    together = (flat if len(flat) else np.zeros(ANCHORS * symbols)).reshape(ANCHORS, symbols)
    shares = together + 1000 * base
    shares /= shares.sum(axis=1, keepdims=True)
    profile = np.sqrt(shares)
    chosen = [0]
    while len(chosen) < states:
        near = np.max(profile @ profile[chosen].T, axis=1)
        near[chosen] = 2
        chosen.append(int(np.argmin(near)))
    emit = 0.9 * shares[chosen] + 0.1 * base
    move = np.full((states, states), 0.1 / (states - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))


def improved(train: DataFrame, model: Model, base: np.ndarray) -> tuple[Model, float]:
    """One Baum-Welch iteration over all training documents, and the log-likelihood before it."""
    states, symbols = model.emit.shape
    handle = train.sparkSession.sparkContext.broadcast(model)

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = handle.value
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols)), 0.0]
        for batch in gathered(batches):
            for _, padded, lengths in lanes(batch["_symbols"]):
                sums = [a + b for a, b in zip(sums, expected(own, padded, lengths), strict=True)]
        yield pd.DataFrame({"v": [np.concatenate((sums[0], sums[1].ravel(), sums[2].ravel(), [sums[3]]))]})

    flat = added_up(train.mapInPandas(collect, "v array<double>"))
    if not len(flat):
        return model, 0.0
    start = flat[:states] + 0.1
    move = flat[states:states + states ** 2].reshape(states, states) + 0.1
    emit = flat[states + states ** 2:-1].reshape(states, symbols) + 10 * base      # a weak pull to the words' own shares
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True)), flat[-1]


def likelihoods(read: DataFrame, model: Model) -> DataFrame:
    """_row, _log: natural logarithm of the probability of each symbol sequence."""
    handle = read.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in gathered(batches):
            out = np.zeros(len(batch))
            for at, padded, lengths in lanes(batch["_symbols"]):
                out[at] = forward(handle.value, padded, lengths, False)[0]
            yield pd.DataFrame({"_row": batch["_row"], "_log": out})

    return read.select("_row", "_symbols").mapInPandas(score, "_row long, _log double")


def looked_up(read: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """Per document with words that not every task knows: how many are in the counts, and sums of ln(c + 0.1)."""
    rare = read.select("_row", F.explode("_rare").alias("_hash"))
    table = counts.filter(F.col("n") <= least).select(F.xxhash64("word").alias("_hash"), "n")
    found = rare.join(table, "_hash", "left")
    return found.groupBy("_row").agg(F.count("n").alias("_found"),
                                     F.sum(F.log(F.coalesce("n", F.lit(0)) + 0.1)).alias("_sum"))


def train(read: DataFrame, vocab: Vocabulary, states: int = STATES, iterations: int = ITERATIONS) -> tuple[Model, list[float]]:
    """The model after ``iterations`` rounds, and the log-likelihood before each."""
    learnt = read.filter("NOT _held").select("_symbols")
    model, path = anchored(learnt, vocab, states), []
    base = vocab.shares()
    for _ in range(iterations):
        model, before = improved(learnt, model, base)
        path.append(before)
    return model, path


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES,
                iterations: int = ITERATIONS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    rows = (only(docs, _id=key, _text=text).withColumn("_held", doc_remainder(F.col("_id"), 10) == 0)
            .withColumn("_row", F.monotonically_increasing_id()))
    counts = written(word_counts(rows))
    vocab = vocabulary(counts, rows.filter("NOT _held").count())
    read = written(read_documents(rows, vocab))
    least = min(vocab.counts.values(), default=1 << 62) - 1
    model, _ = train(read, vocab, states, iterations)
    known = looked_up(read, counts, least)
    total = likelihoods(read, model)
    base_rest = math.log(vocab.tokens + 0.1 * (vocab.kinds + 1))
    sums = F.coalesce("_sum", F.lit(0.0))
    return (read.drop("_symbols", "_rare").join(total, "_row").join(known, "_row", "left").select(
        F.col("_id").alias(key), F.col("_held").alias("held_out"), F.col("_n").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_found", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        ((F.col("_base") + sums - F.col("_n") * F.lit(base_rest)) / LN10).alias("base_score"),
        ((F.col("_log") + F.col("_inner") + sums) / LN10).alias("score")))
