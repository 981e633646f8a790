"""Phrase collocation mining: phrases of two to four words that occur together far more often than their parts.

Method, a multikey three-way quicksort of suffix pointers to the greatest depth. Every word position of a piece points
at its suffix of at most four words. A first pass counts the words of each language; the frequent ones get numbers, and
every task knows the most frequent ``vocabulary`` of them (all, if there are no more), so that a suffix is four small
numbers. A suffix ends before its first infrequent word, since no frequent prefix contains one, and one left with a
single word is abandoned; words beyond the known ones travel beside the numbers as text. Equal suffixes of a run of
``CHUNK`` positions are combined with a weight before the shuffle, so a line or passage that many documents share costs
few rows. Suffixes are routed globally by their leading word; a leading word with many suffixes is split over as many
tasks as its rows need, by its second and third word. In a task, the suffixes of every leading word are partitioned at
once, round by round, into less, equal and greater than a pivot word at their depth; the weight of an equal partition is
the count of its prefix, a partition below ``least`` is abandoned, a frequent one goes one word deeper, up to four. Every
prefix of three or more words lies whole in one task, so its count is exact, as does one of two words unless its leading
word is split: then each task counts all of them, and Spark adds the parts up, as it does for one-word counts.

Scores: a candidate (two to four words, a = f >= ``least``) is cut after each of its first words; l and r are the counts
of both parts, score = floor(2 000 000 a / (l + r)), the lowest score counts, ties to the earliest cut. A candidate is
dropped when it lies contiguously inside any longer candidate (dropped or not) with 100 f(longer) >= 80 a. Every
language keeps its first ``top`` rows by score, a, phrase (UTF-8 bytes) - a ranked report. All counts are exact
integers (score in 38-digit decimals).

Fixed by the contract: A-Z lower-cased; pieces between ``[.,;:!?\\x0A-\\x0D]``; words are runs without space or tab;
occurrences overlap; counts per language, a null language is ``und``.

Defined cases: a null text is empty; empty texts and pieces give nothing; an empty table or one without a frequent
phrase gives an empty result; repeated rows count as often as they occur; other columns stay outside; very long texts
are counted whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemirror.llm.common import LOWER, UPPER, only
from tablemirror.operators.joins import lookup
from tablemirror.session import written

# Fixed values of the contract.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
LEAST = 30
LONGEST = 4
SCORE_SCALE = 2_000_000
INSIDE_PERCENT, OUTSIDE_PERCENT = 80, 100
TOP = 2000
TASK_ROWS = 400_000         # suffixes a quicksort task takes
VOCABULARY = 500_000        # frequent words that every task knows
CHUNK = 1 << 20             # word positions whose equal suffixes are combined
SLICE = 1 << 20             # bytes of a text that are taken into words at once
COUNTED = 500_000           # different words a task counts before it hands them on
END, SKIP = -1, -2          # no word follows; nothing between two spaces
# A-Z in lower case, every end of a piece as a line feed, a tab as a space: all of it ASCII, so bytes of UTF-8 can be mapped.
PLAIN = bytes.maketrans(UPPER.encode() + PIECE_ENDS + b"\t", LOWER.encode() + b"\n" * len(PIECE_ENDS) + b" ")
MIX = 2_654_435_761


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, with a line feed between pieces (and empty ones between spaces), slice by slice."""
    data = text.translate(PLAIN).replace(b"\n", b" \n ")
    start = 0
    while start < len(data):
        end = start + SLICE
        if end < len(data):
            space = data.rfind(b" ", start, end)
            space = space if space >= 0 else data.find(b" ", end)
            end = space + 1 if space >= 0 else len(data)
        yield data[start:end].split(b" ")
        start = end


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    return zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist())


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).view(pa.string())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, f of a task's texts, in parts."""
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            words.pop(b"", None)
            words.pop(b"\n", None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), _strings(list(words)),
                                              pa.array(list(words.values()), pa.int64())], names=["lang", "word", "f"])
        counts.clear()

    for batch in batches:
        for lang, text in _texts(batch):
            for part in tokens(text):
                counts.setdefault(lang, Counter()).update(part)
        if sum(map(len, counts.values())) >= COUNTED:
            yield from flush()
    yield from flush()


@dataclass
class Vocabulary:
    """The most frequent words; a word's number is its place."""

    langs: list[str]
    words: list[bytes]
    splits: np.ndarray          # among how many tasks the suffixes that a word leads are split
    closed: bool                # no other word is frequent

    def numbers(self) -> dict[str, dict[bytes, int]]:
        found: dict[str, dict[bytes, int]] = {}
        for i, (lang, word) in enumerate(zip(self.langs, self.words)):
            found.setdefault(lang, {})[word] = i
        return found


class _Numbers(dict):
    """Word -> number in one language. Of other words nothing is known if the vocabulary is closed; else each gets the next
    number behind the vocabulary, and ``others`` lists them."""

    def __init__(self, lang: str, known: dict[bytes, int], vocabulary: Vocabulary, others: dict[tuple[str, bytes], int]):
        super().__init__(known)
        self[b""], self[b"\n"] = SKIP, END
        self.lang, self.closed, self.first, self.others = lang, vocabulary.closed, len(vocabulary.words), others

    def __missing__(self, word: bytes) -> int:
        if self.closed:
            return END
        return self.others.setdefault((self.lang, word), self.first + len(self.others))


def _packed(columns: np.ndarray) -> bytes:
    """Numbers as all their first bytes, all their second bytes and so on, which compress well."""
    return columns.astype("<i4").reshape(-1).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(columns, -1)


def _blocks(codes: np.ndarray, others: list[tuple[str, bytes]], vocabulary: Vocabulary, tasks: int) -> pa.RecordBatch:
    """One row per task: the different suffixes of ``codes`` that it gets, with their weights."""
    known = len(vocabulary.words)
    shifted = np.concatenate([codes, np.full(LONGEST - 1, END)]).astype(np.int64)
    suffix = [shifted[i:i + len(codes)] for i in range(LONGEST)]
    rows = np.flatnonzero((suffix[0] >= 0) & (suffix[1] >= 0))
    suffix = [s[rows] for s in suffix]
    for i in range(2, LONGEST):
        suffix[i] = np.where(suffix[i - 1] >= 0, suffix[i], END)
    route = np.concatenate([np.arange(known, dtype=np.int64) * MIX,
                            np.array([zlib.crc32(lang.encode() + b"\0" + word) for lang, word in others], dtype=np.int64),
                            [0]]) & 0xFFFFFFFF                                  # the last one is END's
    splits = np.concatenate([vocabulary.splits, np.ones(len(others) + 1, dtype=np.int64)])[suffix[0]]
    part = (route[suffix[1]] * 31 + route[suffix[2]]) % 1_000_003 % splits
    task = (route[suffix[0]] % tasks + part) % tasks
    front, back = suffix[0] << 32 | suffix[1], (suffix[2] + 1) << 32 | (suffix[3] + 1)
    order = np.lexsort((back, front, task))
    front, back, task = front[order], back[order], task[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (front[1:] != front[:-1]) | (back[1:] != back[:-1]) | (task[1:] != task[:-1])
    at = np.flatnonzero(new)
    columns = np.stack([s[order[at]] for s in suffix] + [np.diff(np.r_[at, len(order)])])
    task = task[at]
    bounds = np.flatnonzero(np.r_[True, task[1:] != task[:-1]]) if len(task) else np.zeros(0, dtype=np.int64)
    data, langs, words = [], [], []
    for start, end in zip(bounds, np.r_[bounds[1:], len(task)]):
        block = columns[:, start:end].copy()
        far = block[:LONGEST] >= known
        used, places = np.unique(block[:LONGEST][far], return_inverse=True)
        block[:LONGEST][far] = known + places
        data.append(_packed(block))
        langs.append([others[u - known][0] for u in used])
        words.append([others[u - known][1] for u in used])
    return pa.RecordBatch.from_arrays([pa.array(task[bounds], pa.int64()), pa.array(data, pa.binary()),
                                       pa.array(langs, pa.list_(pa.string())), pa.array(words, pa.list_(pa.binary()))],
                                      names=["_task", "data", "langs", "words"])


def _suffixes(handle: Broadcast, tasks: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = handle.value
        known = vocabulary.numbers()
        numbers: dict[str, _Numbers] = {}
        others: dict[tuple[str, bytes], int] = {}
        found, size = [], 0
        for batch in batches:
            for lang, text in _texts(batch):
                if lang not in numbers:
                    numbers[lang] = _Numbers(lang, known.pop(lang, {}), vocabulary, others)
                for part in tokens(text):
                    codes = np.fromiter(map(numbers[lang].__getitem__, part), np.int32, len(part))
                    found.append(codes[codes != SKIP])
                    size += len(found[-1])
                found.append(np.array([END], dtype=np.int32))
                if size >= chunk:
                    yield _blocks(np.concatenate(found), list(others), vocabulary, tasks)
                    found, size = [], 0
                    others.clear()
        if size:
            yield _blocks(np.concatenate(found), list(others), vocabulary, tasks)
    return run


def frequent_prefixes(keys: np.ndarray, weight: np.ndarray, least: int, first: int, seed: int = 7) -> list[tuple[int, int, int]]:
    """Bulk multikey three-way quicksort of suffixes ``keys`` (rows of word codes, -1 past the end) with ``weight``.

    Returns (row, depth, count) for every equal partition at depth >= ``first`` whose weight is at least ``least``: the
    prefix keys[row, :depth + 1] occurs count times. Partitions below ``least`` are abandoned. It begins with the segments
    of rows that are equal in the first ``first`` words, whose counts are summed elsewhere.
    """
    rng = np.random.default_rng(seed)
    found: list[tuple[int, int, int]] = []
    columns = [np.ascontiguousarray(c) for c in keys.T]
    rows = np.lexsort(columns[:first][::-1]) if first else np.arange(len(keys))
    fresh = np.zeros(len(rows), dtype=bool)
    fresh[:1] = True
    for c in columns[:first]:
        fresh[1:] |= c[rows[1:]] != c[rows[:-1]]
    seg = np.cumsum(fresh) - 1                                  # segment of each active row; rows of a segment are contiguous
    depth = np.full(int(fresh.sum()), first, dtype=np.int64)
    flat = np.concatenate(columns) if len(keys) else np.zeros(0, dtype=np.int64)
    while len(rows):
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        sizes = np.diff(np.r_[starts, len(rows)])
        offset = depth * len(keys)
        pivots = flat[rows[starts + (rng.random(len(starts)) * sizes).astype(np.int64)] + offset]
        side = np.sign(flat[rows + offset[seg]] - pivots[seg]) + 1             # 0 less, 1 equal, 2 greater
        part = seg * 3 + side
        counts = np.bincount(part, weight[rows], 3 * len(starts)).astype(np.int64)     # exact below 2^53
        keep = counts >= least
        equal = np.arange(len(starts)) * 3 + 1
        ended = pivots < 0                                      # suffixes that end here extend nothing
        keep[equal[ended]] = False
        frequent = np.flatnonzero(keep[equal])
        shown = np.zeros(len(starts), dtype=np.int64)           # a row of each equal partition
        same = side == 1
        shown[seg[same]] = rows[same]
        found += zip(shown[frequent].tolist(), depth[frequent].tolist(), counts[equal[frequent]].tolist())
        keep[equal[depth + 1 >= len(columns)]] = False
        next_depth = np.repeat(depth, 3)
        next_depth[equal] += 1
        kept = keep[part]
        rows, part = rows[kept], (np.cumsum(keep) - 1)[part[kept]]
        # Few parts fit 16 bits, which numpy orders without comparing.
        order = np.argsort(part.astype(np.uint16) if keep.sum() <= 1 << 16 else part, kind="stable")
        rows, seg, depth = rows[order], part[order], next_depth[keep]
    return found


def _sorted_in_task(handle: Broadcast, least: int):
    def run(blocks: pa.Table) -> pa.Table:
        vocabulary = handle.value
        known = len(vocabulary.words)
        others: dict[tuple[str, bytes], int] = {}
        parts = []
        for data, langs, words in zip(*(blocks.column(c).to_pylist() for c in ("data", "langs", "words"))):
            part = _unpacked(data, LONGEST + 1)
            if words:
                numbers = np.array([others.setdefault(key, known + len(others)) for key in zip(langs, words)])
                far = part[:LONGEST] >= known
                part[:LONGEST][far] = numbers[part[:LONGEST][far] - known]
            parts.append(part)
        keys, weight = np.concatenate([p[:LONGEST] for p in parts], axis=1).T, np.concatenate([p[LONGEST] for p in parts])
        split = np.concatenate([vocabulary.splits > 1, np.zeros(len(others), dtype=bool)])
        found = [(keys[row, :depth + 1].tolist(), count) for row, depth, count in frequent_prefixes(keys, weight, least, first=1)
                 if depth > 1 or not split[keys[row, 0]]]
        # Two words of which the first is split over tasks: this task's part of their count.
        shared = split[keys[:, 0]]
        pairs, at = np.unique(keys[shared, 0].astype(np.int64) << 32 | keys[shared, 1], return_inverse=True)
        sums = np.bincount(at, weight[shared], len(pairs)).astype(np.int64)
        found += [([pair >> 32, pair & 0xFFFFFFFF], count) for pair, count in zip(pairs.tolist(), sums.tolist())]
        langs = vocabulary.langs + [lang for lang, _ in others]
        words = vocabulary.words + [word for _, word in others]
        return pa.table({"lang": pa.array([langs[k[0]] for k, _ in found], pa.string()),
                         "phrase": _strings([b" ".join([words[i] for i in k]) for k, _ in found]),
                         "m": pa.array([len(k) for k, _ in found], pa.int64()),
                         "f": pa.array([count for _, count in found], pa.int64())})
    return run


def quotient(num: Column, den: Column) -> Column:
    """floor(num / den) of non-negative integers, exactly, in 38-digit decimals."""
    big = "decimal(38,0)"
    num, den = num.cast(big), den.cast(big)
    return ((num - num % den) / den).cast("long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP,
                 task_rows: int = TASK_ROWS, vocabulary: int = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score for each language's best ``top`` collocations (see the module)."""
    rows = only(docs, text=text, lang=lang).select(F.coalesce("lang", F.lit("und")).alias("lang"),
                                                   F.coalesce("text", F.lit("")).alias("text"))
    counts = written(rows.mapInArrow(_word_counts, "lang string, word string, f long")
                     .groupBy("lang", "word").agg(F.sum("f").alias("f")))
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.filter(F.col("f") >= least)
    size = frequent.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("f"), F.lit(0)).alias("rows")).first()
    tasks = max(1, -(-size["rows"] // task_rows))
    known = frequent.orderBy(F.col("f").desc(), "lang", "word").limit(vocabulary).toArrow()     # bounded by ``vocabulary``
    splits = -(-known.column("f").to_numpy() // task_rows)
    handle = docs.sparkSession.sparkContext.broadcast(Vocabulary(
        known.column("lang").to_pylist(), known.column("word").cast(pa.binary()).to_pylist(), splits, size["words"] <= vocabulary))
    routed = rows.mapInArrow(_suffixes(handle, tasks, chunk), "_task long, data binary, langs array<string>, words array<binary>")
    deeper = (routed.groupBy("_task").applyInArrow(_sorted_in_task(handle, least), "lang string, phrase string, m long, f long")
              .groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).filter(F.col("f") >= least))
    phrases = written(frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).cast("long").alias("m"), "f")
                      .unionByName(deeper))

    candidates = phrases.filter(F.col("m") >= 2).select("lang", "phrase", "m", F.col("f").alias("a"),
                                                         F.split("phrase", " ", -1).alias("ws"))
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("m").cast("int") - 1),
        lambda k: F.struct(k.alias("k"), F.array_join(F.slice("ws", 1, k), " ").alias("left"),
                           F.array_join(F.slice("ws", k + 1, F.size("ws") - k), " ").alias("right")))).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.*")
    known = phrases.select("lang", "phrase", "f")
    cuts = lookup(cuts, known.withColumnRenamed("phrase", "left").withColumnRenamed("f", "l"), ["lang", "left"], how="inner")
    cuts = lookup(cuts, known.withColumnRenamed("phrase", "right").withColumnRenamed("f", "r"), ["lang", "right"], how="inner")
    cuts = cuts.withColumn("score", quotient(F.col("a") * F.lit(SCORE_SCALE).cast("decimal(38,0)"), F.col("l") + F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select(
        "lang", "phrase", "a", "b.score", "b.l", "b.r")

    inner = candidates.filter(F.col("m") >= 3).select("lang", "a", F.explode(F.filter(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("m").cast("int") - 1),
        lambda size: F.transform(F.sequence(F.lit(1), F.col("m").cast("int") - size + 1),
                                 lambda start: F.array_join(F.slice("ws", start, size), " ")))), lambda s: s.isNotNull())).alias("phrase"))
    outer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = best.join(outer, ["lang", "phrase"], "left").filter(
        F.col("outer").isNull() | (F.col("outer") * F.lit(OUTSIDE_PERCENT) < F.col("a") * F.lit(INSIDE_PERCENT)))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").cast("binary"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute_force_sql() -> str:
    """The same report in DuckDB: every n-gram of every piece counted, every candidate compared with every longer one."""
    return r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
    g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
    ng AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM g CROSS JOIN range(1, 5) AS mm(m) WHERE i + m - 1 <= len(ws)),
    f AS (SELECT lang, m, phrase, count(*) AS f FROM ng GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND f >= 30),
    ff AS (SELECT lang, phrase, f FROM f WHERE f >= 30),
    parts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:m], ' ') AS rp
              FROM c CROSS JOIN range(1, 4) AS kk(k) WHERE k < m),
    cut AS (SELECT parts.lang, parts.phrase, a, k, fl.f AS l, fr.f AS r, (2000000::HUGEINT * a) // (fl.f + fr.f) AS score
            FROM parts JOIN ff AS fl ON fl.lang = parts.lang AND fl.phrase = lp JOIN ff AS fr ON fr.lang = parts.lang AND fr.phrase = rp),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cut) WHERE o = 1),
    dom AS (SELECT DISTINCT s.lang, s.phrase FROM c AS s JOIN c AS b ON s.lang = b.lang AND b.m > s.m
            AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= 80 * s.a),
    res AS (SELECT best.*, n.n FROM best JOIN n USING (lang) ANTI JOIN dom USING (lang, phrase)),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM res)
    SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
           score::BIGINT AS score FROM r WHERE rank <= 2000"""
