"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents longer than the capacity are cut into full pieces, the shorter first piece holding the rest; nothing else is
cut. Pieces of the full length fill a sequence each. The others are packed in bulk-synchronous rounds:

* pieces are range-sorted by length and numbered within their length, gaps by size within theirs;
* a sweep from long to short gives every piece the smallest free gap that holds it (its successor); pieces that want the
  same gap are told apart by rank, the rest go on to the next larger gap, and each gap takes one piece a round;
* gaps shrink, pieces longer than any gap open new sequences - as many as their tokens need, the longest first - and the
  next round begins.

Lengths are whole numbers up to the capacity, so pieces of one length and gaps of one size are interchangeable. The
rounds therefore sweep runs of equal ranks: at most ``capacity`` runs of pieces, however many documents there are, and
only their counts reach the driver. The result of the rounds is a table of rank intervals; every piece finds its
sequence and offset by its length and rank in one join with that table. The ranking is distributed: rows are dealt by
hash over buckets also within one length, counted per bucket, and numbered inside buckets of bounded size.

Defined cases: a null or empty text is the end token alone; repeated rows and null ids are packed like any others; extra
columns are left out; an empty table gives no rows. Texts are tokenised whole.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemirror.llm.common import framed, only
from tablemirror.session import written

CAPACITY = 1024
END_ID = 2
BUCKET_ROWS = 20_000
# Within this range both tokenizer libraries agree on character classes; other texts go the slower way.
SIMPLE = re.compile(r"[\x00-ɏ‐-‧]*\Z")
# The faster library's pattern keeps a step of its stack per character of a run of white space, and stops when it is full.
RUN = 10_000
LONG_RUN = re.compile(rf"\s{{{RUN}}}")


class Encoder:
    """Ids of the byte-level BPE file. Plain Latin texts are encoded by the same ranks in the faster library; the
    tokenizer file itself, loaded when first needed, encodes all others, those that spell a special token, and those with
    very long runs of white space."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        self.file, self.exact = public_tokenizers.path(f"{name}.json"), None
        with open(self.file, encoding="utf-8") as text:
            self.special = [t["content"] for t in json.load(text)["added_tokens"]]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if (SIMPLE.match(text) and not any(s in text for s in self.special)
                and not (len(text) >= RUN and LONG_RUN.search(text))):
            return self.fast.encode_ordinary(text)
        if self.exact is None:
            from tokenizers import Tokenizer
            self.exact = Tokenizer.from_file(self.file)
        return self.exact.encode(text, add_special_tokens=False).ids


def pieces_of(count: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``count`` ids."""
    first = count % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, count, capacity)]


def pieces(docs: DataFrame, key: str, text: str, capacity: int, tokenizer: str, end_id: int, with_ids: bool) -> DataFrame:
    """_key, _piece, _start, _length, _crc of every piece, and its _ids if asked for."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(tokenizer)     # of this task alone, so that a worker keeps nothing
        for batch in batches:
            rows = []
            for k, t in zip(batch["_key"], batch["_text"], strict=True):
                ids = np.array([*encode(t or ""), end_id], "<u4")
                for i, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    part = ids[start:start + length]
                    rows.append((k, i, start, length, zlib.crc32(part.tobytes()), *([part.astype(np.int64)] if with_ids else [])))
            yield framed(rows, names)

    names = ["_key", "_piece", "_start", "_length", "_crc", *(["_ids"] if with_ids else [])]
    kind = docs.schema[key].dataType
    rows = only(docs, _key=key, _text=text).withColumn("_key", F.col("_key").cast("string"))
    schema = "_key string, _piece int, _start long, _length long, _crc long" + (", _ids array<long>" if with_ids else "")
    return rows.mapInPandas(cut, schema).withColumn("_key", F.col("_key").cast(kind))


def ranked(items: DataFrame, total: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add _rank: 0, 1, ... within each _length, without bringing a whole length together."""
    buckets = max(1, math.ceil(total / bucket_rows))
    # The hash covers the whole row, so copies of a document's length spread; repeated rows are told apart by number only.
    dealt = items.withColumn("_bucket", F.pmod(F.xxhash64("_key", "_piece", "_crc", "_salt"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_length", "_bucket").count().withColumn("_first", F.coalesce(F.sum("count").over(before), F.lit(0)))
    starts = starts.select(F.col("_length").alias("_l"), F.col("_bucket").alias("_b"), "_first")
    inside = Window.partitionBy("_length", "_bucket").orderBy("_key", "_piece", "_crc", "_salt")
    numbered = dealt.withColumn("_within", F.row_number().over(inside) - 1)
    return numbered.join(starts, (F.col("_length") == F.col("_l")) & (F.col("_bucket") == F.col("_b"))).withColumn(
        "_rank", F.col("_first") + F.col("_within")).drop("_bucket", "_within", "_first", "_l", "_b", "_salt")


def plan_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rank intervals (length, first rank, count, first sequence, offset): ``count`` pieces from ``first rank`` on go to
    as many sequences from ``first sequence`` on, all at ``offset``. Runs over counts per length only."""
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    waiting = {length: n for length, n in counts.items() if n > 0}
    placed = dict.fromkeys(waiting, 0)
    gaps: list[tuple[int, int, int]] = []       # (size, first sequence, count)

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        out.append((length, placed[length], n, sequence, offset))
        placed[length] += n
        waiting[length] -= n
        if not waiting[length]:
            del waiting[length]

    while waiting:
        # Pieces longer than any gap open sequences.
        widest = max((g[0] for g in gaps), default=0)
        homeless = sorted((x for x in waiting if x > widest), reverse=True)
        if homeless:
            opened = max(1, math.ceil(sum(x * waiting[x] for x in homeless) / capacity))
            opened = max(opened, sum(waiting[x] for x in homeless if 2 * x > capacity))     # no two of these fit together
            for length in homeless:
                n = min(opened, waiting[length])
                if not n:
                    break
                place(length, n, sequences, 0)
                if length < capacity:
                    gaps.append((capacity - length, sequences, n))
                sequences += n
                opened -= n
        # The sweep: gaps enter as lengths fall, so the one entered last is the smallest that fits.
        gaps.sort(reverse=True)
        free: list[tuple[int, int, int]] = []
        rest: list[tuple[int, int, int]] = []
        at = 0
        for length in sorted(waiting, reverse=True):
            while at < len(gaps) and gaps[at][0] >= length:
                free.append(gaps[at])
                at += 1
            while free and waiting.get(length):
                size, sequence, n = free.pop()
                used = min(n, waiting[length])
                place(length, used, sequence, capacity - size)
                if size > length:
                    rest.append((size - length, sequence, used))
                if n > used:
                    free.append((size, sequence + used, n - used))
        gaps = rest + free + gaps[at:]
        least = min(waiting, default=0)
        gaps = [g for g in gaps if g[0] >= least]
    return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         tokenizer: str = "byte_bpe_50k", end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of every piece (and its token ids)."""
    cutted = written(pieces(docs, key, text, capacity, tokenizer, end_id, with_ids).withColumn(
        "_salt", F.monotonically_increasing_id()))
    counts = {r["_length"]: r["count"] for r in cutted.groupBy("_length").count().collect()}
    rounds = plan_rounds(counts, capacity)
    spark = docs.sparkSession
    plan = spark.createDataFrame(rounds, "_len long, _from long, _count long, _sequence long, offset long")
    places = F.broadcast(plan)      # bounded by the capacity and the rounds, not by the documents
    found = ranked(cutted, sum(counts.values())).join(
        places, (F.col("_length") == F.col("_len")) & (F.col("_rank") >= F.col("_from"))
        & (F.col("_rank") < F.col("_from") + F.col("_count")))
    return found.select(F.col("_key").alias(key), F.col("_piece").alias("piece"), F.col("_start").alias("start"),
                        F.col("_length").alias("length"), F.col("_crc").alias("ids_crc32"),
                        (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset",
                        *(["_ids"] if with_ids else []))
