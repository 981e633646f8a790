"""Token counts: batch encoding in Arrow functions that return lengths only, with batches balanced by bytes and long
texts cut at safe boundaries.

A scalar pandas function gets the texts of an Arrow batch and returns one count a text; ids never leave the task. Texts
longer than ``piece_chars`` are cut into pieces at places where the tokenizer's own splitting would cut too, so a piece
count adds up to the whole text's count: after a run of ASCII white space (normalisation folds white space into one
space and the pre-tokenizer drops it; no added token holds white space) or, in a run without white space, before an
ASCII digit (a digit is a pre-token of its own). A run longer than ``piece_chars`` without either is encoded whole. The
pieces of a batch are handed to the library in sub-batches of about ``batch_bytes`` UTF-8 bytes, so one call never
holds much more than that however the texts are spread.

Plain texts take a shorter way to the same counts. For the word file, a text of only printable ASCII, tab, line ends
and the Latin-1 letters (no added token's text in it) is unchanged by NFC, lower-cases alike in every library and
has the same character classes everywhere, so it is split into pre-tokens here, with the file's own pattern, and
each different word is priced once a task by the library's own BPE model (its bytes mapped as the byte-level step
maps them). The library's pre-tokenizer costs about as much as all the rest together. Tests compare both ways on
whole corpora.

Only tokenizer files of the ``tokenizers`` library (``.json``) and ``sentencepiece`` models (``.model``) are taken, by
their path in ``public_tokenizers``. Neither adds begin or end tokens; special strings inside a text are handled as
the library does by default (for a ``.json`` file an added token's text becomes that token). Texts for a ``.model``
file are encoded whole, as sentencepiece's word starts depend on the white space before them.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result; repeated rows
each get their row; a null id keeps its row; other columns of the table stay outside. ``n_bytes`` is the UTF-8 length.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tablemirror.llm.common import only

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
PIECE_CHARS = 1 << 16
BATCH_BYTES = 1 << 20
# A cut right after ASCII white space, or right before an ASCII digit.
SAFE = re.compile(r"[ \t\n\r\x0b\x0c]+|(?=[0-9])")
WHITE = re.compile(r"[ \t\n\r\x0b\x0c]+")
# Texts whose every character all libraries treat alike, and the word file's pre-token pattern, as written in it.
PLAIN = r"[\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*"
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_chars() -> list[str]:
    """The byte-level step's characters: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    chars = [""] * 256
    for b in own:
        chars[b] = chr(b)
    for n, b in enumerate(others):
        chars[b] = chr(256 + n)
    return chars


def safe_pieces(text: str, piece_chars: int, digits: bool = True) -> list[str]:
    """``text`` cut into pieces of at least ``piece_chars`` characters (the last may be shorter) at safe places."""
    found, pieces, start = (SAFE if digits else WHITE), [], 0
    while len(text) - start > piece_chars:
        m = found.search(text, start + piece_chars)
        if m is None:
            break
        cut = m.end() if m.end() > m.start() else m.start()
        if cut >= len(text):
            break
        pieces.append(text[start:cut])
        start = cut
    pieces.append(text[start:])
    return pieces


class Counter:
    """Counts tokens of texts with one tokenizer file; made once per task."""

    def __init__(self, name: str):
        import public_tokenizers
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # a task has one core
        path = public_tokenizers.path(name)
        if name.endswith(".json"):
            from tokenizers import Tokenizer
            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.lengths = lambda texts: [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            self.cuttable, self.digits = True, True
            import json
            import regex
            spec = json.load(open(path, encoding="utf-8"))
            added = [t["content"] for t in spec.get("added_tokens", [])]
            steps = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
            # The shorter way only for a file of this shape: NFC, white space, lower case; the pattern above.
            if all(k in steps for k in ('"NFC"', '"Lowercase"', '"ByteLevel"', json.dumps(PRE_TOKEN)[1:-1])):
                self.plain, self.split = regex.compile(PLAIN), regex.compile(PRE_TOKEN)
                self.added, self.chars, self.priced = added, byte_chars(), {}
        elif name.endswith(".model"):
            import sentencepiece
            self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(ids) for ids in self.tokenizer.encode(texts, num_threads=1)]
            self.cuttable, self.digits = False, False
        else:
            raise ValueError(f"{name}: only .json (tokenizers) and .model (sentencepiece) files are taken")

    plain = None

    def words(self, text: str) -> int:
        total = 0
        for word in self.split.findall(text.lower()):
            n = self.priced.get(word)
            if n is None:
                n = self.priced[word] = len(self.tokenizer.model.tokenize("".join(self.chars[b] for b in word.encode("utf-8"))))
            total += n
        return total

    def __call__(self, texts: list[str], piece_chars: int, batch_bytes: int) -> list[int]:
        owner, pieces = [], []
        counts = [0] * len(texts)
        for i, text in enumerate(texts):
            if self.plain is not None and self.plain.fullmatch(text) and not any(a in text for a in self.added):
                counts[i] = self.words(text)
                continue
            for piece in (safe_pieces(text, piece_chars, self.digits) if self.cuttable else [text]):
                owner.append(i)
                pieces.append(piece)
        batch, size = [], 0
        for k, piece in enumerate(pieces):
            batch.append(k)
            size += len(piece.encode("utf-8", "surrogatepass"))
            if size >= batch_bytes or k == len(pieces) - 1:
                for j, n in zip(batch, self.lengths([pieces[j] for j in batch])):
                    counts[owner[j]] += n
                batch, size = [], 0
        return counts


def token_lengths(tokenizer: str = TOKENIZER, piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES):
    """A column function: the number of tokens of a text column (null: 0)."""

    @pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = Counter(tokenizer)
        for texts in batches:
            yield pd.Series(count([t if isinstance(t, str) else "" for t in texts], piece_chars, batch_bytes), dtype="int64")

    return lengths


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
                 limit: int = LIMIT, piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row of ``docs``; no shuffle."""
    rows = only(docs, doc_id=key, text=text)
    counted = rows.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                          token_lengths(tokenizer, piece_chars, batch_bytes)(F.col("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
