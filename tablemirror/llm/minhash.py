"""Near-duplicates by an inverted join over MinHash signature coordinates, confirmed on full shingle sets.

1. Every text becomes its set of distinct word shingles (64-bit hashes), the set's 128-bit fingerprint and a MinHash
   signature. Texts of equal sets are one node from here on, so copies never meet each other again.
2. Each node is posted under its (coordinate, value) pairs. Two signatures with at least ``matches`` equal coordinates
   share one of the first ``coordinates - matches + 1`` pairs in any common order; pairs are ordered by how often they
   occur in the corpus, rarest first, so most nodes end with pairs of their own and are posted nowhere.
3. Inside a posting list the signatures are compared, and a spanning forest of the pairs with at least ``matches`` equal
   coordinates is kept; its components are the candidate groups. (Lists that merely share a node would hang together in
   ever larger groups as the corpus grows.) Groups are cut into blocks; a task sees two blocks, counts signature collisions, skips pairs below ``matches`` or of impossible
   sizes, and confirms the rest on the full sets. It returns a spanning forest of the confirmed links, never all pairs.
   In a group of several blocks all members are first held against the first block; after that, members that are already
   in the group's largest component are not compared with each other.
4. Components over the links give the class of each text.

``matches`` is the largest number that a pair just at the threshold misses with a chance of at most ``miss`` (1e-5 for
the defaults: 17 of 32 coordinates at 0.85); confirmed links are exact.

Defined cases: null and empty texts, and texts of white space only, have no shingles and are linked with nothing; a text
with fewer words than a shingle is one shingle; a row without an id is linked with nothing, its component is null and it
is kept; rows that repeat an id are the same document; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.llm.common import framed, only, space_words
from tablemirror.llm.components import components
from tablemirror.operators.joins import lookup
from tablemirror.session import written

COORDINATES = 32
BLOCK = 512
MISS = 1e-5
_MIX = np.random.RandomState(7)
_A = (_MIX.randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _MIX.randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64)


def least_matches(coordinates: int, similarity: float, miss: float = MISS) -> int:
    """The largest m such that a pair of this similarity has fewer than m equal coordinates with chance <= miss."""
    below = 0.0
    for m in range(coordinates + 1):
        if below + (p := math.comb(coordinates, m) * similarity ** m * (1 - similarity) ** (coordinates - m)) > miss:
            return max(1, m)
        below += p
    return coordinates


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    hashed = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((hashed(b" ".join(s)) for s in zip(*(words[i:] for i in range(size)), strict=False)),
                                 np.uint64, len(words) - size + 1))


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Per coordinate the least hash, with the coordinate in its low bits."""
    out = np.empty(coordinates, np.uint64)
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at:at + 4096, None] * _A[None, :coordinates] + _B[None, :coordinates]
        part ^= part >> np.uint64(32)
        least = np.minimum(least, (part * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    out[:] = (least & ~np.uint64(255)) | np.arange(coordinates, dtype=np.uint64)
    return out.view(np.int64)


def sketches(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """_id, _n (set size), _set (fingerprint, null without shingles), _signature."""
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["_id"], batch["_text"], strict=True):
                s = shingle_set(text, size)
                rows.append((key, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None,
                             signature(s, coordinates) if len(s) else None))
            yield framed(rows, ["_id", "_n", "_set", "_signature"])

    # Ids travel as text, so that any type of id, and null, comes back unchanged.
    kind = docs.schema["_id"].dataType
    return (docs.select(F.col("_id").cast("string").alias("_id"), "_text")
            .mapInPandas(sketch, "_id string, _n long, _set binary, _signature array<long>")
            .withColumn("_id", F.col("_id").cast(kind)))


def postings(nodes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """_node, _token, _tokens: the posting lists' entries that candidates must share, and all pairs of the node that occur
    more than once: equal coordinates are among them."""
    tokens = nodes.select("_node", F.explode("_signature").alias("_token"))
    shared = tokens.groupBy("_token").count().filter("count > 1")
    kept = tokens.join(shared, "_token").groupBy("_node").agg(
        F.array_sort(F.collect_list(F.struct("count", "_token"))).alias("_shared"))
    # Pairs that occur once come first in the order and are posted nowhere.
    prefix = F.size("_shared") - F.lit(matches - 1)
    return kept.filter(prefix > 0).select(
        "_node", F.col("_shared._token").alias("_tokens"), F.explode(F.slice("_shared", 1, prefix)).alias("_t")).select(
        "_node", F.col("_t._token").alias("_token"), "_tokens")


def _signatures(tokens: pa.ListArray, coordinates: int) -> np.ndarray:
    """Rows of coordinates; one that is not given equals no other."""
    out = np.repeat(-1 - np.arange(len(tokens))[:, None], coordinates, axis=1)
    flat = tokens.flatten().to_numpy()
    out[np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy()), flat & 255] = flat
    return out


def _forest(signatures: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with enough equal coordinates; whoever is reached is not compared again."""
    links, left, open_ = [], np.arange(1, len(signatures)), [0]
    while len(left):
        if not open_:
            open_, left = [int(left[0])], left[1:]
            continue
        at = open_.pop()
        near = (signatures[left] == signatures[at]).sum(axis=1) >= matches
        if near.any():
            found = left[near].tolist()
            links += [(at, x) for x in found]
            open_ += found
            left = left[~near]
    return links


def signature_links(posted: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """_a, _b: a spanning forest, per posting list, of the nodes with enough equal coordinates."""
    kind = posted.schema["_node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(lists: pa.Table) -> pa.RecordBatch:
            tokens = lists.column("_token").to_numpy()
            signatures = _signatures(lists.column("_tokens").combine_chunks(), coordinates)
            starts = np.flatnonzero(np.r_[True, np.diff(tokens) != 0])
            sizes = np.diff(np.r_[starts, len(tokens)])
            twos = starts[sizes == 2]
            twos = twos[(signatures[twos] == signatures[twos + 1]).sum(axis=1) >= matches]
            pairs = [(twos, twos + 1)]
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                if found := _forest(signatures[start:start + size], matches):
                    a, b = np.array(found).T
                    pairs.append((a + start, b + start))
            nodes = lists.column("_node").combine_chunks()
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(np.concatenate(side))) for side in zip(*pairs)], names=["_a", "_b"])

        # Sorted by token; the last list of a batch may go on in the next one.
        kept: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = batch.column("_token").to_numpy()
            first, last = int(tokens[0]), int(np.searchsorted(tokens, tokens[-1]))
            if kept and last == 0 and kept[-1].column("_token")[-1].as_py() == first:
                kept.append(pa.Table.from_batches([batch]))
                continue
            kept.append(pa.Table.from_batches([batch.slice(0, last)]))
            if (whole := pa.concat_tables(kept)).num_rows:
                yield links(whole)
            kept = [pa.Table.from_batches([batch.slice(last)])]
        if kept:
            yield links(pa.concat_tables(kept))

    return (posted.select("_token", "_node", "_tokens").repartition("_token").sortWithinPartitions("_token")
            .mapInArrow(run, f"_a {kind}, _b {kind}"))


def candidate_groups(posted: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """node, component: nodes that hang together by pairs of similar signatures."""
    return components(signature_links(posted, coordinates, matches), "_a", "_b")


class Sets:
    """Shingle sets of a block, with an inverted index that counts common shingles with many members at once."""

    def __init__(self, frame: pd.DataFrame):
        self.nodes = frame["_node"].to_numpy()
        self.labels = frame["_label"].to_numpy()
        self.sets = [np.frombuffer(x, np.uint64) for x in frame["_shingles"]]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)
        self.signatures = np.array(frame["_signature"].tolist(), np.int64)
        flat = np.concatenate(self.sets)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]

    def common(self, shingles: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.flat, shingles, "left"), np.searchsorted(self.flat, shingles, "right")
        runs = high - low
        starts = np.repeat(low - np.concatenate(([0], np.cumsum(runs)[:-1])), runs)
        return np.bincount(self.owner[starts + np.arange(runs.sum())], minlength=len(self.sets))


def confirmed(left: Sets, right: Sets, same: bool, matches: int, percent: int) -> list[tuple]:
    """A spanning forest of the confirmed links between two blocks (or inside one)."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for i, (node, label, size) in enumerate(zip(left.nodes, left.labels, left.sizes, strict=True)):
        start = i + 1 if same else 0
        fits = (100 * np.minimum(size, right.sizes[start:]) >= percent * np.maximum(size, right.sizes[start:])) & (
            right.labels[start:] != label)
        at = np.flatnonzero(fits) + start
        at = at[(right.signatures[at] == left.signatures[i]).sum(axis=1) >= matches] if len(at) else at
        if not len(at):
            continue
        inter = right.common(left.sets[i])[at]
        for j in at[100 * inter >= percent * (size + right.sizes[at] - inter)]:
            # What is known to hang together already (by label) hangs together here too.
            a, b = find(("l", label)), find(("l", right.labels[j]))
            if a != b:
                parent[a] = b
                links.append((node, right.nodes[j]))
    return links


def check_blocks(members: DataFrame, pairs: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links (_a, _b) between blocks; ``pairs`` has _group, _left, _right (block numbers of a group)."""
    kind = members.schema["_node"].dataType.simpleString()
    inside = members.join(pairs.filter("_left = _right").select("_group", F.col("_left").alias("_block")).distinct(),
                          ["_group", "_block"])
    names = ["_a", "_b"]

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        sets = Sets(frame)
        return framed(confirmed(sets, sets, True, matches, percent), names)

    def across(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return framed(confirmed(Sets(a), Sets(b), False, matches, percent) if len(a) and len(b) else [], names)

    found = inside.groupBy("_group", "_block").applyInPandas(within, f"_a {kind}, _b {kind}")
    apart = written(pairs.filter("_left <> _right"))
    if not apart.take(1):
        return found
    key = ["_group", "_left", "_right"]
    sides = [members.withColumnRenamed("_block", side).join(apart, ["_group", side]).select(
        *[F.col(c).alias(c) for c in (*key, "_node", "_label", "_signature", "_shingles")]) for side in ("_left", "_right")]
    return found.unionByName(sides[0].groupBy(*key).cogroup(sides[1].groupBy(*key)).applyInPandas(across, f"_a {kind}, _b {kind}"))


def blocked(members: DataFrame, block: int) -> DataFrame:
    """Add _block: members of one label class of a group are dealt by hash over blocks of about ``block`` rows; _main
    tells the blocks of the group's largest label class."""
    sizes = members.groupBy("_group", "_label").agg(F.count(F.lit(1)).alias("_n"))
    main = sizes.groupBy("_group").agg(F.max(F.struct("_n", "_label")).alias("_top"), F.sum("_n").alias("_all"))
    main = main.select("_group", F.col("_top._label").alias("_top"), F.col("_top._n").alias("_most"), "_all")
    with_main = members.join(main, "_group")
    is_main = (F.col("_label") == F.col("_top")) & (F.col("_most") > 1)
    rest = F.col("_all") - F.when(F.col("_most") > 1, F.col("_most")).otherwise(0)
    count = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(block))).cast("int")     # noqa: E731
    hashed = F.xxhash64(F.col("_node"))
    return (with_main.withColumn("_main", is_main)
            .withColumn("_block", F.when(is_main, -1 - F.pmod(hashed, count(F.col("_most")))).otherwise(
                F.pmod(hashed, count(rest))).cast("int")).drop("_top", "_most", "_all"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85,
                    coordinates: int = COORDINATES, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id (smallest id reachable by links of ``percent`` % Jaccard), kept."""
    matches = least_matches(coordinates, percent / 100)
    rows = only(docs, _id=key, _text=text)
    sketched = written(sketches(rows, size, coordinates))
    nodes = written(sketched.filter("_set IS NOT NULL AND _id IS NOT NULL").groupBy("_set").agg(
        F.min("_id").alias("_node"), F.first("_signature").alias("_signature"), F.count(F.lit(1)).alias("_copies")))

    groups = written(candidate_groups(postings(nodes, coordinates, matches), coordinates, matches).select(
        F.col("node").alias("_node"), F.col("component").alias("_group")))
    wanted = groups.join(nodes.select("_node", "_signature", "_set"), "_node")
    full = with_shingles(rows, wanted, size)
    members = written(full.withColumn("_label", F.col("_node")))

    # First round: everything against the first block of its group.
    dealt = members.join(members.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")), "_group")
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
    counts = dealt.select("_group", "_blocks").distinct()
    stars = counts.select("_group", F.lit(0).alias("_left"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_right"))
    links = written(check_blocks(dealt, stars, matches, percent))
    classes = written(components(links, "_a", "_b"))
    large = written(counts.filter("_blocks > 1").select("_group"))
    if large.take(1):
        # Second round, in groups of several blocks: all pairs of blocks but those inside the largest class.
        again = members.drop("_label").join(large, "_group").join(classes, F.col("_node") == F.col("node"), "left")
        again = written(blocked(again.withColumn("_label", F.coalesce("component", "_node")).drop("node", "component"), block))
        numbers = again.select("_group", "_block").distinct()
        left, right = numbers.withColumnRenamed("_block", "_left"), numbers.select(F.col("_group"), F.col("_block").alias("_right"))
        pairs = left.join(right, "_group").filter("_left <= _right AND _right >= 0")
        links = links.unionByName(check_blocks(again.drop("_main"), pairs, matches, percent))
        classes = components(links, "_a", "_b")

    by_set = nodes.join(classes, F.col("_node") == F.col("node"), "left").filter("_copies > 1 OR component IS NOT NULL").select(
        "_set", F.coalesce("component", "_node").alias("_component"))
    found = lookup(sketched.select("_id", "_n", "_set"), by_set, ["_set"])
    component = F.coalesce("_component", "_id")
    return found.select(F.col("_id").alias(key), F.col("_n").alias("n_shingles"),
                        F.when(F.col("_id").isNotNull(), component).alias("component_id"),
                        F.when(F.col("_id").isNotNull(), F.col("_id") == component).otherwise(True).alias("kept"))


def with_shingles(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The full sets of the wanted nodes, made again from their texts: _node, _group, _signature, _shingles."""
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [shingle_set(text, size) for text in batch["_text"]]
            right = [xxhash.xxh3_128_digest(s.tobytes()) == x for s, x in zip(made, batch["_set"], strict=True)]
            out = batch[["_node", "_group", "_signature"]].assign(_shingles=[s.tobytes() for s in made])
            yield out[right]

    kind = wanted.schema["_node"].dataType.simpleString()
    found = lookup(rows.withColumnRenamed("_id", "_node"), wanted, ["_node"], how="inner")
    # A repeated id brings the same set again.
    return found.mapInPandas(sets, f"_node {kind}, _group {kind}, _signature array<long>, _shingles binary").dropDuplicates(["_node"])
