"""Source divergence audit: how far each source's term distribution lies from the other sources of its language, and
which terms a source uses more than its language does.

Method, a pair-task sparse merge. Terms are counted per (lang, source) with combining before the shuffle, then each
group becomes one array of (term id, p) sorted by id, with p its smoothed share; a group's array is bounded by its
language's vocabulary, however many documents the group holds. Every unordered pair of sources of a language is one
task row that holds both arrays: a galloping intersection (the smaller array's ids searched in the larger one) prices
the terms both hold, each one-sided term is priced against the other side's p of a zero count, and the kept terms
neither side holds are priced together, as many times as they are. The price of a term is f = floor((p - q)^2 / (p + q))
and a pair's value is the sum over all kept terms, the same in both directions.

Fixed by the contract: terms are runs of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]`` with A-Z lower-cased; a language keeps
the terms found in at least 10 of its rows; p = 1 + floor(10^9 (count + 2) / (N + 2V)) with N the group's count over
kept terms and V their number. All arithmetic is exact (p in 38-digit decimals divided to an integer, f in 64 bits, as
p <= 10^9 + 1).

Output ``lang, source, part, item, value, rank``: part ``pair`` names every other source of the language (value 0 if
the language keeps no term; all ranks), part ``term`` the kept terms whose group p exceeds the language's (ranks to
10). Ranks run from 1 per (lang, source, part) by value descending, then the item's UTF-8 bytes ascending.

Defined cases: null text, lang or source count as ''; a group without terms still has its pair rows; a language with
one source has no pair rows; an empty table gives an empty result; repeated rows count as often as they occur; other
columns stay outside; very long texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemirror.llm.common import LOWER, UPPER, framed, only
from tablemirror.session import written

# Fixed values of the contract.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_ROWS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
# The characters between terms, all ASCII but the letters: one translate turns them into spaces and A-Z into a-z, and
# a split at single spaces (no regular expression at work) gives the runs of TERM.
SEPARATORS = "".join(chr(b) for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p = 1 + floor(SCALE (count + 2) / (total + 2 kept)), exactly: the remainder is taken off in decimals first, so the
    division leaves an integer, at most SCALE as count <= total and 2 <= 2 kept. Null where no term is kept."""
    big = "decimal(38,0)"
    num = (count.cast(big) + F.lit(2).cast(big)) * F.lit(SCALE).cast(big)
    den = total.cast(big) + kept.cast(big) * F.lit(2).cast(big)
    return F.when(den > 0, F.lit(1).cast("long") + ((num - F.try_mod(num, den)) / den).cast("long"))


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def gallop(small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ids of ``small`` in ``large`` (both sorted, distinct) and whether each was found."""
    at = np.searchsorted(large, small)
    found = at < len(large)
    found[found] = large[at[found]] == small[found]
    return at, found


def pair_value(a_ids, a_p, a_zero, b_ids, b_p, b_zero, kept: int) -> int:
    """Sum of f over all kept terms for two groups' sorted (id, p) arrays and their p of a zero count."""
    if kept == 0:
        return 0
    if len(a_ids) > len(b_ids):
        a_ids, a_p, a_zero, b_ids, b_p, b_zero = b_ids, b_p, b_zero, a_ids, a_p, a_zero
    at, found = gallop(a_ids, b_ids)
    in_b = np.zeros(len(b_ids), dtype=bool)
    in_b[at[found]] = True
    both = int(found.sum())
    total = int(price(a_p[found], b_p[at[found]]).sum())
    total += int(price(a_p[~found], np.int64(b_zero)).sum())
    total += int(price(np.int64(a_zero), b_p[~in_b]).sum())
    absent = kept - (len(a_ids) + len(b_ids) - both)
    return total + absent * int(price(np.int64(a_zero), np.int64(b_zero)))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          least_rows: int = LEAST_ROWS, top_terms: int = TOP_TERMS) -> DataFrame:
    """The divergence of every (lang, source) group: its pair and term rows, ranked (see the module)."""
    rows = only(docs, text=text, lang=lang, source=source).select(
        F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS)), " ", -1),
                 lambda t: t != "").alias("terms"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    groups = rows.select("lang", "source").distinct()
    in_rows = rows.select("lang", F.explode(F.array_distinct("terms")).alias("term")).groupBy("lang", "term").count()
    # Ids that only need to be distinct within a language; fixed once written.
    kept = written(in_rows.filter(F.col("count") >= least_rows).select("lang", "term", F.monotonically_increasing_id().alias("tid")))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("V"))
    counts = rows.select("lang", "source", F.explode("terms").alias("term")).groupBy("lang", "source", "term").count()
    counts = written(counts.join(kept, ["lang", "term"]))
    group_n = groups.join(counts.groupBy("lang", "source").agg(F.sum("count").alias("N")), ["lang", "source"], "left") \
        .join(sizes, "lang", "left").select("lang", "source", F.coalesce("N", F.lit(0)).alias("N"), F.coalesce("V", F.lit(0)).alias("V"))
    group_n = written(group_n)
    lang_counts = counts.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    lang_n = lang_counts.groupBy("lang").agg(F.sum("count").alias("LN"))

    valued = counts.join(group_n, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("N"), F.col("V")))
    lang_p = lang_counts.join(lang_n, "lang").join(sizes, "lang").select(
        "lang", "term", share(F.col("count"), F.col("LN"), F.col("V")).alias("q"))
    terms = (valued.join(lang_p, ["lang", "term"]).filter(F.col("p") > F.col("q"))
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     F.expr("(p - q) * (p - q) div (p + q)").alias("value")))
    terms = _ranked(terms).filter(F.col("rank") <= top_terms)

    arrays = valued.groupBy("lang", "source").agg(F.array_sort(F.collect_list(F.struct("tid", "p"))).alias("terms"))
    arrays = group_n.join(arrays, ["lang", "source"], "left").select(
        "lang", "source", "V", share(F.lit(0), F.col("N"), F.col("V")).alias("zero"),
        F.coalesce(F.col("terms.tid"), F.array().cast("array<long>")).alias("ids"),
        F.coalesce(F.col("terms.p"), F.array().cast("array<long>")).alias("ps"))
    names = group_n.select("lang", "source")
    pairs = (names.join(names.withColumnRenamed("source", "other"), "lang").filter(F.col("source") < F.col("other"))
             .join(arrays.select("lang", "source", "V", F.col("zero").alias("a_zero"), F.col("ids").alias("a_ids"),
                                 F.col("ps").alias("a_ps")), ["lang", "source"])
             .join(arrays.select("lang", F.col("source").alias("other"), F.col("zero").alias("b_zero"),
                                 F.col("ids").alias("b_ids"), F.col("ps").alias("b_ps")), ["lang", "other"]))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                value = pair_value(np.asarray(r.a_ids, dtype=np.int64), np.asarray(r.a_ps, dtype=np.int64), r.a_zero,
                                   np.asarray(r.b_ids, dtype=np.int64), np.asarray(r.b_ps, dtype=np.int64), r.b_zero, r.V)
                out.append((r.lang, r.source, r.other, value))
            yield framed(out, ["lang", "source", "other", "value"])

    valued_pairs = pairs.mapInPandas(merge, "lang string, source string, other string, value long")
    both_ways = valued_pairs.select("lang", "source", F.col("other").alias("item"), "value").unionByName(
        valued_pairs.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), "value"))
    pair_rows = _ranked(both_ways.withColumn("part", F.lit("pair")))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pair_rows.select(cols).unionByName(terms.select(cols))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").cast("binary"))
    return rows.withColumn("rank", F.row_number().over(order).cast("int"))


def brute_force_sql() -> str:
    """The same audit in DuckDB over dense (group, kept term) rows: every pair prices every kept term."""
    return r"""
    WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
    k AS (SELECT lang, term FROM (SELECT DISTINCT rid, lang, term FROM t) GROUP BY lang, term HAVING count(*) >= 10),
    v AS (SELECT lang, count(*) AS nv FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS cnt FROM t JOIN k USING (lang, term) GROUP BY ALL),
    gt AS (SELECT g.lang, g.source, k.term, coalesce(c.cnt, 0) AS cnt FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
    gn AS (SELECT lang, source, sum(cnt) AS n FROM gt GROUP BY ALL),
    gp AS (SELECT gt.*, 1 + (1000000000::HUGEINT * (cnt + 2)) // (n + 2 * nv) AS p FROM gt JOIN gn USING (lang, source) JOIN v USING (lang)),
    lt AS (SELECT lang, term, sum(cnt) AS cnt FROM gt GROUP BY ALL),
    ln AS (SELECT lang, sum(cnt) AS n FROM lt GROUP BY lang),
    lp AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (cnt + 2)) // (n + 2 * nv) AS q FROM lt JOIN ln USING (lang) JOIN v USING (lang)),
    pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
           FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
    tr AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
           FROM gp JOIN lp USING (lang, term) WHERE cnt > 0 AND p > q),
    u AS (SELECT * FROM pr UNION ALL SELECT * FROM tr),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
