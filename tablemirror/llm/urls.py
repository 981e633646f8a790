"""URL filter: fixed host and path rules, then logistic regression on hashed character n-grams.

The regression learns from a small labelled URL table and judges whatever no rule fits. Everything is
column expressions and Spark ML; a row never leaves its partition.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict
the model gives for no n-grams at all (its intercept). Repeated rows each get their row; a null page id keeps its
row; other columns stay outside; an empty table gives an empty result; very long urls are judged whole.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemirror.llm.common import LOWER, UPPER, only

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BUCKETS = 1 << 14
SIZES = (3, 4, 5)

_BLOCK_HOSTS = (
    "cheap-watches", "cheap-meds-online", "best-pills-shop", "pills4less", "buy-pills-now", "discount-viagra",
    "casino-royal-bonus", "online-casino", "casino-spin-win", "big-win-slots", "lucky-slots", "poker-bets",
    "free-bets-today", "sport-bets-vip", "betting-tips-win", "jackpot-win", "spam-links", "link-farm", "seo-farm",
    "content-farm-hub", "spammy-deals", "adult-cams", "xxx-videos", "hot-porn-tube", "payday-loans-fast",
    "quick-cash-loans", "earn-money-fast", "crypto-doubler", "free-iphone-prize", "you-won-prize", "replica-bags",
    "weight-loss-miracle", "keygen-warez", "cracked-software", "torrent-movies-free", "click-bait-ads")
_ALLOW_HOSTS = (
    "morning-news", "city-library", "university", "physics-dept", "history-museum", "weather-report", "open-data",
    "garden-club", "recipes", "travel-notes", "health-institute", "school-board", "parliament", "archive",
    "science-review", "tech-notes", "programming", "book-reviews", "music-school", "art-gallery", "chess-club",
    "hiking-trails", "local-history", "bird-watching", "astronomy", "mathematics", "language-course", "thoughts",
    "the-other-theatre", "northern-lights", "river-restoration", "this-and-that", "interior", "station",
    "nation-today", "heath", "thread", "northwind", "thistle", "theorem", "southern-star", "anthem", "hand-made",
    "leather", "ontario", "oratory", "breathing", "earth-watch", "estates", "winery")
_TOPS = ("example.com", "example.net", "example.org")
_PATHS = ("/en/{0}", "/fr/{0}.html", "/de/{0}/", "/es/{0}")


def labelled_urls() -> list[tuple[str, float]]:
    """The training table: (url, 1.0 = block), every host under the same sites and paths, so that only the
    host's own name tells the classes apart."""
    rows = []
    for label, hosts in ((1.0, _BLOCK_HOSTS), (0.0, _ALLOW_HOSTS)):
        for i, host in enumerate(hosts):
            for j, prefix in enumerate(("", "www.", "blog.", "m.")):
                path = _PATHS[(i + j) % len(_PATHS)].format(37 * i % 991 + j)
                rows.append((f"https://{prefix}{host}.{_TOPS[(i + j) % 3]}{path}", label))
    return rows


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, site, start in sorted(rules, key=lambda r: len(r[1] + r[2])):     # the longest is tested first
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(site + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(letters: Column, n: int, mark: str) -> Column:
    grams = F.transform(letters, lambda c, i: F.concat(F.lit(mark), F.array_join(F.slice(letters, i + 1, n), "")))
    return F.filter(grams, lambda g: F.length(g) == n + 1)


def ngrams(host: Column, path: Column, sizes=SIZES) -> Column:
    """Character n-grams of host and path, marked by part, with part ends included."""
    marked = [(mark, F.split(F.concat(F.lit("^"), text, F.lit("$")), "")) for mark, text in (("h", host), ("p", path))]
    return F.concat(*[_grams(letters, n, mark) for mark, letters in marked for n in sizes])


def _features(df: DataFrame, buckets: int) -> DataFrame:
    grams = df.withColumn("_grams", ngrams(F.col("_host"), F.col("_path")))
    return HashingTF(numFeatures=buckets, binary=True, inputCol="_grams", outputCol="_features").transform(grams)


def fit_url_model(spark: SparkSession, table: list[tuple[str, float]] | None = None, buckets: int = BUCKETS,
                  penalty: float = 0.01) -> LogisticRegressionModel:
    """Logistic regression over the hashed n-grams of the labelled table (a few hundred rows)."""
    rows = spark.createDataFrame(table or labelled_urls(), "url string, label double")
    parts = rows.select("label", host_of(F.col("url")).alias("_host"), path_of(F.col("url")).alias("_path"))
    train = _features(parts, buckets).select("label", "_features").coalesce(1)
    return LogisticRegression(featuresCol="_features", regParam=penalty, maxIter=50, standardization=False).fit(train)


def url_filter(pages: DataFrame, rules=RULES, model: LogisticRegressionModel | None = None, key: str = "page_id",
               url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``key``, host, path, rule, verdict and the model's probability of a block (``block_score``)."""
    model = model or fit_url_model(pages.sparkSession)
    parts = (only(pages, _key=key, _url=url)
             .select("_key", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path")))
    model = model.copy().setProbabilityCol("_probability").setRawPredictionCol("").setPredictionCol("")
    scored = model.transform(_features(parts, model.numFeatures))
    score = vector_to_array("_probability")[1]
    found = matching_rule(F.col("_host"), F.col("_path"), rules)
    return (scored.select("_key", "_host", "_path", found.alias("_found"), score.alias("_score"))
            .select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"),
                    F.col("_found.rule").alias("rule"),
                    F.coalesce(F.col("_found.verdict"),
                               F.when(F.col("_score") >= threshold, "block").otherwise("allow")).alias("verdict"),
                    F.col("_score").alias("block_score")))
