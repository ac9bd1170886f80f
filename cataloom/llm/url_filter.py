"""URL filters: host/path rules first, then a logistic regression on hashed character n-grams of host and path.

DataFrame functions and Spark ML only. One narrow map over the pages: no shuffle, so hot hosts cost nothing extra.

Edge cases: a null URL, or one without ``://``, has an empty host and path, no rule, and is judged by the model's
intercept (allowed by the built-in table). Repeated rows give repeated results; extra columns of the input are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the production list: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: The labelled table: words that name unwanted sites, words that name others, and neutral words that stand beside both.
UNWANTED = """ads adserver adclick advert banner popup popunder clicktrack tracker tracking pixel telemetry affiliate casino slots roulette blackjack
 poker jackpot betting bets bookie wager lottery pills pharmacy viagra cialis meds steroids porn porno xxx sex sexcam nude adult
 escort hookup camgirls spam spammer bulkmail linkfarm backlinks clickbait warez cracked keygen torrents serialz phishing malware ransom
 payday quickcash loans replica counterfeit""".split()
WANTED = """news garden gardening library museum science history weather northern southern travel recipes kitchen school university
 college music theatre orchestra sports football health hospital clinic doctor city council parliament forum wiki docs developer software
 maps photo camera books bookshelf reading writing film cinema review birds mountain river forest ocean brothers mother father family
 anderson whitfield matthew catherine robinson heritage earth education foundation fiction auction journal magazine gallery studio
 anderes garten strasse verlag zeitung rathaus lichtung bibliothek wissenschaft wetter kirche schule
 periodico mercado viajes cocina escuela historia montana ciencia cancion biblioteca
 cuisine voyage jardin maison montagne theatral histoire lumiere bonheur aliments
 hotel restaurant bakery cafe market bank insurance post train airport bridge harbour island village farmhouse orchard vineyard
 architecture engineering chemistry physics biology mathematics astronomy geology painting sculpture pottery knitting sewing""".split()
NEUTRAL = "online best live club shop hub zone world pro now top house today daily direct guide home network center point".split()
#: Shapes of hosts (word, neutral word) and of paths.
HOSTS = ("{0}.{2}", "www.{0}.{2}", "{0}-{1}.{2}", "www.{1}-{0}.{2}", "blog.{0}{1}.{2}", "m.{1}{0}.{2}", "{1}.{0}.{2}", "cdn.{0}-{1}.{2}")
DOMAINS = "com net org info co.uk de fr es io".split()
PATHS = ("/", "/index.html", "/2024/05/a-day-in-may", "/en/about", "/products/item?id=7", "/de/seite/3", "/fr/page", "/es/inicio", "/img/a.png", "")
#: Width of the hashed feature space.
FEATURES = 1 << 15


def labelled_urls() -> list[tuple[str, str, float]]:
    """The small training table: host, path, 1.0 for unwanted. Every word comes in every shape of host, so shapes tell nothing."""
    rows = []
    for label, words in ((1.0, UNWANTED), (0.0, WANTED)):
        for i, word in enumerate(words):
            for j, shape in enumerate(HOSTS):
                k = i * len(HOSTS) + j
                rows.append((shape.format(word, NEUTRAL[k % len(NEUTRAL)], DOMAINS[k % len(DOMAINS)]), PATHS[k % len(PATHS)].partition("?")[0], label))
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased. Path: from there up to ``? #``. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def character_ngrams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """All character n-grams of ``^host$`` and of ``>path``, host and path kept apart by the marks."""
    grams = []
    for text, least in ((F.concat(F.lit("^"), host, F.lit("$")), 2), (F.concat(F.lit(">"), path), 1)):
        for n in sizes:
            starts = F.when(F.length(text) >= max(n, least + 1), F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
            grams.append(_cut(starts, text, n))
    return F.concat(*grams)


def _cut(starts: Column, text: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def train(spark: SparkSession, rows: list[tuple[str, str, float]] | None = None) -> LogisticRegressionModel:
    """Fits the regression on a labelled table (the built-in one by default), bounded by being a Python list."""
    table = spark.createDataFrame(rows or labelled_urls(), "host string, path string, label double").coalesce(1)
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=0.003, maxIter=50).fit(features(table))


def features(df: DataFrame) -> DataFrame:
    grams = df.withColumn("grams", character_ngrams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(grams).drop("grams")


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule list is a plan literal: keep it under about 1,000."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(pages: DataFrame, rules: tuple = RULES, model: LogisticRegressionModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page. Rules win over the model; score is the model's."""
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    scored = (model or train(pages.sparkSession)).transform(features(base))
    score = vector_to_array("probability")[1]
    ruled = matching_rule(F.col("host"), F.col("path"), rules)
    return scored.select(
        "page_id", "host", "path", ruled["rule"].alias("rule"),
        F.coalesce(ruled["verdict"], F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )
