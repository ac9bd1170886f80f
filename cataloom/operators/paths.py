"""Paths: files of a tree, the newest report of a name, file names made from titles, and paths rewritten in reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.operators.keys import numbered, pick
from cataloom.operators.match import best_suffix


def scan(spark: SparkSession, folder: str, extensions: Sequence[str] = ()) -> DataFrame:
    """path, extension (upper case), mtime, bytes of the files in a tree, of the given extensions only if there are any. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    own = F.upper(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    out = files.select("path", own.alias("extension"), F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"))
    return out.where(F.col("extension").isin([e.upper() for e in extensions])) if extensions else out


def newest_reports(files: DataFrame, path: str = "path", stamp: str = "mtime") -> DataFrame:
    """(base, path): each report folder's file. ``base/base.md`` or ``.json`` and numbered parts ``base-1of3`` count; the newest wins, then the lesser path.

    A folder without such a file gives its newest file in markdown or JSON.
    """
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    base = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    stem = F.regexp_replace(name, r"\.(?:md|json)$", "")
    own = (stem == base) | (F.startswith(stem, F.concat(base, F.lit("-"))) & F.substr(stem, F.length(base) + 2).rlike(r"^.*of.*$"))
    found = files.withColumn("base", base).where((F.col("base") != "") & name.rlike(r"\.(?:md|json)$")).withColumn("__other", ~own)
    return pick(found, ["base"], [F.col("__other"), F.desc(stamp), F.col(path)]).select("base", path)


def file_name(title: Column) -> Column:
    """A title as a file name: lower case, words, digits, dashes and blanks only, blanks as underscores."""
    bare = F.regexp_replace(F.trim(F.lower(title)), r"(?U)[^\w\d\- ]+", "")
    return F.regexp_replace(bare, r"\s+", "_")


def file_names(records: DataFrame, title: str, position: str, extension: str, to: str = "file_name") -> DataFrame:
    """Distinct file names: the second of a name ends in ``_1``, the third in ``_2`` and so on."""
    named = numbered(records.withColumn("__file", file_name(F.coalesce(title, F.lit("unnamed_rule")))), ["__file"], [position], "__n")
    last = F.when(F.col("__n") == 1, "").otherwise(F.concat(F.lit("_"), (F.col("__n") - 1).cast("string")))
    return named.withColumn(to, F.concat("__file", last, F.lit(extension))).drop("__file", "__n")


def mentions(reports: DataFrame, report: str, text: str, pattern: str) -> DataFrame:
    """(report, path): the distinct paths that a report mentions, by a pattern with one group."""
    return reports.select(report, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))).alias("path"))


def rewrite(reports: DataFrame, report: str, text: str, pattern: str, known: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Reports with each path that they mention replaced by the known path that it stands for, and the changes (report, path, new_path).

    A longer path is replaced before one that is a part of it, and what was replaced isn't looked at again.
    """
    said = mentions(reports, report, text, pattern)
    found = best_suffix(said, "path", known, path).select("path", F.col("match").alias("new_path"))
    changes = said.join(found, "path").where("path <> new_path").select(report, "path", "new_path")
    order = F.array_sort(F.collect_list(F.struct((-F.length("path")).alias("n"), "path", "new_path"))).alias("__changes")
    joined = reports.join(changes.groupBy(report).agg(order), report, "left")
    none = F.array().cast("array<struct<n:int,path:string,new_path:string>>")
    numbered_ = F.transform(F.coalesce("__changes", none), lambda c, i: F.struct(c["path"].alias("path"), c["new_path"].alias("new_path"), F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x02")).alias("mark")))
    marked = F.aggregate(numbered_, F.col(text), lambda t, c: F.replace(t, c["path"], c["mark"]))
    joined = joined.withColumn("__marked", marked).withColumn("__numbered", numbered_)
    put = F.aggregate("__numbered", F.col("__marked"), lambda t, c: F.replace(t, c["mark"], c["new_path"]))
    return joined.withColumn(text, put).select(reports.columns), changes
