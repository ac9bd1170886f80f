"""Catalogs in JSON: a bare list, or an object with a version and the list; and their snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.text import as_flag
from cataloom.operators.keys import keep_last
from cataloom.schemas import LOGIC, MODEL, RENAMED


def _items(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """(position, item JSON) of a catalog file in any of its shapes."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json(F.regexp_replace("value", r"^\s+", ""), "array<string>")
    wrapped = F.from_json("value", ", ".join(f"{k} array<string>" for k in keys))
    found = F.coalesce(F.when(F.ltrim("value").startswith("["), listed), *[wrapped[k] for k in keys])
    checked = F.when(found.isNull(), F.raise_error(F.lit("a catalog is a list, or an object with one of: " + ", ".join(keys)))).otherwise(found)
    return raw.select(F.posexplode(checked).alias("position", "item"))


def _typed(items: DataFrame, schema: str) -> DataFrame:
    """Items as rows of a schema, old names taken over, with ``extras``: fields that the schema doesn't have."""
    fields = items.sparkSession.createDataFrame([], schema).schema
    known = [f.name for f in fields]
    old = [o for o, n in RENAMED.items() if n in known]
    parsed = F.from_json("item", fields)
    everything = F.from_json("item", "map<string,string>")
    out = items.select("position", parsed.alias("p"), everything.alias("m"), "item")
    columns = []
    for f in fields:
        was = [o for o in old if RENAMED[o] == f.name]
        value = F.col(f"p.{f.name}")
        for o in was:
            value = F.coalesce(value, F.from_json(F.concat(F.lit('{"x":'), F.get_json_object("item", f"$.{o}"), F.lit("}")), f"x {f.dataType.simpleString()}")["x"] if f.dataType.simpleString() != "string" else F.col("m")[o])
        if f.name == "archived":
            value = as_flag(F.col("m")["archived"])
        columns.append(value.alias(f.name))
    extras = F.map_filter("m", lambda k, v: ~k.isin(*known, *old))
    return out.select(*columns, "position", extras.alias("extras"))


def read_logics(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_items(spark, path, ("logics", "rules")), LOGIC)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_items(spark, path, ("models",)), MODEL)


def index_by_id(records: DataFrame) -> DataFrame:
    """One row an id; the last wins."""
    return keep_last(records.where("id is not null"), ["id"], "position").drop("first_position")


def read_categories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Leaf categories and groups."""
    raw = spark.read.text(path, wholetext=True)
    body = "id string, name string, groupId string, team string, type string, kind string, isGroup boolean, children array<string>, categories array<string>"
    schema = f"categories array<struct<{body}>>, ruleCategories array<struct<{body}>>, categoryGroups array<struct<id:string,name:string,archived:boolean,businessRelevant:boolean,categories:array<string>>>, ruleCategoryGroups array<struct<id:string,name:string,archived:boolean,businessRelevant:boolean,categories:array<string>>>"
    parsed = raw.select(F.from_json("value", schema).alias("p"))
    every = parsed.select(F.explode(F.coalesce("p.categories", "p.ruleCategories")).alias("c")).select("c.*")
    group = (F.coalesce("isGroup", F.lit(False))) | (F.lower(F.coalesce("type", "kind", F.lit(""))) == "group") | (F.coalesce(F.size("children"), F.lit(0)) > 0)
    groups = parsed.select(F.explode(F.coalesce("p.categoryGroups", "p.ruleCategoryGroups")).alias("g")).select("g.*")
    return every.where(~group).drop("children", "categories"), groups


def eligible_categories(leaves: DataFrame, groups: DataFrame, owners: DataFrame, owner: str = "owner") -> DataFrame:
    """(owner, category) that an owner may use: leaves outside archived groups, of no team or of the owner's (trimmed, case aside)."""
    gone = groups.where(F.coalesce("archived", F.lit(False))).select(F.col("id").alias("__g"))
    own = leaves.join(gone, F.col("groupId") == F.col("__g"), "left_anti").select(F.col("name").alias("category"), F.coalesce(F.lower(F.trim("team")), F.lit("")).alias("__team"))
    asks = owners.select(F.col(owner).alias("owner")).distinct()
    asks = asks.withColumn("__team", F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce(F.lower(F.trim("owner")), F.lit(""))))))
    return asks.join(own, "__team").select("owner", "category").distinct()


class Conflict(RuntimeError):
    """The catalog was written by somebody else meanwhile."""


class Snapshots:
    """A catalog as numbered Parquet snapshots under one folder, in any store that Spark writes to.

    A version is its folder ``v=N``; a writer names the version it read, and fails if another one is there by then.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def current(self) -> int:
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v={version or self.current()}")

    def write(self, df: DataFrame, read_version: int) -> int:
        """Writes the next version: into a folder of its own first, which then takes the version's name, or fails."""
        fs, path = self._fs()
        version = read_version + 1
        if self.current() != read_version:
            raise Conflict(f"version {read_version} was read, {self.current()} is there")
        staged = f"{self.folder}/_staged-{version}-{id(df):x}"
        df.write.mode("overwrite").parquet(staged)
        if fs.exists(path(f"{self.folder}/v={version}")) or not fs.rename(path(staged), path(f"{self.folder}/v={version}")):
            fs.delete(path(staged), True)
            raise Conflict(f"version {version} is there already")
        return version

    def restore(self, version: int) -> int:
        return self.write(self.read(version), self.current())


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes and sha256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_json(df: DataFrame, path: str, key: str, version: int) -> None:
    """A catalog as the one JSON document that other tools read; one task writes it row by row, as it is one file."""

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, first = [f'{{"version": {version}, {json.dumps(key)}: ['], True
        for batch in batches:
            for row in filter(None, batch.column(0).to_pylist()):
                lines.append(("" if first else ",") + row)
                first = False
            yield pa.RecordBatch.from_pydict({"value": lines})
            lines = []
        yield pa.RecordBatch.from_pydict({"value": [*lines, "]}"]})

    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    some = df.sparkSession.createDataFrame([(None,)], "value string").unionByName(rows).coalesce(1)  # a task even for an empty catalog
    some.mapInArrow(document, "value string").write.mode("overwrite").text(path)
