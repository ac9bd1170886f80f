"""Specs: which source paths were read into which output paths, by which team, as one small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of spec files and of their fields.
GLOB = "{source_,sources_}*.json"
PAIR = "`source-path` string, `output-path` string, `domain-hints` string, filter string, mode string, team string, component string, default_step string, update_existing boolean"
SPEC = f"`root-directory` string, `model-home` string, `graph-url` string, `path-pairs` array<struct<{PAIR.replace(' string', ':string').replace(' boolean', ':boolean')}>>"


def read_specs(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each path pair of each spec file under a folder, in the order of the files' names and of the pairs: spec, position and their fields."""
    raw = spark.read.option("pathGlobFilter", GLOB).text(folder, wholetext=True).select(F.input_file_name().alias("spec"), F.from_json("value", SPEC).alias("s"))
    under = lambda c: F.col(c).alias(c.rpartition(".")[2].strip("`").replace("-", "_"))
    pairs = raw.select("spec", *[under(f"s.`{c}`") for c in ("root-directory", "model-home", "graph-url")], F.posexplode("s.`path-pairs`").alias("position", "p"))
    fields = [f.name for f in pairs.schema["p"].dataType.fields]
    return pairs.select(*[c for c in pairs.columns if c != "p"], *[under(f"p.`{f}`") for f in fields]).orderBy("spec", "position")
