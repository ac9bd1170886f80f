"""Runs and documents: which run wrote which report, which records it gave, and which run is a source's latest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.text import normalise_text
from cataloom.operators.keys import numbered, pick
from cataloom.operators.match import containing
from cataloom.operators.upsert import MATERIAL


def latest_run_ids(runs: DataFrame, source: str = "source_path", stamp: str = "timestamp", position: str = "position", ids: str = "logic_ids") -> DataFrame:
    """(source, id): the ids of each source's newest run; of equal stamps the first run wins."""
    return pick(runs, [source], [F.desc(stamp), F.col(position)]).select(source, F.explode(ids).alias("id"))


def runs_of_documents(documents: DataFrame, document: str, text: str, runs: DataFrame, run: str, response: str) -> DataFrame:
    """(run, document) where a run's response contains a document, both normalised."""
    d = documents.select(F.col(document).alias("document"), normalise_text(F.col(text)).alias("part"))
    r = runs.select(F.col(run).alias("run"), normalise_text(F.col(response)).alias("body"))
    return containing(r, "run", "body", d, "document", "part")


def overlap_scores(headings: DataFrame, document: str, heading: str, runs: DataFrame, run: str, response: str) -> DataFrame:
    """(document, run, score): how many of a document's headings a run's response contains."""
    parts = headings.select(F.col(document).alias("document"), F.col(heading).alias("part")).distinct()
    numbered = parts.select("document", "part").withColumn("id", F.to_json(F.struct("document", "part")))
    hits = containing(runs.select(F.col(run).alias("run"), F.col(response).alias("body")), "run", "body", numbered, "id", "part")
    return hits.join(numbered, "id").groupBy("document", "run").agg(F.count("*").alias("score"))


def best_series(runs: DataFrame, keys: list[str], total: str = "total", index: str = "index", stamp: str = "timestamp", position: str = "position") -> DataFrame:
    """Of runs that each wrote one file of a series: the best series of each key, and its latest run for each index.

    A series is what shares a total; the best has the most distinct indices, then a total at all, then the newest run.
    """
    series = runs.groupBy(*keys, total).agg(F.count_distinct(index).alias("__n"), F.max(stamp).alias("__newest"))
    best = pick(series, keys, [F.desc("__n"), F.desc(F.col(total).isNotNull()), F.desc("__newest"), F.col(total)]).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(total).alias("__total"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col(total).eqNullSafe(F.col("__total"))]
    own = runs.join(best, on).drop("__total", *[f"__{k}" for k in keys])
    return pick(own, [*keys, index], [F.desc(stamp), F.col(position)])


def _tail(path: Column) -> Column:
    """The last two components of a path, case aside."""
    parts = F.filter(F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    return F.lower(F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), F.least(F.size(parts), F.lit(2))), "/"))


def prior_runs(reports: DataFrame, runs: DataFrame, report: str = "path", text: str = "text") -> DataFrame:
    """(report, turn, timestamp, response_text): the run that wrote each report (turn 1), then the runs before it of the same source and output, oldest first.

    The run that wrote it is the newest whose response contains the report, of those whose output file ends in the report's folder and name. Reports
    and runs meet by that end, never text by text. ``runs`` has root_dir, source_path, output_path, output_file, timestamp, run_time, mtime, log_file, frame and
    response_text; reports without such a run have no rows.
    """
    place = ["root_dir", "source_path", "output_path"]
    r = runs.where(F.trim("response_text") != "").withColumn("__tail", _tail(F.col("output_file"))).where("__tail <> ''")
    d = reports.select(F.col(report).alias("__report"), normalise_text(F.col(text)).alias("__said"), _tail(F.col(report)).alias("__tail")).where("__said <> ''")
    wrote = d.join(r, "__tail").where(normalise_text(F.col("response_text")).contains(F.col("__said")))
    newest = [F.desc_nulls_last("run_time"), F.desc("mtime"), F.col("log_file"), F.col("frame")]
    anchor = pick(wrote, ["__report"], newest).where(" and ".join(f"{c} <> ''" for c in place))
    first = anchor.select(F.col("__report").alias(report), F.lit(1).cast("long").alias("turn"), "timestamp", F.trim("response_text").alias("response_text"))
    asked = anchor.select("__report", "__tail", *place, F.col("run_time").alias("__until"))
    earlier = r.join(asked, ["__tail", *place]).where("run_time < __until or (run_time is null and __until is not null)")
    turned = numbered(earlier.select("__report", "run_time", "mtime", "log_file", "frame", "timestamp", F.trim("response_text").alias("response_text")), ["__report"], ["run_time", "mtime", "log_file", "frame"], "turn")
    return first.unionByName(turned.select(F.col("__report").alias(report), (F.col("turn") + 1).alias("turn"), "timestamp", "response_text"))


def replay(sections: DataFrame, existing: DataFrame, name: str = "name", stamp: str = "timestamp", material: Sequence[str] = MATERIAL) -> DataFrame:
    """The sections that an ordered replay leaves in the catalog, one a name.

    ``sections`` come by turn (0: the report itself, then its runs as ``prior_runs`` has them) and position. Each is judged as in an ingest, against
    the catalog as it was: only names of the catalog or of the report itself count, a known (name, stamp) is passed over, and so is what is not newer and changes
    nothing material. What is taken overwrites what was taken before, so an older run that differs wins over the report.
    """
    old = existing.groupBy(F.col(name).alias("__name")).agg(F.max_by(F.struct(F.col(stamp).alias("stamp"), F.struct(*material).alias("m")), stamp).alias("__old"))
    current = sections.where("turn = 0").select(F.col(name).alias("__current")).distinct()
    own = sections.where(F.trim(name) != "").join(old, F.col(name) == F.col("__name"), "left").join(current, F.col(name) == F.col("__current"), "left")
    own = own.where("__name is not null or __current is not null")
    first = F.struct("turn", "position")
    known = own.groupBy(F.col(name).alias("__n"), F.col(stamp).alias("__s")).agg(F.min(first).alias("__first"))
    own = own.join(known, (F.col(name) == F.col("__n")) & (F.col(stamp) == F.col("__s")), "left")
    seen = F.when(F.col("__name").isNull(), first > F.col("__first")).otherwise(F.col("__old.stamp") == F.col(stamp))
    unchanged = (F.col("__old.stamp") >= F.col(stamp)) & F.struct(*material).eqNullSafe(F.col("__old.m"))
    taken = own.where(~F.coalesce(seen, F.lit(False)) & ~F.coalesce(unchanged, F.lit(False)))
    return taken.groupBy(name).agg(F.max_by(F.struct(*[c for c in sections.columns if c != name]), first).alias("__r")).select(name, "__r.*")


def run_positions(runs: DataFrame) -> DataFrame:
    """Numbers runs by time, newest first, within their source."""
    return runs.withColumn("position", F.row_number().over(Window.partitionBy("source_path").orderBy(F.desc("run_time"), F.desc("mtime"), "log_file", "frame")))
