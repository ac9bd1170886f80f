"""Back from a backup: single links, whole records, models and their hierarchies. Two catalogs, compared and joined as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions.text import blank
from cataloom.operators.keys import numbered, pick
from cataloom.operators.upsert import LINK_KEY


def removed_links(current: DataFrame, backup: DataFrame, logics: DataFrame, owner: str = "owner", key: Sequence[str] = LINK_KEY) -> DataFrame:
    """Links of the backup that their logic, which is still there, no longer has; ``restorable`` where the source is there too and no field is blank.

    ``current`` and ``backup`` are tables of links; ``logics(id)`` are the current ones.
    """
    ids = logics.select(F.col("id").alias("__id")).distinct()
    canonical = lambda df: df.withColumns({k: F.trim(F.coalesce(k, F.lit(""))) for k in key})
    gone = canonical(backup).join(canonical(current).select(owner, *key).distinct(), [owner, *key], "left_anti").dropDuplicates([owner, *key])
    here = gone.join(ids, F.col(owner) == F.col("__id"), "left_semi")
    sourced = here.join(ids, F.col(key[0]) == F.col("__id"), "left")
    whole = F.forall(F.array(*key), lambda v: v != "")
    return sourced.withColumn("restorable", F.col("__id").isNotNull() & whole).drop("__id")


def restore_links(current: DataFrame, backup: DataFrame, logics: DataFrame, chosen: DataFrame | None = None, owner: str = "owner", key: Sequence[str] = LINK_KEY) -> DataFrame:
    """The current links and the restorable ones, all of them or those that ``chosen`` (owner and key) names."""
    back = removed_links(current, backup, logics, owner, key).where("restorable").drop("restorable")
    if chosen is not None:
        back = back.join(chosen.select(owner, *key).distinct(), [owner, *key], "left_semi")
    return current.unionByName(back.select(current.columns))


def restore_logics(current: DataFrame, backup: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The current records with the wanted ones of the backup, and the wanted ids that were refused, with the reason."""
    asked = wanted.select("id").distinct()
    back = backup.join(asked, "id", "left_semi").join(current.select("id"), "id", "left_anti")
    state = asked.join(current.select("id", F.lit(True).alias("__here")).distinct(), "id", "left").join(backup.select("id", F.lit(True).alias("__there")).distinct(), "id", "left")
    refused = state.select("id", F.when(F.col("__here"), "is there").when(F.col("__there").isNull(), "not in the backup").alias("reason")).where("reason is not null")
    return current.unionByName(pick(back, ["id"], [F.col("id")]).select(current.columns)), refused


def find_models(current: DataFrame, backup: DataFrame) -> DataFrame:
    """(id, backup_id): each model's counterpart, by id, else by name; without one null."""
    by_id = backup.select(F.col("id").alias("__id")).where("__id is not null").distinct()
    by_name = backup.where(~blank(F.col("name"))).groupBy(F.col("name").alias("__name")).agg(F.min("id").alias("__named"))
    joined = current.join(by_id, F.col("id") == F.col("__id"), "left").join(by_name, F.col("name") == F.col("__name"), "left")
    return joined.select("id", F.coalesce("__id", "__named").alias("backup_id"))


def find_hierarchies(current: DataFrame, backup: DataFrame, model: str = "model") -> DataFrame:
    """(model, position, backup_position): each hierarchy's counterpart of its model, by top id, else by name, else at the same position."""
    index = lambda c: backup.where(~blank(F.col(c))).groupBy(F.col(model).alias("__m"), F.col(c).alias("__k")).agg(F.min("position").alias("__at"))
    out = current.select(model, "position", "topId", "name")
    for c in ("topId", "name"):
        own = index(c).select("__m", "__k", F.col("__at").alias(f"__by_{c}"))
        out = out.join(own, (F.col(model) == F.col("__m")) & (F.col(c) == F.col("__k")), "left").drop("__m", "__k")
    same = backup.select(F.col(model).alias("__m"), F.col("position").alias("__same")).distinct()
    out = out.join(same, (F.col(model) == F.col("__m")) & (F.col("position") == F.col("__same")), "left")
    return out.select(model, "position", F.coalesce("__by_topId", "__by_name", "__same").alias("backup_position"))


def restore_hierarchies(current: DataFrame, backup: DataFrame, model: str = "model") -> DataFrame:
    """Hierarchies as they were in the backup where it has a counterpart, else as they are."""
    columns = [c for c in current.columns if c not in (model, "position")]
    was = backup.select(F.col(model).alias("__m"), F.col("position").alias("__at"), F.struct(*columns).alias("__was"))
    found = find_hierarchies(current, backup, model)
    joined = current.join(found, [model, "position"]).join(was, (F.col(model) == F.col("__m")) & (F.col("backup_position") == F.col("__at")), "left")
    chosen = F.when(F.col("__was").isNotNull(), F.col("__was")).otherwise(F.struct(*columns))
    return joined.select(model, "position", chosen.alias("h")).select(model, "position", "h.*")


def restore_members(current: DataFrame, backup: DataFrame, model: str = "model", id_: str = "id") -> DataFrame:
    """(model, id, state) of members: what the backup has in its order, then what only the current model has; state is kept, restored or retained."""
    sides = current.select(model, id_, F.lit(1).alias("__side")).unionByName(backup.select(model, id_, F.lit(2).alias("__side")))
    both = sides.groupBy(model, id_).agg(F.bit_or("__side").alias("__sides"))
    return both.select(model, id_, F.when(F.col("__sides") == 3, "kept").when(F.col("__sides") == 2, "restored").otherwise("retained").alias("state"))


def check_manifest(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state) of files against a backup's manifest: same, changed, missing or new."""
    a = manifest.select("path", F.struct("bytes", "sha256").alias("__was"))
    b = now.select("path", F.struct("bytes", "sha256").alias("__is"))
    state = F.when(F.col("__is").isNull(), "missing").when(F.col("__was").isNull(), "new").when(F.col("__is").eqNullSafe(F.col("__was")), "same").otherwise("changed")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def backup_order(backups: DataFrame) -> DataFrame:
    """Backups (name, created_at, mtime in seconds), newest first: by their manifest's ``YYYYMMDD-HHMMSS`` as a number, else by the file's time in milliseconds, then by name."""
    return backups.orderBy(F.desc(_made()), F.desc("name"))


def numbered_backups(backups: DataFrame) -> DataFrame:
    """Backups with their ``place`` in that order, from 1. Rows are dealt by ranges of it, so no task has more than its range."""
    ranks = backups.withColumns({"__made": _made(), "__all": F.lit(0)})
    return numbered(ranks, ["__all"], [F.desc("__made"), F.desc("name")], "place").drop("__made", "__all")


def _made() -> Column:
    stamp = r"^(\d{8}).(\d{6})"
    made = F.when(F.trim("created_at").rlike(stamp), F.concat(F.regexp_extract(F.trim("created_at"), stamp, 1), F.regexp_extract(F.trim("created_at"), stamp, 2)).cast("long"))
    return F.coalesce(made, (F.col("mtime") * 1000).cast("long"))
