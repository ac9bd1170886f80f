"""Names to ids, and lookups by name or id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_index(targets: DataFrame, name: str, id_: str, ignore_case: bool = False, priority: str | None = None) -> DataFrame:
    """(__name, __id), one id a name: the one of least priority, then the least id."""
    key = F.lower(F.col(name)) if ignore_case else F.col(name)
    order = F.struct(F.col(priority) if priority else F.lit(0), F.col(id_))
    return targets.groupBy(key.alias("__name")).agg(F.min_by(F.col(id_), order).alias("__id"))


def resolve(refs: DataFrame, ref: str, targets: DataFrame, name: str, id_: str, to: str, ignore_case: bool = False, priority: str | None = None) -> DataFrame:
    """Adds the id that a reference's name stands for, or null."""
    index = name_index(targets, name, id_, ignore_case, priority)
    key = F.lower(F.col(ref)) if ignore_case else F.col(ref)
    return refs.join(index, key == F.col("__name"), "left").withColumnRenamed("__id", to).drop("__name")


def resolve_in_scope(refs: DataFrame, ref: str, existing: DataFrame, generated: DataFrame, to: str, scope: DataFrame | None = None) -> DataFrame:
    """Adds the id that a name stands for, case aside: among existing records of the scope (ids), else among generated ones, which only fill gaps."""
    own = existing.join(scope.select(F.col("id")).distinct(), "id", "left_semi") if scope is not None else existing
    both = own.select("id", "name", F.lit(0).alias("__rank")).unionByName(generated.select("id", "name", F.lit(1).alias("__rank")))
    return resolve(refs, ref, both, "name", "id", to, ignore_case=True, priority="__rank")


def names_of(refs: DataFrame, id_: str, records: DataFrame, to: str) -> DataFrame:
    """Adds the name of an id, null where it isn't known; the export's inverse of ``resolve``."""
    index = records.groupBy(F.col("id").alias("__id")).agg(F.min("name").alias("__name"))
    return refs.join(index, F.col(id_) == F.col("__id"), "left").withColumnRenamed("__name", to).drop("__id")


def unambiguous(targets: DataFrame, name: str, id_: str) -> DataFrame:
    """(__name, __id) of names that stand for exactly one id."""
    return targets.groupBy(F.col(name).alias("__name")).agg(F.count("*").alias("__n"), F.min(id_).alias("__id")).where("__n = 1").drop("__n")


def resolve_unambiguous(refs: DataFrame, candidates: list[str], targets: DataFrame, name: str, id_: str, to: str) -> DataFrame:
    """Adds the id of the first of several candidate names that stands for exactly one."""
    index = unambiguous(targets, name, id_)
    found: list[Column] = []
    for i, c in enumerate(candidates):
        own = index.select(F.col("__name").alias(f"__name{i}"), F.col("__id").alias(f"__id{i}"))
        refs = refs.join(own, F.col(c) == F.col(f"__name{i}"), "left")
        found.append(F.col(f"__id{i}"))
    return refs.withColumn(to, F.coalesce(*found)).drop(*[f"__{x}{i}" for x in ("name", "id") for i in range(len(candidates))])


def group_of(records: DataFrame, by_name: str, by_id: str, groups: DataFrame, group_name: str, group_id: str, label: str, default: Column, to: str) -> DataFrame:
    """A label looked up by name first, then by id, else a default."""
    names = groups.groupBy(F.col(group_name).alias("__gn")).agg(F.min(label).alias("__by_name"))
    ids = groups.groupBy(F.col(group_id).alias("__gi")).agg(F.min(label).alias("__by_id"))
    joined = records.join(names, F.col(by_name) == F.col("__gn"), "left").join(ids, F.col(by_id) == F.col("__gi"), "left")
    return joined.withColumn(to, F.coalesce("__by_name", "__by_id", default)).drop("__gn", "__gi", "__by_name", "__by_id")


def members(owners: DataFrame, ids: str, records: DataFrame, id_: str) -> DataFrame:
    """Records of each owner in the order of its id list; ids that resolve to nothing are left out."""
    own = owners.select("*", F.posexplode(ids).alias("member_position", "__member"))
    return own.join(records, F.col("__member") == F.col(id_)).drop("__member")
