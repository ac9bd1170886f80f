"""References and differences between catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dangling(refs: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set and resolves to no target."""
    known = targets.select(F.col(key).alias("__known")).distinct()
    return refs.where(F.col(ref).isNotNull()).join(known, F.col(ref) == F.col("__known"), "left_anti")


def resolved(refs: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    known = targets.select(F.col(key).alias("__known"))
    return refs.join(known, F.col(ref) == F.col("__known"), "left_semi")


def difference(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct tuples that only one side has, with change ``added`` or ``removed``; nulls equal nulls.

    One pass: both sides are combined by tuple, and what only one side holds stays.
    """
    sides = before.select(*columns, F.lit(1).alias("__side")).unionByName(after.select(*columns, F.lit(2).alias("__side")))
    both = sides.groupBy(*columns).agg(F.bit_or("__side").alias("__sides")).where("__sides < 3")
    return both.select(*columns, F.when(F.col("__sides") == 2, "added").otherwise("removed").alias("change"))


def compare(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Status of every key: added, removed, changed or same."""
    old = before.select(F.col(key), F.struct(*columns).alias("__old"))
    new = after.select(F.col(key), F.struct(*columns).alias("__new"))
    status = (
        F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed")
        .when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("changed")
    )
    return old.join(new, key, "full_outer").select(key, status.alias("status"))


def surviving(parents: DataFrame, key: str, children: DataFrame, ref: str) -> DataFrame:
    """Children whose parent is there: the step of a cascade."""
    return resolved(children, ref, parents, key)


def append_unique(have: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What is there, and of the rest each once."""
    return have.select(*columns).unionByName(new.select(*columns)).distinct()
