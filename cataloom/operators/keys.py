"""Records by key: first, last or preferred one, running numbers, and names made unique."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cataloom.functions.text import name_and_number
from cataloom.scratch import tabled


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def keep_last(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """As an index by key does: the last row of a key wins, in the place of its first."""
    w = Window.partitionBy(*keys)
    return pick(df.withColumn("first_position", F.min(position).over(w)), keys, [F.desc(position)])


def latest(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The values of each key's row that is greatest by ``order``; one aggregation, combined before the shuffle."""
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def older_versions(df: DataFrame, key: str, position: str) -> DataFrame:
    """All rows of a repeated key but the last."""
    last = df.groupBy(F.col(key).alias("__key")).agg(F.max(position).alias("__last"))
    return df.join(last, F.col(key) == F.col("__key")).where(F.col(position) < F.col("__last")).drop("__key", "__last")


def _over_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], of_range: Column, of_ranges: Callable[[WindowSpec], Column], own: Callable[[WindowSpec], Column], to: str, joined: Callable[[Column, Column], Column]) -> DataFrame:
    """A value for each row from the rows of its key before it: from those of its own range, and from what the ranges before hold.

    Rows are ranged by key and order, which should be total, and summed up by range. So a key with a third of all rows is spread over ranges like any other.
    """
    ranged = tabled(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "__range").agg(of_range.alias("__of")).withColumn("__before", of_ranges(before))
    theirs = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), "__before")
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    inner = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("__own", own(inner)).join(theirs, [*on, F.col("__range") == F.col("__r")])
    return out.withColumn(to, joined(F.col("__own"), F.col("__before"))).select(*[c for c in df.columns if c != to], to)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, to: str) -> DataFrame:
    """The sum of ``value``, whole numbers, over the rows of the same key that come before."""
    df = df.withColumn("__value", value.cast("long"))
    total = lambda w: F.coalesce(F.sum("__of").over(w), F.lit(0))
    own = lambda w: F.coalesce(F.sum("__value").over(w), F.lit(0))
    return _over_ranges(df, keys, order, F.sum("__value"), total, own, to, lambda a, b: a + b).drop("__value")


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, to: str) -> DataFrame:
    """The last ``value`` that isn't null among the rows of the same key that come before."""
    df = df.withColumn("__value", value)
    of_range = F.max_by(F.col("__value"), F.when(F.col("__value").isNotNull(), F.struct(*order)))
    return _over_ranges(df, keys, order, of_range, lambda w: F.last("__of", True).over(w), lambda w: F.last("__value", True).over(w), to, F.coalesce).drop("__value")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], to: str) -> DataFrame:
    """Numbers the rows of each key from 1 in the given order, which should be total."""
    counted = lambda w: F.coalesce(F.sum("__of").over(w), F.lit(0))
    return _over_ranges(df, keys, order, F.count("*"), counted, lambda w: F.count("*").over(w), to, lambda a, b: (a + b + 1).cast("long"))


def _with_number(name: Column, n: Column) -> Column:
    return F.when(n == 1, name).otherwise(F.concat(name, F.lit(" ("), n.cast("string"), F.lit(")")))


def number_occurrences(df: DataFrame, name: str, position: str, to: str = "unique_name") -> DataFrame:
    """Second and later occurrences of a name get `` (2)``, `` (3)`` and so on."""
    return numbered(df, [name], [position], "__number").withColumn(to, _with_number(F.col(name), F.col("__number"))).drop("__number")


def number_bases(df: DataFrame, name: str, position: str, to: str = "unique_name") -> DataFrame:
    """As number_occurrences, on names without the number that they may bring."""
    base, _ = name_and_number(F.col(name))
    return number_occurrences(df.withColumn("__base", base), "__base", position, to).drop("__base")


#: A number that an allocated name ends in.
_NUMBER = r" \((?:[2-9]|[1-9]\d+)\)"
#: Numbers that are enumerated at once.
_CHUNK = 10_000


def allocate_names(new: DataFrame, taken: DataFrame, name: str = "name", position: str = "position", to: str = "unique_name") -> DataFrame:
    """Names for new records, in the order of ``position`` (a total one), that clash neither with taken ones nor with each other, case aside.

    A free name stays as it was wished for, numbers included; one that is not free gets the smallest free `` (n)`` from 2 behind it. So a name
    may be granted to one record because another wished for the shorter one, and a later wish for it comes too late. A name's own numbered names
    can only be handed out, or wished for before; what is handed out rises with time. So names go level by level of their numbers: each level's
    surplus wishes are ranked, the numbered names that are wished for or taken compare the wish that would come to them with their own first one, until
    nothing changes, and ranks meet free numbers. All of it by joins on a name with a rank or a number, which no common name can skew.
    Blank names stay blank.
    """
    low = F.lower(F.trim(F.col(name)))
    wishes = tabled(new.select(F.col(position).alias("pos"), low.alias("x")).where("x <> ''"), "wishes")
    old = taken.select(F.lower(F.trim(name)).alias("x"), F.lit(True).alias("old")).where("x <> ''").distinct()
    suffix = F.regexp_extract("x", f"((?:{_NUMBER})*)$", 1)
    split = {"depth": F.regexp_count(suffix, F.lit(r"\(")), "parent": F.regexp_extract("x", f"(?s)^(.*){_NUMBER}$", 1), "n": F.regexp_extract("x", r" \((\d+)\)$", 1).try_cast("long")}
    names = wishes.groupBy("x").agg(F.min("pos").alias("first")).join(old, "x", "full_outer").withColumns(split)
    names = tabled(names.withColumn("old", F.coalesce("old", F.lit(False))), "names")
    deepest = names.where("first is not null").agg(F.max("depth")).first()[0]
    grants, handed = [], names.select("x", F.col("first").alias("handed")).limit(0)
    for depth in range((-1 if deepest is None else deepest) + 1):
        own = names.where(F.col("depth") == depth).join(handed, "x", "left").select("x", "first", (F.col("old") | F.col("handed").isNotNull()).alias("gone"))
        came = tabled(wishes.join(own, "x").withColumn("granted", ~F.col("gone") & (F.col("pos") == F.col("first"))), "wishes")
        grants.append(came.where("granted").select("pos", F.lit(None).cast("long").alias("n")))
        surplus = tabled(numbered(came.where("not granted").select("x", "pos"), ["x"], ["pos"], "rank"), "surplus")
        children = names.where(F.col("depth") == depth + 1).select(F.col("parent").alias("x"), "n", F.col("x").alias("child"), "first", "old")
        children = tabled(children.join(surplus.select("x").distinct(), "x", "left_semi").withColumn("skipped", F.col("old")), "children")
        while True:
            ranked = running_sum(children, ["x"], ["n"], F.col("skipped").cast("int"), "k").withColumn("rank", F.col("n") - 1 - F.col("k"))
            met = ranked.join(surplus.select("x", "rank", F.col("pos").alias("come")), ["x", "rank"], "left")
            late = F.col("old") | F.coalesce(F.col("come") > F.col("first"), F.lit(False))
            after = tabled(met.select("x", "n", "child", "first", "old", "come", late.alias("skipped"), (late != F.col("skipped")).alias("changed")), "children")
            children = after.drop("changed", "come")
            if after.where("changed").isEmpty():
                break
        handed = after.where("not skipped and come is not null").select(F.col("child").alias("x"), F.col("come").alias("handed"))
        skips = children.where("skipped").groupBy("x").agg(F.count("*").alias("skips"))
        most = surplus.groupBy("x").agg(F.count("*").alias("most")).join(skips, "x").withColumn("most", F.col("most") + F.col("skips"))
        chunk = most.select("x", "most", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"most div {_CHUNK}"))).alias("c"))
        numbers = chunk.select("x", F.explode(F.sequence(F.col("c") * _CHUNK, F.least(F.col("c") * _CHUNK + _CHUNK - 1, "most"))).alias("n")).select("x", (F.col("n") + 2).alias("n"))
        free = numbered(numbers.join(children.where("skipped").select("x", "n"), ["x", "n"], "left_anti"), ["x"], ["n"], "rank")
        grants.append(surplus.join(free, ["x", "rank"]).select("pos", "n"))
        grants.append(surplus.join(skips, "x", "left_anti").select("pos", (F.col("rank") + 1).alias("n")))
    given = reduce(DataFrame.unionByName, grants, wishes.select("pos", F.lit(None).cast("long").alias("n")).limit(0)).withColumnsRenamed({"pos": "__pos", "n": "__n"})
    joined = new.join(given, F.col(position) == F.col("__pos"), "left")
    return joined.withColumn(to, F.when(F.col("__n").isNull(), F.trim(name)).otherwise(F.concat(F.trim(name), F.lit(" ("), F.col("__n").cast("string"), F.lit(")")))).drop("__pos", "__n")
