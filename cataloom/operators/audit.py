"""Integrity of catalogs: summaries, unexpected fields, issues. Each summary is one or two aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions.text import any_of, blank, short_code
from cataloom.operators.keys import duplicates
from cataloom.schemas import REQUIRED_LINK_FIELDS

#: What each counter means when it isn't zero, in the order of a report; the counters are fixed values.
ISSUES = {
    "links_missing_from_logic": "links start from logics that the catalog doesn't have",
    "links_missing_required_fields": "links lack a field that they need",
    "links_with_blank_required_fields": "links have an empty field that they need",
    "missing_model_logic_refs": "models list logics that the catalog doesn't have",
    "hierarchy_tops_missing_logic": "hierarchies have a top that the catalog doesn't have",
    "hierarchies_missing_top": "hierarchies name no top",
    "extra_logic_fields": "logics have fields outside their schema",
    "extra_link_fields": "links have fields outside their schema",
    "extra_model_fields": "models have fields outside their schema",
    "extra_hierarchy_fields": "hierarchies have fields outside their schema",
    "duplicate_logic_ids": "an id belongs to several logics",
    "short_code_name_collisions": "logics can't be told apart by short code and name",
    "duplicate_logic_names": "a name belongs to several logics",
    "logics_with_unknown_category": "logics have a category that isn't defined",
    "kg_logic_ids_without_step": "logics have no step in the graph",
    "kg_steps_with_missing_logic": "steps of the graph have no logic",
    "kg_json_supports_missing_in_kg": "supporting links between known steps have no edge in the graph",
    "kg_json_in_graph_links_missing_in_kg": "links marked as in the graph have no edge there",
    "kg_supports_cycles": "supporting edges form cycles",
    "kg_mutual_support_pairs": "two steps support each other",
}


def _count(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def logic_summary(logics: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """One row of counters over a catalog's logics and links."""
    known = categories.select(F.trim("name").alias("__c")).distinct() if categories is not None else None
    base = logics.join(known, F.trim("category") == F.col("__c"), "left") if known is not None else logics.withColumn("__c", F.col("category"))
    n_links = F.coalesce(F.size("links"), F.lit(0))
    totals = base.agg(
        F.count("*").alias("total"), _count(F.col("archived")).alias("archived"), _count(~F.coalesce("archived", F.lit(False))).alias("active"),
        F.coalesce(F.sum(F.when(n_links > 0, n_links)), F.lit(0)).cast("long").alias("links"), _count(n_links > 0).alias("logics_with_links"), _count(n_links <= 0).alias("logics_without_links"),
        _count(~blank(F.col("category"))).alias("logics_with_category"), _count(blank(F.col("category"))).alias("logics_without_category"),
        _count(~blank(F.col("category")) & F.col("__c").isNull()).alias("logics_with_unknown_category"),
    )
    ids = logics.select(F.col("id").alias("__id")).distinct()
    link = logics.select(F.explode("links").alias("l")).select("l.*").join(ids, F.col("from_logic_id") == F.col("__id"), "left")
    set_ = F.coalesce("from_logic_id", F.lit("")) != ""
    missing = any_of([F.col(f).isNull() for f in REQUIRED_LINK_FIELDS])
    empty = any_of([F.col(f).isNotNull() & blank(F.col(f)) for f in REQUIRED_LINK_FIELDS])
    links = link.agg(
        _count(set_ & F.col("__id").isNotNull()).alias("links_with_from_logic"), _count(set_ & F.col("__id").isNull()).alias("links_missing_from_logic"),
        _count(missing).alias("links_missing_required_fields"), _count(empty).alias("links_with_blank_required_fields"),
    )
    coded = logics.where("coalesce(id, '') <> ''")
    dup = duplicates(coded, ["id"]).agg(F.count("*").alias("duplicate_logic_ids"))
    names = duplicates(logics.where(~blank(F.col("name"))), ["name"]).agg(F.count("*").alias("duplicate_logic_names"))
    codes = duplicates(coded.where("coalesce(name, '') <> ''").withColumn("__code", short_code(F.col("id"))), ["__code", "name"]).agg(F.count("*").alias("short_code_name_collisions"))
    out = totals
    for one in (links, dup, names, codes):  # one row each
        out = out.join(one, F.lit(True))
    return out


def model_summary(models: DataFrame, logics: DataFrame) -> DataFrame:
    """One row of counters over models: references, distinct ones, missing ones, hierarchies and their tops."""
    ids = logics.select(F.col("id").alias("__id")).distinct()
    refs = models.select(F.explode("logicIds").alias("ref")).join(ids, F.col("ref") == F.col("__id"), "left")
    a = refs.agg(F.count("*").alias("model_logic_refs"), F.count_distinct("ref").alias("distinct_model_logic_refs"), _count(F.col("__id").isNull()).alias("missing_model_logic_refs"))
    tops = models.select(F.explode("hierarchies").alias("h")).select("h.topId").join(ids, F.col("topId") == F.col("__id"), "left")
    b = tops.agg(
        F.count("*").alias("hierarchies"), _count(blank(F.col("topId"))).alias("hierarchies_missing_top"), _count(~blank(F.col("topId")) & F.col("__id").isNotNull()).alias("hierarchies_with_top"),
        _count(~blank(F.col("topId")) & F.col("__id").isNull()).alias("hierarchy_tops_missing_logic"),
    )
    return models.agg(F.count("*").alias("models")).join(a, F.lit(True)).join(b, F.lit(True))


def unexpected_fields(records: DataFrame, extras: str = "extras") -> DataFrame:
    """(field, n): how often each field occurs that the schema doesn't have."""
    return records.select(F.explode(F.map_keys(extras)).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def extra_counts(**records: DataFrame) -> DataFrame:
    """One row with ``extra_<name>_fields`` for each table given by name (logic, link, model, hierarchy): how many unexpected fields its records have (``extras``)."""
    counts = [df.agg(F.coalesce(F.sum(F.size(F.map_keys("extras"))), F.lit(0)).cast("long").alias(f"extra_{name}_fields")) for name, df in records.items()]
    return reduce(lambda a, b: a.join(b, F.lit(True)), counts)


def issues(*summaries: DataFrame, texts: dict[str, str] = ISSUES) -> DataFrame:
    """(issue, text, n) of the counters in one-row summaries that aren't zero."""
    summary = reduce(lambda a, b: a.join(b, F.lit(True)), summaries)  # a row each
    present = [k for k in texts if k in summary.columns]
    rows = F.array(*[F.struct(F.lit(k).alias("issue"), F.lit(texts[k]).alias("text"), F.col(k).cast("long").alias("n")) for k in present])
    return summary.select(F.explode(rows).alias("r")).select("r.*").where("n > 0")


def labels_by_count(df: DataFrame, label: str, top: int | None = None, missing: str = "(missing)", empty: str = "(blank)") -> DataFrame:
    """Counts by label, with names for null and blank ones, most frequent first."""
    named = F.when(F.col(label).isNull(), missing).when(blank(F.col(label)), empty).otherwise(F.col(label))
    counted = df.groupBy(named.alias(label)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)
    return counted.limit(top) if top else counted


def graph_check(logics: DataFrame, steps: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counters of a catalog against its graph: steps(id), SUPPORTS edges(src, dst)."""
    from cataloom.operators.cycles import cyclic_edges
    from cataloom.operators.graph import link_edges, mutual_pairs

    ids, nodes = logics.select("id").distinct(), steps.select("id").distinct()
    want = link_edges(logics).join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    missing = want.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    parts = [
        ids.join(nodes, "id", "left_anti").agg(F.count("*").alias("kg_logic_ids_without_step")),
        nodes.join(ids, "id", "left_anti").agg(F.count("*").alias("kg_steps_with_missing_logic")),
        missing.where("lower(kind) = 'supports'").agg(F.count("*").alias("kg_json_supports_missing_in_kg")),
        missing.where("in_graph").agg(F.count("*").alias("kg_json_in_graph_links_missing_in_kg")),
        cyclic_edges(edges).agg(F.count("*").alias("kg_supports_cycles")),
        mutual_pairs(edges).agg(F.count("*").alias("kg_mutual_support_pairs")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))
    return out
