"""Upserts: records of a document into the catalog, generated records, links, models, hierarchies, executions, cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.text import blank, fingerprint
from cataloom.operators.keys import pick
from cataloom.sources.reports import exploded_links

#: Fields whose change makes an update material.
MATERIAL = ("dmn_hit_policy", "dmn_inputs", "dmn_outputs", "dmn_table")
#: Fields that tell links apart.
LINK_KEY = ("from_logic_id", "from_output", "to_input", "kind")


def changed(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether two tuples differ; nulls equal nulls."""
    return ~F.struct(*a).eqNullSafe(F.struct(*b))


def decide(existing: DataFrame, incoming: DataFrame, key: str, stamp: str, material: Sequence[str], force: bool = False) -> DataFrame:
    """What happens to each key: keep (only there), insert, update, or skip (not newer and no material change).

    ``existing`` and ``incoming`` have one row a key. Stamps are compared as they are stored; an existing row without one is always updated.
    """
    cols = [stamp, *material]
    old = existing.select(F.col(key), F.lit(True).alias("__old"), *[F.col(c).alias(f"__old_{c}") for c in cols])
    new = incoming.select(F.col(key), F.lit(True).alias("__new"), *[F.col(c).alias(f"__new_{c}") for c in cols])
    differs = changed([F.col(f"__old_{c}") for c in material], [F.col(f"__new_{c}") for c in material])
    stale = F.coalesce(F.col(f"__old_{stamp}") >= F.col(f"__new_{stamp}"), F.lit(False)) & ~differs
    decision = (
        F.when(F.col("__new").isNull(), "keep").when(F.col("__old").isNull(), "insert")
        .when(F.lit(not force) & stale, "skip").otherwise("update")
    )
    return old.join(new, key, "full_outer").select(key, decision.alias("decision"), differs.alias("material_change"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "name", stamp: str = "timestamp", material: Sequence[str] = MATERIAL, force: bool = False, keep_columns: Sequence[str] = ("id",)) -> DataFrame:
    """The catalog after the incoming records: updated rows keep ``keep_columns`` of the old row, everything else is the new one's.

    Both sides have the same columns; incoming rows bring the ids that new records will have.
    """
    columns = existing.columns
    decided = decide(existing, incoming, key, stamp, material, force).select(key, "decision")
    stay = existing.join(decided.where("decision in ('keep', 'skip')").select(key), key, "left_semi")
    kept = existing.select(F.col(key), *[F.col(c).alias(f"__kept_{c}") for c in keep_columns])
    take = incoming.join(decided.where("decision in ('insert', 'update')").select(key), key, "left_semi").join(kept, key, "left")
    take = take.withColumns({c: F.coalesce(f"__kept_{c}", F.col(c)) for c in keep_columns})
    return stay.select(columns).unionByName(take.select(columns))


def ingest(existing: DataFrame, incoming: DataFrame, force: bool = False, name: str = "name", stamp: str = "timestamp", material: Sequence[str] = MATERIAL) -> DataFrame:
    """The catalog after an ingest of records, one a name on either side, with ``decision`` (keep, insert, update, skip).

    A known (name, stamp) is passed over whatever it changes, and so is what is neither newer nor materially different; with ``force`` nothing is. An updated
    record keeps its id and is archived no more; its category is kept only with ``force``.
    """
    decided = decide(existing, incoming, name, stamp, material, force).select(F.col(name).alias("__name"), "decision")
    old = existing.select(F.col(name).alias("__old"), F.col("id").alias("__id"), F.col("category").alias("__category"), F.col(stamp).alias("__stamp"))
    new = incoming.join(decided, F.col(name) == F.col("__name")).join(old, F.col(name) == F.col("__old"), "left")
    seen = F.lit(not force) & F.coalesce(F.col("__stamp") == F.col(stamp), F.lit(False))
    new = new.withColumn("decision", F.when(seen, "skip").otherwise(F.col("decision"))).where("decision in ('insert', 'update')")
    category = F.coalesce("__category", "category") if force else F.when(F.col("decision") == "insert", F.col("category"))
    taken = new.withColumns({"id": F.coalesce("__id", "id"), "category": category, "archived": F.lit(False)})
    rest = existing.join(taken.select(F.col(name).alias("__taken")), F.col(name) == F.col("__taken"), "left_anti")
    asked = incoming.select(F.col(name).alias("__asked")).distinct()
    kept = rest.join(asked, F.col(name) == F.col("__asked"), "left").withColumn("decision", F.when(F.col("__asked").isNull(), "keep").otherwise("skip"))
    return kept.select(*existing.columns, "decision").unionByName(taken.select(*existing.columns, "decision"))


def reject_repeats(sections: DataFrame, document: str, name: str = "name", file: str = "code_file", position: str = "position") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected sections of documents: the same name with the same code file twice is a repeat; other repeats of a name get a number."""
    w = Window.partitionBy(document, name, file).orderBy(position)
    ranked = sections.withColumn("__n", F.when(blank(F.col(name)) | blank(F.col(file)), F.lit(1)).otherwise(F.row_number().over(w)))
    accepted, rejected = ranked.where("__n = 1").drop("__n"), ranked.where("__n > 1").drop("__n")
    n = F.row_number().over(Window.partitionBy(document, name).orderBy(position))
    numbered = accepted.withColumn("__name", F.when((n == 1) | blank(F.col(name)), F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))))
    return numbered.withColumn(name, F.col("__name")).drop("__name"), rejected


def resolve_links(accepted: DataFrame, existing: DataFrame) -> DataFrame:
    """``links`` of accepted sections from ``parsed_links``: by name among existing records and sections at or before the own one.

    Links to names that aren't there, or come later, are dropped; unparsed lines stay as they are (``raw``).
    """
    known = existing.select(F.col("name").alias("__ref"), F.col("id").alias("__id"), F.lit(-1).cast("int").alias("__at")).unionByName(
        accepted.select(F.col("name").alias("__ref"), F.col("id").alias("__id"), F.col("position").cast("int").alias("__at"))
    )
    one = known.groupBy("__ref").agg(F.min_by("__id", "__at").alias("__id"), F.min("__at").alias("__at"))
    link = accepted.select("id", "position", exploded_links("parsed_links")).where("n is not null").join(one, F.col("l.from_logic") == F.col("__ref"), "left")
    ok = link.where("l.raw is not null or __at <= position")
    rebuilt = F.struct(
        F.when(F.col("l.raw").isNull(), F.col("__id")).alias("from_logic_id"), F.col("l.from_output").alias("from_output"), F.col("l.to_input").alias("to_input"),
        F.col("l.kind").alias("kind"), F.col("l.raw").alias("raw"),
    )
    grouped = ok.groupBy(F.col("id").alias("__owner")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", rebuilt.alias("l")))), lambda x: x["l"]).alias("links"))
    empty = F.array().cast(grouped.schema["links"].dataType)
    return accepted.join(grouped, F.col("id") == F.col("__owner"), "left").withColumn("links", F.coalesce("links", empty)).drop("__owner", "parsed_links")


def merge_links(old: DataFrame, new: DataFrame, owner: str, key: Sequence[str] = LINK_KEY, note: str = "link_explanation") -> DataFrame:
    """Links of each owner, once by trimmed key; a non-blank note of the new ones replaces the old."""
    sides = old.select(owner, *key, note, F.lit(0).alias("__age")).unionByName(new.select(owner, *key, note, F.lit(1).alias("__age")))
    trimmed = sides.withColumns({k: F.trim(k) for k in key}).withColumn("__note", F.when(~blank(F.col(note)), F.struct("__age", note)))
    return trimmed.groupBy(owner, *key).agg(F.max("__note").alias("__best")).select(owner, *key, F.col(f"__best.{note}").alias(note))


def scrub_links(links: DataFrame, owner: str, scope: DataFrame, id_: str, key: Sequence[str] = LINK_KEY) -> DataFrame:
    """Links whose source is in scope, once by owner and key."""
    ids = scope.select(F.col(id_).alias("__scope")).distinct()
    return links.join(ids, F.col(key[0]) == F.col("__scope"), "left_semi").dropDuplicates([owner, *key])


def outcomes(decided: DataFrame, decision: str = "decision") -> DataFrame:
    """One row of counts: considered, updated, new, skipped and emitted records."""
    n = lambda *d: F.coalesce(F.count_if(F.col(decision).isin(*d)), F.lit(0))
    return decided.agg(F.count_if(F.col(decision) != "keep").alias("considered"), n("update").alias("updated"), n("insert").alias("new"), n("skip").alias("skipped"), n("update", "insert").alias("emitted"))


def skip_reasons(sections: DataFrame, existing: DataFrame, allowed: DataFrame | None = None, document: str = "document", name: str = "name", file: str = "code_file", position: str = "position", stamp: str = "timestamp", material: Sequence[str] = MATERIAL) -> DataFrame:
    """(document, position, reason) of every section: why it isn't taken, null where it is.

    In this order: parse_error (no name), name_not_allowed, duplicate_same_codefile (an earlier section has its name and file),
    dedupe_key_seen (its name and stamp are there already), existing_duplicate_or_older_nochange.
    """
    own = sections.withColumn("__first", F.min(position).over(Window.partitionBy(document, name, file)))
    if allowed is not None:
        own = own.join(allowed.select(F.col("name").alias("__ok")).distinct(), F.col(name) == F.col("__ok"), "left")
    old = existing.groupBy(F.col("name").alias("__old")).agg(F.max_by(F.struct(F.col(stamp).alias("stamp"), *material), stamp).alias("__was"))
    seen = own.join(old, F.col(name) == F.col("__old"), "left")
    unchanged = F.struct(*[F.col(c) for c in material]).eqNullSafe(F.struct(*[F.col(f"__was.{c}").alias(c) for c in material]))
    reason = (
        F.when(blank(F.col(name)), "parse_error").when(F.col("__ok").isNull() if allowed is not None else F.lit(False), "name_not_allowed")
        .when(~blank(F.col(file)) & (F.col(position) > F.col("__first")), "duplicate_same_codefile")
        .when(F.col("__was.stamp") == F.col(stamp), "dedupe_key_seen").when((F.col("__was.stamp") >= F.col(stamp)) & unchanged, "existing_duplicate_or_older_nochange")
    )
    return seen.select(document, position, reason.alias("reason"))


def upsert_models(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Decision for models: by id, else by name, else append."""
    by_id = existing.select(F.col("id").alias("__id")).distinct()
    by_name = existing.groupBy(F.col("name").alias("__n")).agg(F.min("id").alias("__name_id"))
    joined = incoming.join(by_id, F.col("id") == F.col("__id"), "left").join(by_name, F.col("name") == F.col("__n"), "left")
    target = F.coalesce("__id", "__name_id")
    return joined.select(*incoming.columns, F.when(target.isNull(), "append").otherwise("update").alias("decision"), F.coalesce(target, F.col("id")).alias("target_id"))


def update_members(models: DataFrame, model: str, members: str, new: DataFrame, catalog: DataFrame) -> DataFrame:
    """Members of models after new ones: ids of the same name (case aside) and kind as a new one leave, new ones come at the end once."""
    info = catalog.select("id", F.lower("name").alias("__name"), "kind")
    added = new.join(info, "id").groupBy(model).agg(F.array_sort(F.collect_set("id")).alias("__new"), F.collect_set(F.struct("__name", "kind")).alias("__keys"))
    current = models.select(model, F.posexplode(members).alias("__pos", "id")).join(info, "id", "left").join(added.select(model, "__keys", "__new"), model, "left")
    gone = F.coalesce(F.array_contains("__keys", F.struct("__name", "kind")) & ~F.array_contains("__new", F.col("id")), F.lit(False))
    kept = current.where(~gone).groupBy(model).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "id"))), lambda x: x["id"]).alias("__kept"))
    none = F.array().cast("array<string>")
    return (
        models.select(model).join(kept, model, "left").join(added, model, "left")
        .select(model, F.array_union(F.coalesce("__kept", none), F.coalesce("__new", none)).alias(members))
    )


def upsert_hierarchies(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Hierarchies by top id, else name (case aside): a blank top id is filled, names and descriptions are replaced when given."""
    low = F.lower(F.trim("name"))
    old = existing.withColumn("__low", low)
    new = incoming.withColumn("__low", low).withColumn("__row", F.monotonically_increasing_id())
    by_top = old.where(~blank(F.col("topId"))).select(F.col("topId").alias("__top"), F.col("__low").alias("__old_low"))
    matched = new.join(by_top, F.col("topId") == F.col("__top"), "left").join(old.select(F.col("__low").alias("__named")).distinct(), F.col("__low") == F.col("__named"), "left")
    target = matched.select("topId", "name", "description", F.coalesce("__old_low", "__named").alias("__target"))
    joined = old.join(pick(target.where("__target is not null"), ["__target"], [F.col("topId"), F.col("name")]).select(*[F.col(c).alias(f"__new_{c}") for c in ("topId", "name", "description")], "__target"), F.col("__low") == F.col("__target"), "left")
    given = lambda c: F.when(~blank(F.col(f"__new_{c}")), F.col(f"__new_{c}")).otherwise(F.col(c))
    updated = joined.select(F.when(blank(F.col("topId")), F.col("__new_topId")).otherwise(F.col("topId")).alias("topId"), given("name").alias("name"), given("description").alias("description"))
    return updated.unionByName(target.where("__target is null").select("topId", "name", "description"))


def in_scope(records: DataFrame, scope: DataFrame) -> DataFrame:
    """New records (blank id), and those whose id or name (case aside) is in scope."""
    ids = scope.select(F.col("id").alias("__id")).where("__id is not null").distinct()
    names = scope.select(F.lower("name").alias("__name")).where("__name is not null").distinct()
    joined = records.join(ids, F.col("id") == F.col("__id"), "left").join(names, F.lower("name") == F.col("__name"), "left")
    return joined.where(blank(F.col("id")) | F.col("__id").isNotNull() | F.col("__name").isNotNull()).drop("__id", "__name")


def record_executions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One record a log path: sorted union of ids, the latest of the rest."""
    both = existing.unionByName(incoming)
    rest = [c for c in existing.columns if c not in ("log_path", "logic_ids")]
    return both.groupBy("log_path").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("logic_ids")))).alias("logic_ids"), F.max_by(F.struct(*rest), "created_at").alias("__r")
    ).select("log_path", "logic_ids", "__r.*")


def keep_previous_links(current: DataFrame, previous: DataFrame, keys: Sequence[str] = ("timestamp", "log_file"), links: str = "logic_ids") -> DataFrame:
    """Runs whose ids are empty take those of the previous run table."""
    before = previous.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(links).alias("__links"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = current.join(before, on, "left")
    return joined.withColumn(links, F.when(F.coalesce(F.size(links), F.lit(0)) > 0, F.col(links)).otherwise(F.col("__links"))).drop("__links", *[f"__{k}" for k in keys])


def deletion_report(logics: DataFrame, models: DataFrame) -> DataFrame:
    """(kind, owner, ref) of what a deletion of archived logics would find broken, without deleting: links of live logics that start from nowhere or from no
    logic at all (archived ones still count as there), and references of models to logics that wouldn't stay."""
    live = logics.where(~F.coalesce("archived", F.lit(False)))
    every = logics.select(F.trim("id").alias("__id")).where("__id <> ''").distinct()
    link = live.select(F.col("id").alias("owner"), F.explode("links").alias("l")).select("owner", F.trim("l.from_logic_id").alias("ref"))
    links = link.join(every, F.col("ref") == F.col("__id"), "left_anti").select(F.lit("link").alias("kind"), "owner", "ref")
    stay = live.select(F.trim("id").alias("__id")).where("__id <> ''").distinct()
    refs = models.select(F.col("id").alias("owner"), F.explode("logicIds").alias("ref"))
    return links.unionByName(refs.join(stay, F.trim("ref") == F.col("__id"), "left_anti").select(F.lit("model").alias("kind"), "owner", "ref"))


def delete_archived(logics: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog and models without archived logics, links from them or from nowhere, and references to them."""
    live = logics.where(~F.coalesce("archived", F.lit(False)))
    ids = live.select(F.col("id").alias("__live")).distinct()
    link = live.select(F.col("id").alias("__owner"), F.posexplode("links").alias("__n", "__l")).join(ids, F.col("__l.from_logic_id") == F.col("__live"), "left_semi")
    kept = link.groupBy("__owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__l"))), lambda x: x["__l"]).alias("__kept"))
    cleaned = live.join(kept, F.col("id") == F.col("__owner"), "left").withColumn("links", F.coalesce("__kept", F.slice("links", 1, 0))).drop("__owner", "__kept")
    refs = models.select(F.col("id").alias("__m"), F.posexplode("logicIds").alias("__n", "__ref")).join(ids, F.col("__ref") == F.col("__live"), "left_semi")
    left = refs.groupBy("__m").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__ref"))), lambda x: x["__ref"]).alias("__ids"))
    return cleaned, models.join(left, F.col("id") == F.col("__m"), "left").withColumn("logicIds", F.coalesce("__ids", F.array().cast("array<string>"))).drop("__m", "__ids")


def prune_links(logics: DataFrame, edges: DataFrame) -> DataFrame:
    """Logics without links that are marked as in the graph but aren't edges there."""
    known = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d")).distinct()
    link = logics.select(F.col("id").alias("__owner"), F.posexplode("links").alias("__n", "__l"))
    joined = link.join(known, (F.col("__l.from_logic_id") == F.col("__s")) & (F.col("__owner") == F.col("__d")), "left")
    kept = joined.where(~(F.coalesce("__l.in_graph", F.lit(False)) & F.col("__s").isNull()))
    grouped = kept.groupBy("__owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__l"))), lambda x: x["__l"]).alias("__kept"))
    return logics.join(grouped, F.col("id") == F.col("__owner"), "left").withColumn("links", F.coalesce("__kept", F.slice("links", 1, 0))).drop("__owner", "__kept")


def blank_unknown_categories(logics: DataFrame, categories: DataFrame, name: str = "name") -> DataFrame:
    known = categories.select(F.col(name).alias("__c")).distinct()
    joined = logics.join(known, F.trim("category") == F.col("__c"), "left")
    return joined.withColumn("category", F.when(F.col("__c").isNotNull(), F.col("category")).otherwise("")).drop("__c")


def rename(df: DataFrame, names: dict[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Old column names to new: the new one's value if it isn't blank, else the old one's; then the old ones go. Doing it twice changes nothing."""
    for old, new in names.items():
        if old in df.columns:
            value = F.coalesce(F.when(~blank(F.col(new).cast("string")), F.col(new)), F.col(old)) if new in df.columns else F.col(old)
            df = df.withColumn(new, value).drop(old)
    return df.drop(*drop)
