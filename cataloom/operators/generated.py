"""Batches of generated records merged into a catalog as if one by one: each sees what those before it did.

What one record does to a later one is worked out by key, not by a loop: the version that a name has is the last record of that name before,
an id is taken by the first record that brings it, a content is there from the first that was appended with it, and links are new at their
first place in the batch. Running values go over ranges of rows, so a name or a target with a third of the batch is spread like others.

Records have id, name, kind, archived, links (arrays of structs with the fields of ``LINK_KEY`` and link_explanation) and position, unique on its side.
A link's source may be given by name. New records take ``new_id`` where the batch has that column, else a random UUID.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions.text import blank, fingerprint, looks_like_uuid
from cataloom.operators.keys import allocate_names, last_before
from cataloom.operators.upsert import LINK_KEY, MATERIAL
from cataloom.scratch import tabled

NOTE = "link_explanation"


def _with_keys(df: DataFrame, content: Sequence[str]) -> DataFrame:
    kind = F.lower(F.trim(F.coalesce("kind", F.lit(""))))
    return df.withColumns({"__name": F.coalesce(F.trim("name"), F.lit("")), "__kind": kind, "__id": F.coalesce(F.trim("id"), F.lit("")), "__mark": fingerprint(*[F.col(c) for c in content])})


def _with_new_ids(incoming: DataFrame) -> DataFrame:
    return tabled(incoming if "new_id" in incoming.columns else incoming.withColumn("new_id", F.uuid()), "incoming")


def _resolved(links: DataFrame, existing: DataFrame, created: DataFrame) -> DataFrame:
    """Links (…, position, link) of a batch with their source as an id; those whose source is neither in the catalog nor created before go.

    ``created`` has id, name and position of new records. Of equal names, case aside, the last one counts, a new one before all old ones.
    """
    low = lambda c: F.lower(F.trim(c))
    source = F.coalesce(F.trim("link.from_logic_id"), F.lit(""))
    named = existing.groupBy(low("name").alias("__low")).agg(F.max_by("id", "position").alias("__old"))
    fresh = created.groupBy(low("name").alias("__fresh_low")).agg(F.max_by("id", "position").alias("__fresh"), F.max("position").alias("__since"))
    by_name = links.withColumn("__source", source).join(named, F.lower("__source") == F.col("__low"), "left").join(fresh, (F.lower("__source") == F.col("__fresh_low")) & (F.col("__since") < F.col("position")), "left")
    known = F.when(looks_like_uuid(F.col("__source")), F.col("__source")).otherwise(F.coalesce("__fresh", "__old", "__source"))
    by_name = by_name.withColumn("__from", known).drop("__source", "__low", "__old", "__fresh_low", "__fresh", "__since")
    ids = existing.select(F.trim("id").alias("__known"), F.lit(-1).cast("long").alias("__since")).unionByName(created.select(F.col("id").alias("__known"), F.col("position").cast("long").alias("__since")))
    ids = ids.groupBy("__known").agg(F.min("__since").alias("__since"))
    found = by_name.join(ids, (F.col("__from") == F.col("__known")) & ((F.col("__since") < 0) | (F.col("__since") < F.col("position"))))
    return found.withColumn("link", F.col("link").withField("from_logic_id", F.col("__from"))).drop("__from", "__known", "__since")


def links_in_order(base: DataFrame, more: DataFrame, owner: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Links of each owner after a batch, and how many each of its records added.

    ``base`` (owner, n, link) is what is there, ``more`` (owner, position, n, link) what comes. A link whose trimmed key is there already adds nothing, but a note that
    isn't blank goes to the one that is there, the last note winning.
    """
    base = base.withColumn("position", F.lit(None).cast(more.schema["position"].dataType))
    both = base.select(*owner, "position", "n", "link").unionByName(more.select(*owner, "position", "n", "link"))
    key = F.struct(*[F.coalesce(F.trim(F.col("link")[k]), F.lit("")).alias(k) for k in LINK_KEY])
    place = F.struct(F.coalesce(F.col("position").cast("long"), F.lit(-(2**62))).alias("p"), "n")
    both = tabled(both.withColumns({"__key": key, "__place": place}), "links")
    fresh = F.col("position").isNotNull()
    note = F.when(fresh & ~blank(F.col("link")[NOTE]), F.col("__place"))
    keys = both.groupBy(*owner, "__key").agg(
        F.min("__place").alias("__first"), F.max(F.when(~fresh, F.col("__place"))).alias("__there"), F.max_by(F.trim(F.col("link")[NOTE]), note).alias("__note"), F.max(note).alias("__noted"),
    )
    joined = both.join(keys, [*owner, "__key"]).where(~fresh | (F.col("__place") == F.col("__first")))
    holds = F.col("__place") == F.coalesce("__there", "__first")
    noted = F.when(holds & (F.col("__noted") > F.col("__place")), F.col("link").withField(NOTE, F.col("__note"))).otherwise(F.col("link"))
    kept = joined.select(*owner, "position", "__place", noted.alias("link"))
    links = kept.groupBy(*owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", "link"))), lambda x: x["link"]).alias("links"))
    return links, kept.where(fresh).groupBy(*owner, "position").agg(F.count("*").alias("added"))


def _exploded(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns, F.posexplode("links").alias("n", "link"))


def _appended(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the batch in the catalog's columns, behind all of its rows."""
    last = existing.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("__last"))  # one row
    placed = rows.join(F.broadcast(last)).withColumn("position", (F.col("__last") + 1 + F.col("position")).cast(existing.schema["position"].dataType))
    return placed.withColumn("archived", F.lit(False)).select(existing.columns)


def merge_generated(existing: DataFrame, incoming: DataFrame, content: Sequence[str], material: Sequence[str] = MATERIAL) -> tuple[DataFrame, DataFrame]:
    """What becomes of each generated record, and the catalog after the batch.

    A record whose name and kind (case aside) the catalog has, and whose ``material`` fields differ from that record's present version, replaces it: id, place and
    archiving stay. Otherwise a given id decides: if the catalog has it, links are merged into its record (``merge``, or ``duplicate`` where none is new),
    if a record of the batch was appended with it, it is a ``duplicate``. Without an id a record is a duplicate of an equal ``content`` (which should have name
    and kind) as it came. All else is appended. Of the catalog's records of one name the last counts.

    Decisions: position, decision, target_id, and target_position for a record of the batch that is meant.
    """
    incoming = _with_new_ids(incoming)
    old, new = _with_keys(existing, content), _with_keys(incoming, content)
    fields = F.struct(*[F.col(c) for c in material])
    named = old.where("__name <> ''").groupBy("__name", "__kind").agg(F.max_by(F.struct("id", fields.alias("m"), F.col("__mark").alias("mark"), F.col("position").alias("at")), "position").alias("__named"))
    known = new.select("position", "new_id", "__name", "__kind", "__id", "__mark", fields.alias("__m")).join(named, ["__name", "__kind"], "left")
    known = tabled(known, "known")
    led = last_before(known.where("__named is not null"), ["__name", "__kind"], ["position"], F.struct(F.col("__m").alias("m")), "__was")
    led = led.withColumn("replaced", ~F.coalesce("__was.m", "__named.m").eqNullSafe(F.col("__m"))).drop("__was")
    led = last_before(led, ["__name", "__kind"], ["position"], F.when(F.col("replaced"), F.struct(F.col("__mark").alias("mark"), F.col("position").alias("at"))), "__version")
    version = F.coalesce("__version.mark", "__named.mark")
    own = ["position", "new_id", "__id", "__mark", "__named"]
    free = known.where("__named is null").select(*own, F.lit(False).alias("replaced"), F.lit(None).cast("string").alias("version"))
    rows = tabled(led.select(*own, "replaced", version.alias("version")).unionByName(free), "rows")

    ids = old.select(F.col("__id"), F.lit(True).alias("in_catalog")).where("__id <> ''").distinct()
    rows = rows.join(ids, "__id", "left").withColumn("in_catalog", F.coalesce("in_catalog", F.lit(False)))
    first = rows.where("__id <> '' and not replaced and not in_catalog").groupBy("__id").agg(F.min("position").alias("first_with_id"))
    rows = tabled(rows.join(first, "__id", "left"), "rows")
    opens = F.when(F.col("__id") != "", F.col("first_with_id") == F.col("position")).otherwise(~F.coalesce(F.col("version") == F.col("__mark"), F.lit(False)))
    opener = rows.where("not replaced").where(opens).groupBy("__mark").agg(F.min("position").alias("opened"))
    superseded = named.select(F.col("__named.at").alias("position"))
    stays = old.join(superseded, "position", "left_anti").groupBy("__mark").agg(F.max_by("id", -F.col("position")).alias("same"))
    rows = rows.join(opener, "__mark", "left").join(stays, "__mark", "left")
    by_version = F.coalesce(F.col("version") == F.col("__mark"), F.lit(False))
    has_id = F.col("__id") != ""
    decision = (
        F.when(F.col("replaced"), "replace").when(has_id & F.col("in_catalog"), "merge").when(has_id, F.when(F.col("first_with_id") == F.col("position"), "append").otherwise("duplicate"))
        .when(F.col("same").isNotNull() | by_version | (F.col("opened") < F.col("position")), "duplicate").otherwise("append")
    )
    target = F.when(F.col("replaced"), F.col("__named.id")).when(has_id & F.col("in_catalog"), F.col("__id")).when(~has_id, F.coalesce("same", F.when(by_version, F.col("__named.id"))))
    twin = F.when(has_id & ~F.col("in_catalog") & ~F.col("replaced"), F.col("first_with_id")).when(~has_id & F.col("same").isNull() & ~by_version, F.col("opened"))
    rows = tabled(rows.select("position", "new_id", decision.alias("decision"), target.alias("target_id"), F.when(twin < F.col("position"), twin).alias("target_position")), "decided")

    # links go to the version that their target has at that time
    turns = rows.where("decision in ('replace', 'merge')")
    turns = tabled(last_before(turns, ["target_id"], ["position"], F.when(F.col("decision") == "replace", F.col("position")), "epoch"), "turns")
    link = _exploded(incoming.join(turns.where("decision = 'merge'").select("position", "target_id", "epoch"), "position"), "target_id", "epoch", "position")
    link = _resolved(link, existing, existing.select("id", "name", "position").limit(0))
    replacing = incoming.drop("id").join(turns.where("decision = 'replace'").select("position", F.col("target_id").alias("id")), "position")
    start = F.lit(-1).cast(incoming.schema["position"].dataType)
    base = _exploded(existing, F.trim("id").alias("target_id"), start.alias("epoch")).unionByName(_exploded(replacing, F.col("id").alias("target_id"), F.col("position").alias("epoch")))
    merged, added = links_in_order(base, link.withColumn("epoch", F.coalesce("epoch", start)), ["target_id", "epoch"])
    count = added.groupBy("position").agg(F.sum("added").alias("added"))
    out = rows.join(count, "position", "left").withColumn("decision", F.when((F.col("decision") == "merge") & F.col("added").isNull(), "duplicate").otherwise(F.col("decision")))

    last = turns.where("decision = 'replace'").groupBy("target_id").agg(F.max("position").alias("epoch"))
    put = incoming.drop("id", "archived").join(last.select(F.col("target_id").alias("id"), F.col("epoch").alias("position")), "position").withColumnRenamed("position", "__epoch")
    places = existing.groupBy("id").agg(F.max("position").alias("position"), F.max_by("archived", "position").alias("archived"))
    put = put.join(places, "id").select(existing.columns + ["__epoch"])
    stay = existing.join(last.select(F.col("target_id").alias("id")), "id", "left_anti").withColumn("__epoch", start).select(existing.columns + ["__epoch"])
    now = stay.unionByName(put).drop("links").join(merged.select(F.col("target_id").alias("__t"), F.col("epoch").alias("__e"), "links"), (F.trim("id") == F.col("__t")) & (F.col("__epoch") == F.col("__e")), "left")
    now = now.withColumn("links", F.coalesce("links", F.array().cast(existing.schema["links"].dataType))).select(existing.columns)
    new_rows = incoming.join(rows.where("decision = 'append'").select("position"), "position", "left_semi").withColumn("id", F.when(blank(F.col("id")), F.col("new_id")).otherwise(F.trim("id")))
    return out.select("position", "decision", "target_id", "target_position"), now.unionByName(_appended(existing, new_rows))


def merge_model_generated(existing: DataFrame, incoming: DataFrame, content: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What becomes of each record generated for one model, and the catalog after the batch.

    A record with a blank id is new: it takes a name that is free, case aside, and is created; without a name it is a ``duplicate`` if its ``content`` is there
    already. One with an id brings links to the record with that id, else to the last of its name and kind: ``links`` where some are new, which also
    unarchives it, ``unchanged`` where none is, ``skip`` where there is no such record. Sources of links may be records created before.

    Decisions: position, unique_name, decision, target_id, and added, the number of new links.
    """
    incoming = _with_new_ids(incoming)
    new, old = incoming.where(blank(F.col("id"))), incoming.where(~blank(F.col("id")))
    named = tabled(_with_keys(allocate_names(new, existing.select("name")).drop("name").withColumnRenamed("unique_name", "name"), content), "named")
    nameless = named.where("__name = ''")
    there = _with_keys(existing, content).groupBy("__mark").agg(F.max_by("id", -F.col("position")).alias("same"))
    opened = nameless.groupBy("__mark").agg(F.min("position").alias("opened"))
    judged = named.join(there, "__mark", "left").join(opened, "__mark", "left")
    again = F.col("same").isNotNull() | ((F.col("__name") == "") & (F.col("opened") < F.col("position")))
    judged = tabled(judged.withColumn("decision", F.when(again, "duplicate").otherwise("create")), "created")
    created = judged.where("decision = 'create'")

    kind = F.lower(F.trim(F.coalesce("kind", F.lit(""))))
    by_id = existing.select(F.trim("id").alias("__by_id")).where("__by_id <> ''").distinct()
    by_name = existing.where(~blank(F.col("name"))).groupBy(F.trim("name").alias("__n"), kind.alias("__k")).agg(F.max_by("id", "position").alias("__by_name"))
    found = old.join(by_id, F.trim("id") == F.col("__by_id"), "left").join(by_name, (F.trim("name") == F.col("__n")) & (kind == F.col("__k")), "left")
    # an id of a record that the batch creates before
    own = created.select(F.col("new_id").alias("__own"), F.col("position").alias("__since"))
    found = found.join(own, (F.trim("id") == F.col("__own")) & (F.col("__since") < F.col("position")), "left")
    found = tabled(found.withColumn("target_id", F.coalesce("__by_id", "__own", "__by_name")).drop("__by_id", "__n", "__k", "__by_name", "__own", "__since"), "found")
    link = _exploded(found.where("target_id is not null"), "target_id", "position")
    link = _resolved(link, existing, created.select(F.col("new_id").alias("id"), "name", "position"))
    fresh = _appended(existing, created.withColumn("id", F.col("new_id")))
    both = existing.unionByName(fresh)
    merged, added = links_in_order(_exploded(both, F.trim("id").alias("target_id")), link, ["target_id"])
    told = found.join(added.select("position", "added"), "position", "left")
    told = told.select("position", F.trim("name").alias("unique_name"), F.when(F.col("target_id").isNull(), "skip").when(F.col("added") > 0, "links").otherwise("unchanged").alias("decision"), "target_id", F.coalesce("added", F.lit(0)).alias("added"))
    made = judged.select("position", F.col("name").alias("unique_name"), "decision", F.when(F.col("decision") == "create", F.col("new_id")).otherwise(F.col("same")).alias("target_id"), F.lit(0).cast("long").alias("added"))
    woken = added.select(F.col("target_id").alias("__t")).distinct().withColumn("__woken", F.lit(True))
    after = both.drop("links").join(merged.withColumnRenamed("target_id", "__m"), F.trim("id") == F.col("__m"), "left").join(woken, F.trim("id") == F.col("__t"), "left")
    after = after.withColumns({"links": F.coalesce("links", F.array().cast(existing.schema["links"].dataType)), "archived": F.when(F.col("__woken"), F.lit(False)).otherwise(F.col("archived"))})
    return made.unionByName(told), after.select(existing.columns)
