"""Queries of the sources and sinks that work on files: what is read there is first written from the driver's tables, to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.operators import paths
from cataloom.plans import parsing
from cataloom.plans.parsing import said
from cataloom.plans.registry import Tables, query, text_of
from cataloom.scratch import shared_folder
from cataloom.sources import catalog, reports, runlogs
from cataloom.sources.store import Store


def _folder(t: Tables, label: str) -> str:
    return f"{shared_folder(t.spark)}/cataloom/{label}-{uuid.uuid4().hex}"


@query("""select 'a' || p_partkey as id, p_name as name, p_brand as category, p_size % 2 = 0 as archived, cast(1 as bigint) as n_extras from part union all
  select 'b' || p_partkey, p_name, null, false, cast(0 as bigint) from part where p_partkey % 3 = 0""")
def catalog_documents(t: Tables) -> DataFrame:
    """A catalog written as one document under ``logics`` and read back, and one of old names under ``rules``."""
    one, other = _folder(t, "catalog"), _folder(t, "catalog")
    part = t.part.select(said("a", F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.when(F.col("p_size") % 2 == 0, "yes").otherwise("no").alias("archived"), F.lit("x").alias("more"))
    catalog.write_json(part, one, "logics", 3)
    old = t.part.where("p_partkey % 3 = 0").select(said("b", F.col("p_partkey")).alias("rule_id"), F.col("p_name").alias("rule_name"))
    catalog.write_json(old, other, "rules", 1)
    both = catalog.read_logics(t.spark, one).unionByName(catalog.read_logics(t.spark, other))
    return both.select("id", "name", "category", F.coalesce("archived", F.lit(False)).alias("archived"), F.size("extras").cast("long").alias("n_extras"))


@query("""select cast(p_size as varchar) as id, arg_max(p_name, p_partkey) as name from part group by 1""")
def catalog_indexed(t: Tables) -> DataFrame:
    """A document in which ids come again and again: the last record of an id is the one."""
    folder = _folder(t, "catalog")
    catalog.write_json(t.part.repartitionByRange(2, "p_partkey").sortWithinPartitions("p_partkey").select(text_of("p_size").alias("id"), F.col("p_name").alias("name")), folder, "logics", 1)
    return catalog.index_by_id(catalog.read_logics(t.spark, folder)).select("id", "name")


@query("""select count(*) as n, sum(length(p_name)) as characters, true as dated from part""")
def documents_read(t: Tables) -> DataFrame:
    """Reports written as text files and read as whole documents."""
    folder = _folder(t, "reports")
    t.part.select(said("## Rule ", F.col("p_name"), "\n").alias("value")).repartition(5).write.text(folder)
    found = reports.read_documents(t.spark, folder).where("text <> ''")
    parts = reports.sections(found)
    name = F.regexp_extract("section", r"Rule (.*)", 1)
    return parts.agg(F.count("*").alias("n"), F.sum(F.length(name)).cast("long").alias("characters"), F.bool_and(F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).alias("dated"))


@query("""select source_path, n, first_day from (select 'code/' || o_custkey as source_path, 2 * count(*) as n, cast(cast(max(o_orderdate) as date) as varchar) as first_day from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 group by 1)""")
def logs_read(t: Tables) -> DataFrame:
    """Run logs written as text files, found among others by their first characters, parsed, and numbered by time within their source."""
    from cataloom.operators import lineage

    folder = _folder(t, "logs")
    parsing._logs(t).select(F.col("text").alias("value")).write.text(f"{folder}/a/b")
    t.orders.select(F.col("o_orderpriority").alias("value")).coalesce(1).write.text(f"{folder}/other")
    found = runlogs.runs(runlogs.read_frames(t.spark, folder, "*.txt"))
    placed = lineage.run_positions(found)
    day = F.max(F.when(F.col("position") == 1, F.left("timestamp", F.lit(10)))).alias("first_day")
    return placed.groupBy("source_path").agg(F.count("*").alias("n"), day)


@query("select '.JSON' as extension, 3 as found, true as whole")
def tree_scanned(t: Tables) -> DataFrame:
    """A tree with files of several kinds: those of one extension, with their sizes."""
    folder = _folder(t, "tree")
    t.orders.repartition(3).write.json(f"{folder}/deep/er")
    t.part.write.csv(folder + "/csv")
    found = paths.scan(t.spark, folder, [".json"])
    return found.groupBy("extension").agg(F.count("*").cast("int").alias("found"), F.bool_and(F.col("bytes") > 100).alias("whole"))


@query("""select c_custkey, c_acctbal, 'version 1' as state from customer where c_custkey % 2 = 0
  union all select c_custkey, case when c_custkey % 50 = 0 then -1 else c_acctbal end, 'version 2' from customer where c_custkey % 2 = 0 union all select c_custkey, c_acctbal, 'restored' from customer where c_custkey % 2 = 0""")
def store_versions(t: Tables) -> DataFrame:
    """A table in a store: its first version, one in which some buckets were written anew, and the first one restored."""
    store = Store(t.spark, _folder(t, "store"), 16)
    own = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_acctbal")
    first = store.commit({"customers": (own, ["c_custkey"]), "counts": (own.agg(F.count("*").alias("n")), ["n"])}, 0)
    some = own.where("c_custkey % 50 = 0").select("c_custkey", F.lit(-1.0).alias("c_acctbal"))
    touched = [r[0] for r in some.select(store.bucket("c_custkey")).distinct().collect()]  # at most as many as there are buckets
    rest = store.read("customers", first, touched).join(some, "c_custkey", "left_anti")
    second = store.commit({"customers": (rest.unionByName(some), ["c_custkey"])}, first)
    third = store.restore(first)
    at = lambda v, state: store.read("customers", v).withColumn("state", F.lit(state))
    return at(first, "version 1").unionByName(at(second, "version 2")).unionByName(at(third, "restored"))


@query("""select 'node' as kind, 'c' || c_custkey as id, 'Customer' as label, '{"name":"' || c_name || '"}' as props from customer
  union all select 'node', 'o' || o_orderkey, 'Order', '{"status":"' || o_orderstatus || '"}' from orders union all select 'edge', 'c' || o_custkey || '>o' || o_orderkey, 'PLACED', '{}' from orders""")
def graph_scanned(t: Tables) -> DataFrame:
    """All nodes and all edges of a graph that is kept as two tables under one commit."""
    store = Store(t.spark, _folder(t, "graph"), 8)
    nodes = t.customer.select(said("c", F.col("c_custkey")).alias("id"), F.lit("Customer").alias("label"), F.to_json(F.struct(F.col("c_name").alias("name"))).alias("props"))
    nodes = nodes.unionByName(t.orders.select(said("o", F.col("o_orderkey")).alias("id"), F.lit("Order").alias("label"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("props")))
    edges = t.orders.select(said("c", F.col("o_custkey")).alias("src"), said("o", F.col("o_orderkey")).alias("dst"), F.lit("PLACED").alias("type"), F.lit("{}").alias("props"))
    store.commit({"nodes": (nodes, ["id"]), "edges": (edges, ["src"])}, 0)
    found = store.read("nodes").select(F.lit("node").alias("kind"), "id", "label", "props")
    return found.unionByName(store.read("edges").select(F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("id"), F.col("type").alias("label"), "props"))
