"""Queries of upserts, restores, preparation, graphs and reports, on catalogs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.operators import audit, graph, lineage, names, patch, paths, prepare, report, restore, upsert
from cataloom.plans.parsing import by, said
from cataloom.plans import queries as _  # the summaries that issues are read from
from cataloom.plans.registry import ORACLES, QUERIES, Tables, query, text_of
from cataloom.sources import diagrams

# ---- upserts


@query("""with a as (select p_partkey as k, p_size % 5 as stamp, p_size % 3 as m, 'old' as category from part where p_partkey % 3 <> 0), b as (select p_partkey as k, p_size % 7 as stamp, p_size % 2 as m, 'new' as category from part where p_partkey % 2 = 0)
  select coalesce(b.k, a.k) as name, case when b.k is null or (a.stamp >= b.stamp and a.m = b.m) then a.stamp else b.stamp end as stamp,
    case when b.k is null or (a.stamp >= b.stamp and a.m = b.m) then a.m else b.m end as m, coalesce(a.category, b.category) as category from a full join b on a.k = b.k""")
def upsert_rows(t: Tables) -> DataFrame:
    """The catalog after an upsert: what is updated keeps its category, as it does without force."""
    size, key = F.col("p_size"), F.col("p_partkey")
    old = t.part.where("p_partkey % 3 <> 0").select(key.alias("name"), (size % 5).alias("stamp"), (size % 3).alias("m"), F.lit("old").alias("category"))
    new = t.part.where("p_partkey % 2 = 0").select(key.alias("name"), (size % 7).alias("stamp"), (size % 2).alias("m"), F.lit("new").alias("category"))
    return upsert.upsert(old, new, "name", "stamp", ["m"], keep_columns=["category"])


@query("""with a as (select p_partkey as k, p_size % 5 as stamp, p_size % 3 as m from part where p_partkey % 3 <> 0), b as (select p_partkey as k, p_size % 7 as stamp, p_size % 2 as m from part where p_partkey % 2 = 0),
  d as (select case when b.k is null then 'keep' when a.k is null then 'insert' when a.stamp >= b.stamp and a.m = b.m then 'skip' else 'update' end as d from a full join b on a.k = b.k)
  select count(*) filter (d <> 'keep') as considered, count(*) filter (d = 'update') as updated, count(*) filter (d = 'insert') as new, count(*) filter (d = 'skip') as skipped, count(*) filter (d in ('update', 'insert')) as emitted from d""")
def upsert_outcomes(t: Tables) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    old = t.part.where("p_partkey % 3 <> 0").select(key.alias("name"), (size % 5).alias("stamp"), (size % 3).alias("m"))
    new = t.part.where("p_partkey % 2 = 0").select(key.alias("name"), (size % 7).alias("stamp"), (size % 2).alias("m"))
    return upsert.outcomes(upsert.decide(old, new, "name", "stamp", ["m"]))


@query("""with e as (select cast(c_custkey as varchar) as id, c_name as name from customer where c_custkey % 2 = 0),
  i as (select c_custkey as row, case when c_custkey % 3 = 0 then cast(c_custkey as varchar) when c_custkey % 3 = 1 then 'new' || c_custkey end as id, case when c_custkey % 5 = 0 then 'other' else c_name end as name from customer)
  select row, case when x.id is null and n.id is null then 'append' else 'update' end as decision, coalesce(x.id, n.id, i.id) as target_id from i left join e x on x.id = i.id left join e n on n.name = i.name""")
def models_upserted(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    old = t.customer.where("c_custkey % 2 = 0").select(text_of(key).alias("id"), F.col("c_name").alias("name"))
    new = t.customer.select(key.alias("row"), by(key % 3, text_of(key), said("new", key), F.lit(None).cast("string")).alias("id"), F.when(key % 5 == 0, "other").otherwise(F.col("c_name")).alias("name"))
    return upsert.upsert_models(old, new).select("row", "decision", "target_id")


@query("""with cur as (select o_custkey as m, o_orderkey as id from orders where o_orderkey % 3 = 0), new as (select o_custkey as m, o_orderkey as id from orders where o_orderkey % 4 = 0),
  k as (select m, o_orderstatus || '|' || o_orderpriority as key, id from new join orders on o_orderkey = id),
  kept as (select m, id from cur join orders on o_orderkey = id where (id in (select id from new) or not exists (select 1 from k where k.m = cur.m and k.key = o_orderstatus || '|' || o_orderpriority)))
  select c_custkey as model, (select count(*) from (select id from kept where m = c_custkey union select id from new where m = c_custkey)) as n,
    (select cast(coalesce(sum(id), 0) as bigint) from (select id from kept where m = c_custkey union select id from new where m = c_custkey)) as total from customer""")
def members_updated(t: Tables) -> DataFrame:
    key = text_of("o_orderkey")
    own = lambda where: t.orders.where(where).groupBy("o_custkey").agg(F.array_sort(F.collect_list(key)).alias("ids"))
    models = t.customer.join(own("o_orderkey % 3 = 0"), F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("model"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    new = t.orders.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("model"), key.alias("id"))
    catalog = t.orders.select(key.alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("kind"))
    out = upsert.update_members(models, "model", "ids", new, catalog)
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return out.select("model", F.size("ids").cast("long").alias("n"), total.alias("total"))


@query("""with e as (select n_nationkey as k, case when n_nationkey % 3 = 0 then '' else 't' || n_nationkey end as top, n_name as name, 'old' as d from nation where n_nationkey % 5 <> 0),
  i as (select n_nationkey as k, 't' || n_nationkey as top, case when n_nationkey % 2 = 0 then upper(n_name) else 'Name ' || n_nationkey end as name, case when n_nationkey % 4 = 0 then ' ' else 'new' end as d from nation),
  m as (select i.*, case when e.top = i.top or lower(e.name) = lower(i.name) then e.k end as target from i left join e on e.k = i.k)
  select case when e.top = '' then m.top else e.top end as topId, coalesce(m.name, e.name) as name, case when m.target is null or m.d = ' ' then e.d else m.d end as description from e left join m on m.target = e.k
  union all select case when e.k is not null and e.top = '' then '' else e.top end, e.name, e.d from e where false
  union all select top, name, d from m where target is null""")
def hierarchies_upserted(t: Tables) -> DataFrame:
    key, name = F.col("n_nationkey"), F.col("n_name")
    old = t.nation.where("n_nationkey % 5 <> 0").select(F.when(key % 3 == 0, "").otherwise(said("t", key)).alias("topId"), name.alias("name"), F.lit("old").alias("description"))
    new = t.nation.select(said("t", key).alias("topId"), F.when(key % 2 == 0, F.upper(name)).otherwise(said("Name ", key)).alias("name"), F.when(key % 4 == 0, " ").otherwise("new").alias("description"))
    return upsert.upsert_hierarchies(old, new)


@query("""select p_partkey from part where p_partkey % 4 = 0 or p_partkey in (select s_suppkey from supplier) or lower(p_name) in (select lower(p_name) from part where p_partkey in (select s_suppkey from supplier where s_suppkey < 10))""")
def records_in_scope(t: Tables) -> DataFrame:
    rec = t.part.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(text_of("p_partkey")).alias("id"), F.upper("p_name").alias("name"))
    scope = t.supplier.join(t.part, F.col("s_suppkey") == F.col("p_partkey"), "left").select(text_of("s_suppkey").alias("id"), F.when(F.col("s_suppkey") < 10, F.col("p_name")).alias("name"))
    return upsert.in_scope(rec, scope).select("p_partkey")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'now' when o_orderkey % 2 = 0 then 'before ' || o_custkey end as ids from orders""")
def previous_links_kept(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    now = t.orders.select(key, said("t", key).alias("timestamp"), F.when(key % 7 != 0, "log").alias("log_file"), F.when(key % 3 == 0, F.array(F.lit("now"))).otherwise(F.array().cast("array<string>")).alias("logic_ids"))
    was = t.orders.where("o_orderkey % 2 = 0").select(said("t", key).alias("timestamp"), F.when(key % 7 != 0, "log").alias("log_file"), F.array(said("before ", F.col("o_custkey"))).alias("logic_ids"))
    return upsert.keep_previous_links(now, was).select("o_orderkey", F.when(F.size("logic_ids") > 0, F.array_join("logic_ids", ",")).alias("ids"))


def _linked(t: Tables) -> DataFrame:
    """part as logics whose links are its lineitems; a link is marked as in the graph, as not, or not at all."""
    flag = by(F.col("l_linenumber") % 3, F.lit(True), F.lit(False), F.lit(None).cast("boolean"))
    link = F.struct(text_of("l_suppkey").alias("from_logic_id"), F.col("l_returnflag").alias("from_output"), F.col("l_linestatus").alias("to_input"), F.when(F.col("l_linenumber") % 2 == 0, "SUPPORTS").otherwise("X").alias("kind"), flag.alias("in_graph"))
    links = t.lineitem.groupBy("l_partkey").agg(F.collect_list(link).alias("links"))
    base = t.part.select(text_of("p_partkey").alias("id"), "p_partkey", "p_size")
    return base.join(links, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<from_logic_id:string,from_output:string,to_input:string,kind:string,in_graph:boolean>>"))).drop("l_partkey", "p_partkey")


_SUPPORTED = "(select distinct cast(l_suppkey as varchar) as src, cast(l_partkey as varchar) as dst from lineitem where l_quantity > 20)"


def _supports(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 20").select(text_of("l_suppkey").alias("src"), text_of("l_partkey").alias("dst")).distinct()


@query(f"""select l_partkey as id, count(*) as n from lineitem where l_linenumber % 3 <> 0 or (cast(l_suppkey as varchar), cast(l_partkey as varchar)) in (select (src, dst) from {_SUPPORTED}) group by 1""")
def links_pruned(t: Tables) -> DataFrame:
    out = upsert.prune_links(_linked(t), _supports(t))
    return out.select(F.col("id").cast("long").alias("id"), F.size("links").cast("long").alias("n")).where("n > 0")


@query(f"""with recursive l as (select distinct cast(l_suppkey as varchar) as src, cast(l_partkey as varchar) as dst, case when l_linenumber % 2 = 0 then 'SUPPORTS' else 'X' end as kind, l_linenumber % 3 <> 1 as g from lineitem),
  k as (select distinct * from l where src in (select cast(p_partkey as varchar) from part where p_size % 6 <> 0) and dst in (select cast(p_partkey as varchar) from part where p_size % 6 <> 0)),
  s as (select * from {_SUPPORTED} union select 'gone', 'back' union select 'back', 'gone'), core as (select * from s where dst in (select src from s)), r as (select * from core union select r.src, core.dst from r join core on core.src = r.dst)
  select (select count(*) from part where p_size % 6 = 0) as kg_logic_ids_without_step, cast(1 as bigint) as kg_steps_with_missing_logic,
    (select count(*) from k where kind = 'SUPPORTS' and (src, dst) not in (select (src, dst) from s)) as kg_json_supports_missing_in_kg, (select count(*) from k where g and (src, dst) not in (select (src, dst) from s)) as kg_json_in_graph_links_missing_in_kg,
    (select count(*) from core where (dst, src) in (select (src, dst) from r)) as kg_supports_cycles, (select count(*) from s a join s b on a.src = b.dst and a.dst = b.src where a.src < a.dst) as kg_mutual_support_pairs""")
def graph_checked(t: Tables) -> DataFrame:
    """A catalog against a graph that lacks some steps and edges, and has one step, and one pair both ways, of its own; suppliers and parts share their numbers."""
    steps = t.part.where("p_size % 6 <> 0").select(text_of("p_partkey").alias("id")).union(t.spark.range(1).select(F.lit("gone").alias("id")))
    own = t.spark.createDataFrame([("gone", "back"), ("back", "gone")], "src string, dst string")
    return audit.graph_check(_linked(t), steps, _supports(t).union(own))


_INGESTED = """a as (select p_partkey as k, p_size % 5 as stamp, p_size % 3 as m, p_brand as category, p_size % 2 = 0 as archived from part where p_partkey % 3 <> 0), b as (select p_partkey as k, p_size % 7 as stamp, p_size % 2 as m from part where p_partkey % 2 = 0),
  d as (select coalesce(a.k, b.k) as k, a.k as old, case when b.k is null then 'keep' when a.k is null then 'insert' when not {force} and (a.stamp = b.stamp or (a.stamp >= b.stamp and a.m = b.m)) then 'skip' else 'update' end as decision,
    a.stamp as s0, b.stamp as s1, a.category, a.archived from a full join b on a.k = b.k)
  select 'n' || k as name, case when old is null then 'new' else 'old' end || k as id, case when decision in ('keep', 'skip') then s0 else s1 end as timestamp, case when decision in ('keep', 'skip') or (decision = 'update' and {force}) then category when decision = 'insert' then 'given' end as category,
    case when decision in ('keep', 'skip') then archived else false end as archived, decision from d"""


def _ingested(t: Tables, force: bool) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    old = t.part.where("p_partkey % 3 <> 0").select(said("n", key).alias("name"), said("old", key).alias("id"), (size % 5).alias("timestamp"), (size % 3).alias("m"), F.col("p_brand").alias("category"), (size % 2 == 0).alias("archived"))
    new = t.part.where("p_partkey % 2 = 0").select(said("n", key).alias("name"), said("new", key).alias("id"), (size % 7).alias("timestamp"), (size % 2).alias("m"), F.lit("given").alias("category"), F.lit(True).alias("archived"))
    return upsert.ingest(old, new, force, material=["m"]).drop("m")


@query("with " + _INGESTED.format(force="false"))
def ingested(t: Tables) -> DataFrame:
    """Known stamps are passed over, updates wake archived records and lose their category."""
    return _ingested(t, False)


@query("with " + _INGESTED.format(force="true"))
def ingested_by_force(t: Tables) -> DataFrame:
    return _ingested(t, True)


@query("""select 'link' as kind, case when l_partkey > 20 then '' else 'old' end || l_partkey as owner, cast(l_suppkey as varchar) as ref from lineitem join part on p_partkey = l_partkey where p_size % 4 <> 0 and l_suppkey not in (select p_partkey from part where p_partkey > 20)
  union all select 'model', cast(o_custkey as varchar), cast(o_orderkey as varchar) from orders where o_orderkey not in (select p_partkey from part where p_partkey > 20 and p_size % 4 <> 0)""")
def deletion_report(t: Tables) -> DataFrame:
    """What deleting archived logics would leave broken; the first twenty parts have other ids."""
    key = F.col("p_partkey")
    parts = t.part.select(text_of(key).alias("key"), key, (F.col("p_size") % 4 == 0).alias("archived"))
    logics = _linked(t).withColumnRenamed("id", "key").join(parts, "key").select("links", "archived", F.when(key > 20, F.col("key")).otherwise(said("old", key)).alias("id"))
    models = t.orders.groupBy("o_custkey").agg(F.collect_list(text_of("o_orderkey")).alias("logicIds")).withColumn("id", text_of("o_custkey"))
    return upsert.deletion_report(logics, models)


# ---- replays and patches of logs

_RUNS = """r as (select o_custkey as c, o_orderkey as k, o_orderdate as tm, 'docs/' || o_custkey || '/Out.md' as path, o_orderkey % 5 <> 0 as same, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders),
  d as (select c, path, k, tm, same from r where n = 1 + c % 3), a as (select d.*, d.same as own from d where c % 4 <> 0)"""


def _runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A run for each order of a customer, and for most customers a report that one of the runs wrote."""
    from pyspark.sql import Window

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    body = said("## Rule ", key % 3, "\nof ", key, "\n")
    out = t.orders.select(
        F.lit("/r").alias("root_dir"), F.when(key % 5 == 0, "moved").otherwise("code").alias("source_path"), F.lit("docs").alias("output_path"), said("x/DOCS/", cust, "/out.md").alias("output_file"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), F.col("o_orderdate").alias("run_time"), F.timestamp_seconds(key).alias("mtime"), said("log", F.lpad(text_of(key), 9, "0")).alias("log_file"), F.lit(0).alias("frame"),
        body.alias("response_text"), "o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("n"),
    )
    reports = out.where("n = 1 + o_custkey % 3").select(said("docs/", cust, "/Out.md").alias("path"), F.when(cust % 4 != 0, F.concat(F.lit("\n"), "response_text")).otherwise("## Other").alias("text"), "o_custkey", F.col("timestamp").alias("at"))
    return reports, out


@query(f"""with {_RUNS} select path, cast(1 as bigint) as turn, cast(cast(tm as date) as varchar) as timestamp, '## Rule ' || (k % 3) || chr(10) || 'of ' || k as response from a
  union all select a.path, 1 + row_number() over (partition by a.path order by r.tm, r.k), cast(cast(r.tm as date) as varchar), '## Rule ' || (r.k % 3) || chr(10) || 'of ' || r.k from a join r on r.c = a.c and r.same = a.same and r.tm < a.tm""")
def prior_runs(t: Tables) -> DataFrame:
    reports, runs = _runs(t)
    return lineage.prior_runs(reports, runs).select("path", "turn", "timestamp", F.rtrim(F.regexp_replace("response_text", r"\s+$", "")).alias("response"))


@query(f"""with {_RUNS}, s as (select c, 0 as turn, k % 3 as name, cast(tm as date) as stamp, k from d union all select c, 1, k % 3, cast(tm as date), k from a
    union all select a.c, 1 + row_number() over (partition by a.c order by r.tm, r.k), r.k % 3, cast(r.tm as date), r.k from a join r on r.c = a.c and r.same = a.same and r.tm < a.tm),
  e as (select c_custkey as c, 1 as name, date '1995-06-01' as stamp, c_custkey % 2 as m from customer where c_custkey % 3 <> 0),
  j as (select s.*, s.k % 2 as m, e.stamp as old, e.m as old_m, row_number() over (partition by s.c, s.name, s.stamp order by s.turn) as again, max(case when s.turn = 0 then 1 end) over (partition by s.c, s.name) as current from s left join e on e.c = s.c and e.name = s.name)
  select 'c' || c || ' ' || name as name, arg_max(k, turn) as k from j where (old is not null or current is not null) and case when old is null then again = 1 else old <> stamp and not (old >= stamp and old_m = m) end group by c, j.name""")
def replayed(t: Tables) -> DataFrame:
    """Each customer's sections by turn; where an older run differs from the catalog in what is material, it wins."""
    reports, runs = _runs(t)
    turns = lineage.prior_runs(reports, runs).join(reports.select("path", "o_custkey"), "path").select("o_custkey", "turn", "timestamp", F.col("response_text").alias("text"))
    now = runs.where("n = 1 + o_custkey % 3").select("o_custkey", F.lit(0).cast("long").alias("turn"), "timestamp", F.col("response_text").alias("text"))
    key = F.regexp_extract("text", r"of (\d+)", 1).cast("long")
    sections = turns.unionByName(now).select(said("c", F.col("o_custkey"), " ", key % 3).alias("name"), "timestamp", (key % 2).alias("m"), key.alias("k"), "turn", F.lit(0).alias("position"))
    old = t.customer.where("c_custkey % 3 <> 0").select(said("c", F.col("c_custkey"), " 1").alias("name"), F.lit("1995-06-01").alias("timestamp"), (F.col("c_custkey") % 2).alias("m"))
    return lineage.replay(sections, old, material=["m"]).select("name", "k")


_PATCHED = """l as (select o_orderkey as k, o_custkey as c, 'old/src' || (o_custkey % 7) as src, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders where o_custkey % 3 = 0 or o_orderkey % 2 = 0),
  m as (select c, k, src from l where n = 2 and c % 2 = 0)"""


@query(f"""with {_PATCHED} select 'log' || m.k as path, '/new' as root_dir, 'new/s' as source_path, 'new report ' || m.c as response_text, 'matched' as change from m
  union all select 'log' || l.k, '/new', 'new/s', '**Code Block:** `' || case l.k % 4 when 0 then 'new/s/a' || l.k || '.sql' when 1 then 'new/s/b' || l.k || '.sql' when 2 then 'new/s/c.sql' else 'else/d.sql' end || '` Lines 1' || chr(10) || 'of ' || l.k, 'sibling' from l join m on l.c = m.c and l.k <> m.k""")
def logs_patched(t: Tables) -> DataFrame:
    """Logs of a customer's orders; the report of every second customer was rewritten, and its second newest log has its old text."""
    from pyspark.sql import Window

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    some = t.orders.where("o_custkey % 3 = 0 or o_orderkey % 2 = 0").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))))
    src = said("old/src", cust % 7)
    code = said("**Code Block:** `", by(key % 4, said(src, "/a", key, ".sql"), said("src", cust % 7, "/b", key, ".sql"), "c.sql", "else/d.sql"), "` Lines 1\nof ", key)
    header = F.create_map(F.lit("root_dir"), F.lit("/old"), F.lit("source_path"), src, F.lit("output_path"), said("docs/", cust), F.lit("prompt_template"), F.lit("p"))
    frames = some.select(said("log", key).alias("path"), F.lit(0).alias("frame"), F.timestamp_seconds(key).alias("mtime"), header.alias("header"), code.alias("response_text"), "o_custkey", "n")
    reports = frames.where("n = 2 and o_custkey % 2 = 0").select(said("r", cust).alias("report"), F.concat(F.lit("\n"), "response_text", F.lit(" \n")).alias("old_text"), said("new report ", cust).alias("new_text"), F.lit("/new").alias("root_dir"), F.lit("new/s").alias("source_path"), said("docs/", cust).alias("output_path"))
    out = patch.patch_logs(frames.drop("o_custkey", "n"), reports)
    return out.select("path", F.col("header.root_dir").alias("root_dir"), F.col("header.source_path").alias("source_path"), "response_text", "change")


_MODELS = ORACLES["model_summary"]
_COUNTERS = """links_missing_from_logic, links_missing_required_fields, links_with_blank_required_fields, duplicate_logic_ids, duplicate_logic_names, short_code_name_collisions, logics_with_unknown_category,
  missing_model_logic_refs, hierarchy_tops_missing_logic, hierarchies_missing_top, kg_logic_ids_without_step, kg_steps_with_missing_logic, kg_json_supports_missing_in_kg, kg_json_in_graph_links_missing_in_kg, kg_supports_cycles, kg_mutual_support_pairs"""


@query(f"""with x as (select * from ({ORACLES["integrity_summary"]}) a, ({_MODELS}) b, ({ORACLES["graph_checked"]}) c),
  e as (select (select count(*) from part where p_size % 2 = 0) as extra_logic_fields, (select 2 * count(*) from lineitem where l_linenumber = 1) as extra_link_fields, cast(0 as bigint) as extra_model_fields, (select count(*) from nation) as extra_hierarchy_fields),
  u as (select issue, n from (unpivot (select {", ".join(f"cast({c.strip()} as bigint) as {c.strip()}" for c in _COUNTERS.split(","))} from x) on columns(*) into name issue value n) union all select issue, n from (unpivot (select * from e) on columns(*) into name issue value n))
  select issue, n from u where n > 0""")
def every_issue(t: Tables) -> DataFrame:
    """All twenty counters of the catalog, its models, its fields and its graph, with what each means."""
    one = lambda df, where, *names: df.select(F.when(F.expr(where), F.create_map(*[F.lit(x) for n in names for x in (n, "1")])).alias("extras"))
    extra = audit.extra_counts(logic=one(t.part, "p_size % 2 = 0", "x"), link=one(t.lineitem, "l_linenumber = 1", "x", "y"), model=one(t.customer, "false", "x"), hierarchy=one(t.nation, "true", "z"))
    found = audit.issues(QUERIES["integrity_summary"](t.spark, t.folder), QUERIES["model_summary"](t.spark, t.folder), QUERIES["graph_checked"](t.spark, t.folder), extra)
    return found.where("text <> ''").select("issue", "n")


# ---- restores

_OLD_LINKS = "select l_orderkey as owner, cast(l_suppkey as varchar) as from_logic_id, l_returnflag as from_output, case when l_quantity > 45 then ' ' else l_linestatus end as to_input, 'SUPPORTS' as kind from lineitem"


def _links(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_linenumber", F.col("l_orderkey").alias("owner"), text_of("l_suppkey").alias("from_logic_id"), F.col("l_returnflag").alias("from_output"), F.when(F.col("l_quantity") > 45, " ").otherwise(F.col("l_linestatus")).alias("to_input"), F.lit("SUPPORTS").alias("kind")
    )


@query(f"""with b as (select distinct owner, from_logic_id, from_output, trim(to_input) as to_input, kind from ({_OLD_LINKS})), c as (select distinct owner, from_logic_id, from_output, trim(to_input) as to_input, kind from ({_OLD_LINKS} where l_linenumber % 2 = 0)),
  ids as (select cast(o_orderkey as varchar) as id from orders where o_orderkey % 3 <> 0)
  select *, to_input <> '' and from_logic_id in (select id from ids) as restorable from (select * from b except select * from c) where cast(owner as varchar) in (select id from ids)""")
def links_removed(t: Tables) -> DataFrame:
    ids = t.orders.where("o_orderkey % 3 <> 0").select(text_of("o_orderkey").alias("id"))
    links = _links(t).withColumn("owner", text_of("owner"))
    out = restore.removed_links(links.where("l_linenumber % 2 = 0").drop("l_linenumber"), links.drop("l_linenumber"), ids)
    return out.withColumn("owner", F.col("owner").cast("long"))


@query("""select c_custkey as id, case when c_custkey % 2 = 0 then 'current' else 'backup' end as origin, cast(null as varchar) as reason from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0
  union all select c_custkey, null, case when c_custkey % 2 = 0 then 'is there' else 'not in the backup' end from customer where (c_custkey % 2 = 0 and c_custkey % 3 = 0) or (c_custkey % 2 = 1 and c_custkey % 9 = 1)""")
def logics_restored(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    now = t.customer.where("c_custkey % 2 = 0").select(key.alias("id"), F.lit("current").alias("origin"))
    was = t.customer.where("c_custkey % 3 = 0").select(key.alias("id"), F.lit("backup").alias("origin"))
    rows, refused = restore.restore_logics(now, was, t.customer.where("c_custkey % 3 = 0 or (c_custkey % 2 = 1 and c_custkey % 9 = 1)").select(key.alias("id")))
    return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(refused.withColumn("origin", F.lit(None).cast("string")))


@query("""with b as (select cast(c_custkey as varchar) as id, c_name as name from customer where c_custkey % 2 = 0),
  c as (select case when c_custkey % 3 = 0 then 'n' || c_custkey else cast(c_custkey as varchar) end as id, c_name as name from customer)
  select c.id, coalesce(x.id, n.id) as backup_id from c left join b x on x.id = c.id left join b n on n.name = c.name""")
def models_found(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    was = t.customer.where("c_custkey % 2 = 0").select(text_of(key).alias("id"), F.col("c_name").alias("name"))
    return restore.find_models(t.customer.select(F.when(key % 3 == 0, said("n", key)).otherwise(text_of(key)).alias("id"), F.col("c_name").alias("name")), was)


_HIERARCHIES = """c as (select n_regionkey as model, cast(row_number() over (partition by n_regionkey order by n_nationkey) as integer) as position, n_nationkey as k from nation),
  cur as (select model, position, case when k % 3 = 0 then '' else 't' || k end as topId, 'n' || k as name, 'now' as description from c), bak as (select model, position + 1 as position, case when k % 2 = 0 then 't' || k else '' end as topId, 'n' || k as name, 'was' as description from c where k % 7 <> 0)"""


def _hierarchies(t: Tables) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    k = F.col("n_nationkey")
    c = t.nation.select(F.col("n_regionkey").alias("model"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("position"), "n_nationkey")
    now = c.select("model", "position", F.when(k % 3 == 0, "").otherwise(said("t", k)).alias("topId"), said("n", k).alias("name"), F.lit("now").alias("description"))
    was = c.where("n_nationkey % 7 <> 0").select("model", (F.col("position") + 1).alias("position"), F.when(k % 2 == 0, said("t", k)).otherwise("").alias("topId"), said("n", k).alias("name"), F.lit("was").alias("description"))
    return now, was


@query(f"""with {_HIERARCHIES}, f as (select cur.*, coalesce(a.position, b.position, s.position) as at from cur left join bak a on a.model = cur.model and a.topId = cur.topId and cur.topId <> '' left join bak b on b.model = cur.model and b.name = cur.name
    left join bak s on s.model = cur.model and s.position = cur.position)
  select f.model, f.position, coalesce(bak.topId, f.topId) as topId, coalesce(bak.name, f.name) as name, coalesce(bak.description, f.description) as description from f left join bak on bak.model = f.model and bak.position = f.at""")
def hierarchies_restored(t: Tables) -> DataFrame:
    return restore.restore_hierarchies(*_hierarchies(t))


@query("""select l_orderkey as model, l_partkey as id, case bit_or(case when l_linenumber % 2 = 0 then 1 else 2 end) when 3 then 'kept' when 2 then 'restored' else 'retained' end as state from lineitem group by 1, 2""")
def members_restored(t: Tables) -> DataFrame:
    own = t.lineitem.select(F.col("l_orderkey").alias("model"), F.col("l_partkey").alias("id"), "l_linenumber")
    return restore.restore_members(own.where("l_linenumber % 2 = 0"), own.where("l_linenumber % 2 <> 0"))


@query("""with w as (select doc_id, length(text) as b, md5(text) as s from documents where doc_id % 5 <> 0), n as (select doc_id, length(text) as b, case when doc_id % 7 = 0 then 'x' else md5(text) end as s from documents where doc_id % 3 <> 0)
  select 'f' || coalesce(w.doc_id, n.doc_id) as path, case when n.doc_id is null then 'missing' when w.doc_id is null then 'new' when w.s = n.s then 'same' else 'changed' end as state from w full join n on w.doc_id = n.doc_id""")
def manifest_checked(t: Tables) -> DataFrame:
    files = t.documents.select("doc_id", said("f", F.col("doc_id")).alias("path"), F.length("text").alias("bytes"), F.md5("text").alias("sha256"))
    now = files.where("doc_id % 3 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("sha256")))
    return restore.check_manifest(now, files.where("doc_id % 5 <> 0"))


@query("""with b as (select o_orderkey, '' || o_orderkey as name, case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y%m%d-%H%M%S') when o_orderkey % 3 = 1 then '' end as created, 800000000 + o_orderkey as mtime from orders)
  select name, cast(row_number() over (order by case when created <> '' then cast(replace(created, '-', '') as bigint) else mtime * 1000 end desc, name desc) as integer) as place from b""")
def backups_in_order(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    made = by(key % 3, F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), "", F.lit(None).cast("string"))
    return restore.numbered_backups(t.orders.select(text_of(key).alias("name"), made.alias("created_at"), (key + 800000000).alias("mtime"))).select("name", F.col("place").cast("int").alias("place"))


# ---- preparation


@query("""select p_partkey, p_partkey % 4 = 0 as filled, case when p_size % 3 = 0 then null else p_brand end as category, cast(null as varchar) as owner, cast(p_size as varchar) as timestamp, 'a/' || p_size as code_file,
    case when p_partkey % 4 = 0 then '36' else cast(p_partkey as varchar) end as id from part""")
def defaults_filled(t: Tables) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    rec = t.part.select("p_partkey", F.when(key % 4 == 0, " ").otherwise(text_of(key)).alias("id"), F.when(size % 3 != 0, F.col("p_brand")).alias("category"), size.alias("timestamp"), said("File: a/", size).alias("code_file"))
    out = prepare.fill_defaults(rec)
    return out.select("p_partkey", "filled", "category", "owner", "timestamp", "code_file", F.when(F.col("filled"), F.length("id").cast("string")).otherwise(F.col("id")).alias("id"))


@query("""select cast(p_partkey as varchar) as id, p_name as name, p_type as spec, p_brand as category, cast(null as varchar) as owner, cast(null as varchar) as component, 'f' || p_size as code_file, cast(null as varchar) as code_function,
    cast(null as varchar) as dmn_inputs, cast(null as varchar) as dmn_outputs from part where p_size % 4 < 2""")
def records_shown(t: Tables) -> DataFrame:
    gone = by(F.col("p_size") % 4, "false", F.lit(None).cast("string"), "true", "yes")
    return prepare.shown(t.part.select(text_of("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("spec"), F.col("p_brand").alias("category"), said("f", F.col("p_size")).alias("code_file"), gone.alias("archived"), F.lit(1).alias("timestamp")))


@query("""select p_partkey, p_name from part where p_size % 3 = 0 and p_size % 4 <> 0""")
def records_uncategorised(t: Tables) -> DataFrame:
    category = F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).otherwise(F.when(F.col("p_size") % 2 == 0, " "))
    rec = t.part.select("p_partkey", "p_name", category.alias("category"), (F.col("p_size") % 4 == 0).alias("archived"), F.lit("b").alias("business_area"), F.lit("t").alias("timestamp"))
    return prepare.for_export(prepare.uncategorised(rec)).drop("category")


@query("""select p_partkey, case when p_size % 3 = 0 then 'old ' || p_name else p_name end as name, case when p_size % 4 = 0 then 'step' || p_partkey else 'logic' || p_partkey end as source, p_size % 5 < 2 as archived, 3 as n_fields from part""")
def records_migrated(t: Tables) -> DataFrame:
    """Old records twice through the migration; links carry their source under the old name, the new one or both."""
    size, key = F.col("p_size"), F.col("p_partkey")
    link = F.struct(said("step", key).alias("from_step_id"), F.when(size % 4 == 0, " ").otherwise(said("logic", key)).alias("from_logic_id"), F.col("p_type").alias("kind"), F.lit("x").alias("obsolete"), F.lit("o").alias("from_output"))
    gone = by(size % 5, "true", "1", "false", "0", F.lit(None).cast("string"))
    rec = t.part.select("p_partkey", F.when(size % 3 == 0, "").otherwise(F.col("p_name")).alias("name"), said("old ", F.col("p_name")).alias("rule_name"), F.array(link).alias("links"), gone.alias("archived"))
    once = prepare.rename_nested(prepare.migrate(rec, {"rule_name": "name"}), "links", {}, ["obsolete"])
    out = prepare.migrate(once, {"rule_name": "name"})
    fields = len(out.schema["links"].dataType.elementType.fields)
    return out.select("p_partkey", "name", F.col("links")[0]["from_logic_id"].alias("source"), "archived", F.lit(fields).alias("n_fields"))


# ---- names


@query("""with e as (select lower(p_name) as name, min(cast(p_partkey as varchar)) as id from part where p_partkey % 2 = 0 and p_partkey in (select s_suppkey from supplier) group by 1), g as (select lower(p_name) as name, min('g' || p_partkey) as id from part where p_partkey % 3 = 0 group by 1)
  select p_partkey, coalesce(e.id, g.id) as resolved from part left join e on e.name = lower(p_name) left join g on g.name = lower(p_name)""")
def names_in_scope(t: Tables) -> DataFrame:
    own = t.part.where("p_partkey % 2 = 0").select(text_of("p_partkey").alias("id"), F.upper("p_name").alias("name"))
    made = t.part.where("p_partkey % 3 = 0").select(said("g", F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"))
    return names.resolve_in_scope(t.part.select("p_partkey", "p_name"), "p_name", own, made, "resolved", t.supplier.select(text_of("s_suppkey").alias("id"))).select("p_partkey", "resolved")


@query("select o_orderkey, c_name as name from orders left join customer on c_custkey = o_custkey and c_acctbal > 0")
def names_of_ids(t: Tables) -> DataFrame:
    known = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return names.names_of(t.orders, "o_custkey", known, "name").select("o_orderkey", "name")


# ---- graphs

_FLOW = """e as (select distinct 'l' || o_custkey as src, 'p' || (o_orderkey % 997) as dst, case when o_orderkey % 2 = 0 then 'OUTPUT' else 'INPUT' end as type from orders)"""


def _flow(t: Tables) -> DataFrame:
    """Customers as logics, and what they put out or take in."""
    return t.orders.select(said("l", F.col("o_custkey")).alias("src"), said("p", F.col("o_orderkey") % 997).alias("dst"), F.when(F.col("o_orderkey") % 2 == 0, "OUTPUT").otherwise("INPUT").alias("type"))


@query(f"with {_FLOW} select a.src, b.src as dst, count(*) as n from e a join e b on a.dst = b.dst and a.type = 'OUTPUT' and b.type = 'INPUT' group by 1, 2")
def parameters_shared(t: Tables) -> DataFrame:
    return graph.shared_parameters(_flow(t))


@query("""with e as (select distinct o_custkey as src, o_orderkey % 300 as dst from orders), u as (select dst as id, list_sort(list(src)) as ids from e group by 1), d as (select src as id, list_sort(list(dst)) as ids from e group by 1)
  select c_custkey as id, coalesce(array_to_string(u.ids, ','), '') as upstream, coalesce(array_to_string(d.ids, ','), '') as downstream from customer left join u on u.id = c_custkey left join d on d.id = c_custkey""")
def neighbour_ids(t: Tables) -> DataFrame:
    edges = t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 300).alias("dst"))
    out = graph.neighbour_ids(t.customer.select(F.col("c_custkey").alias("id")), edges)
    return out.select("id", F.array_join("upstream", ",").alias("upstream"), F.array_join("downstream", ",").alias("downstream"))


@query("""select distinct 's' || (p_size % 7) as source, 'fn' || p_size as function from part join lineitem on l_partkey = p_partkey where p_size % 3 <> 0""")
def functions_by_source(t: Tables) -> DataFrame:
    size = F.col("p_size")
    used = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).where(size % 3 != 0).select(said("l", F.col("l_orderkey")).alias("src"), said("fn", size).alias("dst"), F.lit("IMPLEMENTED_BY").alias("type"))
    part = t.part.select(said("fn", size).alias("src"), said("file", size).alias("dst"), F.lit("PART_OF").alias("type")).distinct()
    files = t.part.select(said("file", size).alias("id"), said("s", size % 7).alias("source")).distinct()
    return graph.functions_of_source(used.unionByName(part), files)


@query("""with f as (select distinct 'f' || p_size as id, 'call_' || lpad(cast(p_size as varchar), 3, '0') || '_' || md5(cast(p_size as varchar)) as label from part),
  m as (select o_orderkey, o_custkey % 50 as path, 'call_' || lpad(cast(o_orderkey % 60 as varchar), 3, '#') || '_' || md5(cast(o_orderkey % 60 as varchar)) || '(x)' as said, row_number() over (partition by o_custkey % 50 order by o_orderkey) as step from orders)
  select 'SEQUENCED_BY' as type, f.id as src, path || '#' || step as dst from m join f on f.id = 'f' || (o_orderkey % 60)
  union all select 'PART_OF', path || '#' || step, cast(path as varchar) from m""")
def sequence_graph(t: Tables) -> DataFrame:
    """Messages meet functions whose labels differ from their own in up to two places."""
    from pyspark.sql import Window

    label = lambda k, pad: said("call_", F.lpad(text_of(k), 3, pad), "_", F.md5(text_of(k)))
    functions = t.part.select(said("f", F.col("p_size")).alias("id"), label(F.col("p_size"), "0").alias("label")).distinct()
    own = F.col("o_orderkey") % 60
    step = F.row_number().over(Window.partitionBy("path").orderBy("o_orderkey"))
    said_ = t.orders.select("o_orderkey", text_of(F.col("o_custkey") % 50).alias("path"), F.concat(label(own, "#"), F.lit("(x)")).alias("function_name")).withColumns({"step": step, "from_participant": F.lit("a"), "to_participant": F.lit("b")})
    _, edges = graph.sequence_graph(said_, functions)
    return edges.select("type", "src", "dst")


@query("""with n as (select c_custkey, 1000 + row_number() over (order by c_custkey) as id from customer)
  select o_orderkey, a.id as src, b.id as dst from orders join n a on a.c_custkey = o_custkey join n b on b.c_custkey = o_orderkey % 2000""")
def graph_remapped(t: Tables) -> DataFrame:
    nodes = t.customer.select(F.col("c_custkey").alias("id"))
    edges = t.orders.select("o_orderkey", F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 2000).alias("dst"))
    _, out = graph.remapped(nodes, edges, t.spark.range(1000, 1001))
    return out.select("o_orderkey", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query("""with u as (select distinct p_size as k from part where p_partkey in (select l_partkey from lineitem where l_quantity > 49)), n as (select distinct p_size as k from part)
  select label, count(*) as n from (select 'CodeFunction' as label, k from u union all select distinct 'CodeFile', k % 10 from u union all select 'LogicStep', p_partkey from part
    union all select 'Message', k from n where k % 4 = 0 and k in (select k from u) union all select distinct 'Sequence', k % 3 from n where k % 4 = 0 and k in (select k from u)) group by 1""")
def graph_without_orphans(t: Tables) -> DataFrame:
    """Functions that no logic uses go, and after them their files, the messages that they led, and the sequences of those."""
    size = F.col("p_size")
    one = lambda kind, key, df: df.select(said(kind, key).alias("id"), F.lit(kind).alias("label")).distinct()
    nodes = one("LogicStep", F.col("p_partkey"), t.part).union(one("CodeFunction", size, t.part)).union(one("CodeFile", size % 10, t.part)).union(one("Message", size, t.part)).union(one("Sequence", size % 3, t.part))
    edge = lambda a, x, b, y, kind, df: df.select(said(a, x).alias("src"), said(b, y).alias("dst"), F.lit(kind).alias("type")).distinct()
    used = t.part.join(t.lineitem.where("l_quantity > 49"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    edges = (
        edge("LogicStep", F.col("p_partkey"), "CodeFunction", size, "IMPLEMENTED_BY", used).union(edge("CodeFunction", size, "CodeFile", size % 10, "PART_OF", t.part))
        .union(edge("CodeFunction", size, "Message", size, "SEQUENCED_BY", t.part.where("p_size % 4 = 0"))).union(edge("Message", size, "Sequence", size % 3, "PART_OF", t.part))
    )
    left, _ = graph.without_orphans(nodes, edges)
    return left.groupBy("label").agg(F.count("*").alias("n"))


@query("""with s as (select p_partkey, 'code/' || p_brand as f, 'fn' || p_size as fn from part)
  select label, count(*) as n from (select 'LogicStep' as label, p_partkey || '' as x from s union all select distinct 'CodeFile', f from s union all select distinct 'CodeFunction', f || fn from s where p_partkey % 3 <> 0
    union all select 'Parameter', 'i' || p_partkey from s union all select 'Parameter', 'o' || p_partkey from s) group by 1
  union all select type, count(*) from (select 'IMPLEMENTED_BY' as type, p_partkey || '' as x from s where p_partkey % 3 <> 0 union all select distinct 'PART_OF', f || fn from s where p_partkey % 3 <> 0 union all select 'INPUT', p_partkey || '' from s union all select 'OUTPUT', p_partkey || '' from s
    union all select distinct 'LINKS_TO', l_partkey || '|' || l_suppkey from lineitem) group by 1""")
def property_graph(t: Tables) -> DataFrame:
    """The graph of part as a catalog, counted by label and type."""
    size, key = F.col("p_size"), F.col("p_partkey")
    field = lambda n: F.array(F.struct(F.lit(n).alias("name"), F.lit("int").alias("type")))
    link = F.struct(text_of("l_suppkey").alias("from_logic_id"), F.lit("y").alias("from_output"), F.lit("x").alias("to_input"), F.lit("SUPPORTS").alias("kind"))
    tasks = graph.graph_tasks(t.spark, t.lineitem.count() + 4 * t.part.count())
    links = t.lineitem.repartition(tasks, "l_partkey").groupBy("l_partkey").agg(F.collect_list(link).alias("links"))
    none = {c: F.lit(None).cast("string") for c in ("kind", "owner", "component", "timestamp")}
    logics = t.part.select(text_of(key).alias("id"), key, F.col("p_name").alias("name"), said("./code//", F.col("p_brand")).alias("code_file"), F.when(key % 3 != 0, said("fn", size)).otherwise(" ").alias("code_function"), field("x").alias("dmn_inputs"), field("y").alias("dmn_outputs"))
    logics = logics.join(links, F.col("p_partkey") == F.col("l_partkey"), "left").withColumns(none)
    nodes, edges = graph.property_graph(logics, tasks)
    return nodes.groupBy("label").agg(F.count("*").alias("n")).union(edges.groupBy("type").agg(F.count("*").alias("n")))


@query("""with s as (select n_regionkey as r, n_nationkey as k, 'Type' || (n_nationkey % 4) as base from nation),
  n as (select r, base, row_number() over (partition by base order by 'd' || r) as n from (select distinct r, base from s)),
  p as (select cast(p_partkey as varchar) as id, upper(right(cast(p_partkey as varchar), 3)) as code, lower(p_name) as name from part), l as (select code, name, min(id) as id from p group by 1, 2)
  select 'd' || r || '::' || base as src, 'd' || r as dst, 'PART_OF' as type from n union all select 'd' || n.r || '::' || base, 'd' || f.r || '::' || base, 'SYNONYM' from n join n f using (base) where n.n > 1 and f.n = 1
  union all select distinct id, 'd' || r || '::' || base, 'OPERATES_ON' from s join part on p_partkey = k join l on l.code = upper(right(cast(k as varchar), 3)) and l.name = lower(p_name)
  union all select distinct 'd' || r || '::' || a, 'd' || r || '::' || b, 'RELATED_TO' from (select r, base as a, 'Type0' as b from s where base <> 'Type0' and r in (select r from s where base = 'Type0') union all select r, 'Type0', base from s where base <> 'Type0' and r in (select r from s where base = 'Type0'))""")
def domain_graph(t: Tables) -> DataFrame:
    """Types of the regions' diagrams, their namesakes, relations both ways, and the logics in their notes (code and name decide)."""
    base = said("Type", F.col("n_nationkey") % 4)
    types = t.nation.select(said("d", F.col("n_regionkey")).alias("path"), base.alias("name"), F.lit("class").alias("kind")).distinct()
    relations = t.nation.where("n_nationkey % 4 <> 0").select(said("d", F.col("n_regionkey")).alias("path"), base.alias("left"), F.lit("Type0").alias("right"), F.lit("near").alias("label"))
    logics = t.part.select(text_of("p_partkey").alias("id"), F.col("p_name").alias("name"))
    noted = t.nation.join(t.part, F.col("n_nationkey") == F.col("p_partkey")).select(said("d", F.col("n_regionkey")).alias("path"), base.alias("entity"), F.lower(F.right(text_of("n_nationkey"), F.lit(3))).alias("code"), F.upper("p_name").alias("name"))
    _, edges = graph.domain_graph(types, relations, noted, logics)
    return edges.select("src", "dst", "type").distinct()


@query("""with n as (select n_regionkey as r, n_name as name, row_number() over (partition by n_nationkey % 4 order by n_nationkey) as n, n_nationkey as k from nation)
  select 'd' || r || '::' || name as id, case when k % 2 = 0 then 'about ' || lower(name) end as description, case when k % 2 = 0 then '{"key":"of ' || k || '"}' end as attributes from n
  union all select distinct 'd' || r, null, null from n""")
def domain_described(t: Tables) -> DataFrame:
    """Types of a domain graph and what is described of every second one, under a name with blanks and a number."""
    path = said("d", F.col("n_regionkey"))
    types = t.nation.select(path.alias("path"), F.col("n_name").alias("name"), F.lit("class").alias("kind"))
    none = lambda spec: t.spark.createDataFrame([], spec)
    nodes, _ = graph.domain_graph(types, none("path string, left string, right string, label string"), none("path string, entity string, code string, name string"), none("id string, name string"))
    name = F.concat(F.left("n_name", F.lit(2)), F.lit(" "), F.substr("n_name", F.lit(3)), F.lit(" (2)"))
    text = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("path"), said("### ", name, "\nabout ", F.lower("n_name"), "\n**Attributes:**\n- key: of ", F.col("n_nationkey"), "\n").alias("text"))
    return graph.described(nodes, diagrams.entity_descriptions(text, "path")).select("id", "description", "attributes")


# ---- reports and files


@query("""select line_no, text from (select cast(row_number() over (order by part, rank, low, p_partkey) as integer) as line_no, text from (
  select 0 as part, 0 as rank, '' as low, -1 as p_partkey, '# All rules' as text
  union all select 1, case p_type when 'SMALL' then 1 when 'LARGE' then 2 else 500 end, lower(p_name), p_partkey, '- [' || p_name || '](#' || replace(lower(p_name), ' ', '-') || ')' from part
  union all select 2, case p_type when 'SMALL' then 1 when 'LARGE' then 2 else 500 end, lower(p_name), p_partkey, '## ' || p_name || chr(10) || chr(10) || '**Purpose:** of ' || p_brand || chr(10) || chr(10)
    || '**Code:** `f' || p_size || '` (Lines ' || p_size || '–' || (p_size + 1) || ')' || chr(10) || chr(10) from part))""")
def detailed_report(t: Tables) -> DataFrame:
    size = F.col("p_size")
    logics = t.part.select(
        text_of("p_partkey").alias("id"), "p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("category"), said("of ", F.col("p_brand")).alias("purpose"), F.lit("").alias("spec"), F.lit(None).cast("string").alias("example"), said("f", size).alias("code_file"), F.array(size, size + 1).alias("code_lines"),
    )
    order = report.report_order(F.col("category"), F.col("name"), {"SMALL": 1, "LARGE": 2})
    return report.document(logics, [*order[:2], F.col("p_partkey")], "All rules")


@query("""with g as (select p_brand as f, min(p_partkey) as first_position, list(p_name order by p) as names from (select p_brand, p_name, min(p_partkey) as p, min(p_partkey) as p_partkey from part group by 1, 2) group by 1)
  select first_position, '## ' || f || chr(10) || chr(10) || array_to_string(list_transform(names, lambda n: '- ' || n), chr(10)) || chr(10) as text from g
  union all select first_position, f || chr(10) || array_to_string(list_transform(names, lambda n: '  ' || n), chr(10)) || chr(10) from g
  union all select first_position, '{"file":"' || f || '","logics":["' || array_to_string(names, '","') || '"]}' from g""")
def exports(t: Tables) -> DataFrame:
    rec = t.part.select(F.col("p_brand").alias("code_file"), F.col("p_name").alias("name"), F.lit(False).alias("archived"), F.col("p_partkey").alias("position"))
    grouped = report.grouped_export(rec)
    return report.export_text(grouped, "md").union(report.export_text(grouped)).union(report.export_text(grouped, "json"))


@query("""select 'log' as kind, 'f' || doc_id as path, source, case when doc_id % 2 = 0 or n_chars < 200 then 'rejected' else 'kept' end as decision, case when doc_id % 2 = 0 then 'even' when n_chars < 200 then 'short' end as reason,
    doc_id % 2 = 1 as odd, n_chars >= 200 as long from documents""")
def audited(t: Tables) -> DataFrame:
    out = report.audit_rows(t.documents.withColumn("path", said("f", F.col("doc_id"))), "log", "path", "source", {"odd": F.col("doc_id") % 2 == 1, "long": F.col("n_chars") >= 200}, {"odd": "even", "long": "short"})
    return out.select("kind", "path", "source", "decision", "reason", F.col("tests")["odd"].alias("odd"), F.col("tests")["long"].alias("long"))


@query("""with f as (select p_partkey, replace(lower(p_name), ' ', '_') || '-' || p_size as f from part), n as (select *, row_number() over (partition by f order by p_partkey) as n from f)
  select p_partkey, f || case when n = 1 then '' else '_' || (n - 1) end || '.drl' as file_name from n""")
def file_names(t: Tables) -> DataFrame:
    rec = t.part.select("p_partkey", said(" ", F.upper("p_name"), "!-", F.col("p_size"), "? ").alias("title"))
    return paths.file_names(rec, "title", "p_partkey", ".drl").select("p_partkey", "file_name")


@query("""with f as (select c_custkey, 'r' || (c_custkey % 40) as base, c_custkey % 5 as way, c_acctbal as age from customer),
  p as (select base, way, age, '/out/' || base || '/' || case way when 0 then base || '.md' when 1 then base || '-1of' || c_custkey || '.json' when 2 then 'x' || c_custkey || '.md' when 3 then base || '.txt' else base || '-new.md' end as path from f)
  select base, path from (select *, row_number() over (partition by base order by way >= 2, age desc, path) as n from p where way <> 3) where n = 1""")
def newest_reports(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    base = said("r", key % 40)
    name = by(key % 5, F.concat(base, F.lit(".md")), said(base, "-1of", key, ".json"), said("x", key, ".md"), F.concat(base, F.lit(".txt")), F.concat(base, F.lit("-new.md")))
    return paths.newest_reports(t.customer.select(said("/out/", base, "/", name).alias("path"), F.col("c_acctbal").alias("mtime")))


@query("""with k as (select distinct p_brand as b, 'src/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_brand, '#', '') || '.sql' as path from part)
  select p_partkey, 'see `' || k.path || '` and `' || k.path || '` not none/x' || p_size || '.sql' as text, true as changed from part join k on k.b = p_brand""")
def reports_rewritten(t: Tables) -> DataFrame:
    file = F.replace("p_brand", F.lit("#"), F.lit(""))
    old = said("/old/place/", F.upper(file), ".sql")
    docs = t.part.select("p_partkey", said("see `", old, "` and `", old, "` not none/x", F.col("p_size"), ".sql").alias("text"))
    known = t.part.select(said("src/", F.lower(file), "/", file, ".sql").alias("known")).distinct()
    out, changes = paths.rewrite(docs, "p_partkey", "text", "`([^`]+)`", known, "known")
    done = changes.select(F.col("p_partkey").alias("k"), F.lit(True).alias("changed")).distinct()
    return out.join(done, F.col("p_partkey") == F.col("k"), "left").select("p_partkey", "text", "changed")


@query("""select r_name as "group", p_type as category, array_to_string(list_sort(list(distinct p_name)), ',') as names from part join region on r_regionkey = length(p_type) % 5 where r_regionkey % 2 = 1 group by 1, 2""")
def excluded_by_category(t: Tables) -> DataFrame:
    categories = t.part.select(F.col("p_type").alias("name"), text_of(F.length("p_type") % 5).alias("groupId")).distinct()
    groups = t.region.where("r_regionkey % 2 = 1").select(text_of("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    out = report.excluded_by_category(t.part.select(F.col("p_name").alias("name"), said(" ", F.col("p_type")).alias("category")), categories, groups)
    return out.select("group", "category", F.array_join("names", ",").alias("names"))
