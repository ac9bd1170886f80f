"""The catalog operators on the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions import text as T
from cataloom.operators import audit, cycles, generated, graph, keys, lineage, match, names, report, sets, upsert
from cataloom.plans.registry import ORACLES as ORACLES
from cataloom.plans.registry import QUERIES as QUERIES
from cataloom.plans.registry import Tables, query, text_of
from cataloom.sources import catalog, diagrams, jsonish, reports
from cataloom.streaming import ingest

# ---- records by key


@query("""select user_id, event_id, ts, event_type, value from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n = 1""")
def latest_per_key(t: Tables) -> DataFrame:
    return keys.latest(t.events, ["user_id"], ["event_id", "ts", "event_type", "value"], ["ts", "event_id"])


@query("select p_name, count(*) as n from part group by p_name having count(*) > 1")
def dup_names(t: Tables) -> DataFrame:
    return keys.duplicates(t.part, ["p_name"])


@query("select p_partkey, p_name from part p where p_partkey < (select max(p_partkey) from part q where q.p_name = p.p_name)")
def older_versions(t: Tables) -> DataFrame:
    return keys.older_versions(t.part, "p_name", "p_partkey").select("p_partkey", "p_name")


@query("""select p_partkey, case when n = 1 then p_name else p_name || ' (' || n || ')' end as unique_name
  from (select *, row_number() over (partition by p_name order by p_partkey) n from part)""")
def name_suffix_running(t: Tables) -> DataFrame:
    return keys.number_occurrences(t.part, "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("""select p_partkey, case when n = 1 then p_name else p_name || ' (' || n || ')' end as unique_name
  from (select *, row_number() over (partition by p_name order by p_partkey) n from part)""")
def name_suffix_base(t: Tables) -> DataFrame:
    numbered = t.part.withColumn("name", F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" ("), text_of("p_size"), F.lit(")"))).otherwise(F.col("p_name")))
    return keys.number_bases(numbered, "name", "p_partkey").select("p_partkey", "unique_name")


@query("""with new as (select p_partkey, p_name, p_brand from part where p_partkey % 4 = 0),
  used as (select p_brand as b, (p_size % 4) + 1 as n from part where p_partkey % 4 = 1 group by 1, 2),
  free as (select b.p_brand as b, k.n, row_number() over (partition by b.p_brand order by k.n) as r
    from (select distinct p_brand from new) b, (select unnest(range(1, 20000)) as n) k
    where not exists (select 1 from used u where u.b = b.p_brand and u.n = k.n)),
  ranked as (select *, row_number() over (partition by p_brand order by p_partkey) as r from new)
  select p_partkey, case when f.n = 1 then p_brand else p_brand || ' (' || f.n || ')' end as unique_name
  from ranked k join free f on f.b = k.p_brand and f.r = k.r""")
def name_allocation(t: Tables) -> DataFrame:
    n = F.col("p_size") % 4 + 1
    taken = t.part.where("p_partkey % 4 = 1").select(F.when(n == 1, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit(" ("), n.cast("string"), F.lit(")"))).alias("name"))
    new = t.part.where("p_partkey % 4 = 0").select("p_partkey", F.col("p_brand").alias("name"), F.col("p_partkey").alias("position"))
    return keys.allocate_names(new, taken).select("p_partkey", "unique_name")


_WISHES = """(select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) as i, p_brand || case when p_partkey % 4 = 1 then ' (' || (p_size % 40 + 2) || ')' when p_partkey % 4 = 2 then ' (2) (' || (p_size % 4 + 2) || ')' else '' end as wish from part where p_partkey % 4 <> 3)"""


@query(f"""with recursive w as {_WISHES}, one as (select p_brand, list(distinct p_brand || ' (' || (p_size % 10 + 2) || ')') as used from part where p_partkey % 4 = 3 group by 1),
  r as (select distinct w.p_brand, cast(0 as bigint) as i, cast(null as bigint) as p_partkey, coalesce(used, []) as used, cast(null as varchar) as name from w left join one using (p_brand)
    union all select p_brand, i, p_partkey, list_append(used, name), name from (
      select r.p_brand, w.i, w.p_partkey, r.used, case when not list_contains(r.used, w.wish) then w.wish else w.wish || ' (' || list_min([n for n in range(2, len(r.used) + 3) if not list_contains(r.used, w.wish || ' (' || n || ')')]) || ')' end as name
      from r join w on w.p_brand = r.p_brand and w.i = r.i + 1))
  select p_partkey, name as unique_name from r where i > 0""")
def verbatim_names(t: Tables) -> DataFrame:
    """Brands as names that are wished for, many with numbers of their own: what is handed out to one is taken for the next."""
    size, key, brand = F.col("p_size"), F.col("p_partkey"), F.col("p_brand")
    put = lambda *x: F.concat(brand, *[F.lit(c) if isinstance(c, str) else text_of(c) for c in x])
    taken = t.part.where("p_partkey % 4 = 3").select(put(" (", size % 10 + 2, ")").alias("name"))
    wish = F.when(key % 4 == 1, put(" (", size % 40 + 2, ")")).when(key % 4 == 2, put(" (2) (", size % 4 + 2, ")")).otherwise(brand)
    new = t.part.where("p_partkey % 4 <> 3").select("p_partkey", wish.alias("name"), key.alias("position"))
    return keys.allocate_names(new, taken).select("p_partkey", "unique_name")


@query("select p_brand, p_type, min(p_partkey) as p_partkey from part group by all")
def keep_first_per_key(t: Tables) -> DataFrame:
    return keys.pick(t.part, ["p_brand", "p_type"], [F.col("p_partkey")]).select("p_brand", "p_type", "p_partkey")


@query("""select p_brand, p_partkey, p_name, first_position from (select *, min(p_partkey) over (partition by p_brand) as first_position,
  row_number() over (partition by p_brand order by p_partkey desc) as n from part) where n = 1""")
def keep_last_in_place(t: Tables) -> DataFrame:
    return keys.keep_last(t.part, ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "p_name", "first_position")


@query("""select o_custkey, o_orderpriority, o_orderkey, o_orderstatus from (
  select *, row_number() over (partition by o_custkey, o_orderpriority order by (o_orderstatus = 'F'), o_orderkey) n from orders) where n = 1""")
def prefer_active(t: Tables) -> DataFrame:
    picked = keys.pick(t.orders, ["o_custkey", "o_orderpriority"], [F.col("o_orderstatus") == "F", F.col("o_orderkey")])
    return picked.select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")


# ---- references and differences


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def dangling_refs(t: Tables) -> DataFrame:
    return sets.dangling(t.documents.select("doc_id"), "doc_id", t.labels, "doc_id")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def dangling_orders(t: Tables) -> DataFrame:
    return sets.dangling(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey")


@query("""select o_custkey, o_orderstatus, o_orderpriority, 'added' as change from (
    select o_custkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 5 <> 0
    except select o_custkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 7 <> 0)
  union all select o_custkey, o_orderstatus, o_orderpriority, 'removed' from (
    select o_custkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 7 <> 0
    except select o_custkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 5 <> 0)""")
def link_diff_added_removed(t: Tables) -> DataFrame:
    return sets.difference(t.orders.where("o_orderkey % 7 <> 0"), t.orders.where("o_orderkey % 5 <> 0"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("""select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey,
    case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed' when a.p = b.p then 'same' else 'changed' end as status
  from (select o_orderkey, o_orderpriority as p from orders where o_orderkey % 7 <> 0) a
  full join (select o_orderkey, case when o_orderkey % 3 = 0 then 'none' else o_orderpriority end as p from orders where o_orderkey % 5 <> 0) b on a.o_orderkey = b.o_orderkey""")
def id_diff(t: Tables) -> DataFrame:
    after = t.orders.where("o_orderkey % 5 <> 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise(F.col("o_orderpriority")))
    return sets.compare(t.orders.where("o_orderkey % 7 <> 0"), after, "o_orderkey", ["o_orderpriority"])


@query("select distinct o_custkey from orders where o_orderstatus = 'O' intersect select distinct o_custkey from orders where o_orderstatus = 'F'")
def id_intersection(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O'").select("o_custkey").intersect(t.orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("""with c as (select c_custkey from customer where c_acctbal >= 0), o as (select o_orderkey from orders where o_custkey in (select c_custkey from c))
  select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from o)""")
def cascade_delete(t: Tables) -> DataFrame:
    orders = sets.surviving(t.customer.where("c_acctbal >= 0"), "c_custkey", t.orders, "o_custkey")
    return sets.surviving(orders, "o_orderkey", t.lineitem, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("select distinct user_id, event_type from events")
def append_unique(t: Tables) -> DataFrame:
    return sets.append_unique(t.events.where("event_id % 2 = 0"), t.events.where("event_id % 3 = 0 or event_id % 2 = 1"), ["user_id", "event_type"])


# ---- names and lookups


_NAMED = "select p_partkey, p_name || ' ' || p_size as name, p_brand || ' ' || p_size || ' ' || p_name as full_name from part"


@query(f"""with p as ({_NAMED}), u as (select name, min(p_partkey) as id from p group by 1 having count(*) = 1),
  f as (select full_name, min(p_partkey) as id from p group by 1 having count(*) = 1)
  select p.p_partkey, coalesce(u.id, f.id, -1) as resolved from p left join u on u.name = p.name left join f on f.full_name = p.full_name""")
def unique_name_join(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_size").alias("name"), F.concat_ws(" ", "p_brand", "p_size", "p_name").alias("full_name"))
    targets = p.select("p_partkey", "name").union(p.select("p_partkey", "full_name"))
    return names.resolve_unambiguous(p, ["name", "full_name"], targets, "name", "p_partkey", "resolved").select("p_partkey", F.coalesce("resolved", F.lit(-1)).alias("resolved"))


@query("""select c.c_custkey, n.k as nation from customer c left join (select lower(n_name) as name, min(n_nationkey) as k from nation group by 1) n
  on n.name = lower('NATION_' || (c.c_custkey % 40))""")
def name_join_ci(t: Tables) -> DataFrame:
    refs = t.customer.withColumn("ref", F.concat(F.lit("NATION_"), text_of(F.col("c_custkey") % 40)))
    return names.resolve(refs, "ref", t.nation, "n_name", "n_nationkey", "nation", ignore_case=True).select("c_custkey", "nation")


@query("""select p_partkey, coalesce(a.g, b.g, 'Uncategorized') as label from part p
  left join (select p_brand as k, min(p_type) as g from part group by 1) a on p.p_size % 3 <> 0 and a.k = p.p_brand
  left join (select p_size as k, min(p_type) as g from part group by 1) b on p.p_size % 2 = 0 and b.k = p.p_size""")
def category_group_lookup(t: Tables) -> DataFrame:
    groups = t.part.select(F.col("p_brand").alias("gname"), F.col("p_size").alias("gid"), F.col("p_type").alias("glabel"))
    asked = t.part.select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("by_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("by_id"))
    return names.group_of(asked, "by_name", "by_id", groups, "gname", "gid", "glabel", F.lit("Uncategorized"), "label").select("p_partkey", "label")


@query("""select l_orderkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as integer) as member_position, l_partkey from lineitem""")
def ordered_members(t: Tables) -> DataFrame:
    items = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    return names.members(items, "ids", t.part, "p_partkey").select("l_orderkey", "member_position", F.col("p_partkey").alias("l_partkey"))


@query("""select r.r_name as owner, n.n_name as category from region r join nation n
    on n.n_nationkey % 3 = 0 or lower(trim(r.r_name)) = lower((select r_name from region where r_regionkey = n.n_regionkey))
  where n.n_regionkey <> 4""")
def eligible_categories(t: Tables) -> DataFrame:
    region = t.region.select("r_regionkey", F.col("r_name").alias("team_name"))
    leaves = t.nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("name"), text_of("n_regionkey").alias("groupId"), F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), F.upper("team_name"))).alias("team")
    )
    groups = t.region.select(text_of("r_regionkey").alias("id"), (F.col("r_regionkey") == 4).alias("archived"))
    return catalog.eligible_categories(leaves, groups, t.region.select(F.col("r_name").alias("owner")))


# ---- counts, costs, coverage


@query("select o_orderpriority as priority, count(*) as n from orders group by 1")
def count_table(t: Tables) -> DataFrame:
    return report.count_table(t.orders, F.col("o_orderpriority"), "Uncategorized", "priority")


@query("""select case when p_size % 9 = 0 then '(missing)' when p_size % 7 = 0 then '(blank)' else p_brand end as kind, count(*) as n from part group by 1
  order by n desc, kind limit 10""")
def link_kinds(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") % 9 == 0, F.lit(None)).when(F.col("p_size") % 7 == 0, "  ").otherwise(F.col("p_brand"))
    return audit.labels_by_count(t.part.select(kind.alias("kind")), "kind", top=10)


_COST = "(floor(value) / 1000.0 * 0.005 + (event_id % 1000) / 1000.0 * 0.015)"


def _costed(t: Tables) -> DataFrame:
    cost = report.cost(F.floor("value").cast("double"), (F.col("event_id") % 1000).cast("double"), F.lit("gpt-4o-2024"))
    return t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"), cost.alias("cost"))


@query(f"select strftime(ts, '%Y-%m-%d') as day, count(*) as n, cast(round(sum({_COST}) * 1e6) as bigint) as micro_usd from events group by 1")
def cost_per_day(t: Tables) -> DataFrame:
    return report.cost_by_time(_costed(t)).where("day is not null and hour is null").select("day", "n", F.round(F.col("total") * 1e6).cast("long").alias("micro_usd"))


@query(f"""select strftime(ts, '%Y-%m-%d') as day, cast(hour(ts) as integer) as hour, count(*) as n, cast(round(sum({_COST}) * 1e6) as bigint) as micro_usd from events
  group by grouping sets ((1, 2), (1), ())""")
def cost_grouping_sets(t: Tables) -> DataFrame:
    return report.cost_by_time(_costed(t)).select("day", "hour", "n", F.round(F.col("total") * 1e6).cast("long").alias("micro_usd"))


@query("""select event_type, count(distinct user_id) as files, round(100.0 * count(distinct user_id) / (select count(distinct user_id) from events), 6) as percent
  from events where value > 40 group by 1""")
def coverage_pct(t: Tables) -> DataFrame:
    seen = t.events.where("value > 40")
    return report.coverage(seen, "event_type", "user_id", t.events, "user_id").withColumn("percent", F.round("percent", 6))


@query("select user_id, event_type, count(*) as n, max(ts) as last_seen from events group by 1, 2")
def activity_last_seen(t: Tables) -> DataFrame:
    return report.last_seen(t.events, ["user_id", "event_type"], "ts")


@query("""with f as (select source as s, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) as nonempty, text,
    length(text) - length(replace(text, chr(10), '')) + case when text <> '' and text not like '%' || chr(10) then 1 else 0 end as l,
    len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'IF') or contains(x, 'DO') or contains(x, 'SELECT') or contains(x, 'WHEN') or contains(x, 'ELSE')
      or contains(x, 'FOR') or contains(x, 'WHILE') or contains(x, 'SUBR') or contains(x, 'PROC') or contains(x, 'CALLP'))) as c,
    len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) as t, length(text) as k from documents)
  select s as extension, count(*) as files, cast(sum(l) as bigint) as lines, cast(sum(c) as bigint) as complex_lines, cast(sum(t) as bigint) as tokens, cast(sum(k) as bigint) as chars,
    round(sum(c) / sum(l), 9) as ratio, round(sum(l) * (sum(c) / sum(l)) * 30 / 100, 6) as effort from f group by rollup (s)""")
def file_stats_rollup(t: Tables) -> DataFrame:
    out = report.file_statistics(t.documents, F.col("source"), F.col("text"))
    return out.withColumn("ratio", F.round("ratio", 9)).withColumn("effort", F.round("effort", 6))


@query("""with p as (select string_split(regexp_extract(regexp_replace(url, '^[^:]*://[^/?#]*', ''), '^[^?#]*'), '/') as raw, page_id from pages),
  q as (select page_id, list_filter(raw, lambda x: x <> '') as parts from p), e as (select parts, unnest(range(0, len(parts))) as i from q where len(parts) > 0)
  select array_to_string(parts[1:i], '/') as folder, upper(regexp_extract(parts[len(parts)], '(\\.[^./]+)$', 1)) as extension, count(*) as n from e group by 1, 2""")
def folder_counts(t: Tables) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"^[^:]*://[^/?#]*", ""), r"[?#].*$", "")
    return report.counts_by_folder(t.pages.select(F.regexp_replace(path, "/+$", "").alias("path")).where("path <> ''"), F.col("path"))


@query("""select r.report, round(r.i * s.x, 4) as input_tokens, round(r.o * s.x, 4) as output_tokens, round(r.i * s.x / 1e6 * 2.5 + r.o * s.x / 1e6 * 10, 6) as cost
  from (values ('Analyze', 5287, 791), ('Component Model', 5961, 604), ('UX Model', 6053, 439), ('Domain Model', 6197, 773), ('Use Cases and Scenarios', 6719, 1731),
    ('Code Review', 5280, 1041), ('Business Rules', 5320, 1728)) r(report, i, o), (select sum(l_quantity) / 1872 / 0.91566265 as x from lineitem) s""")
def llm_effort(t: Tables) -> DataFrame:
    total = t.lineitem.agg(F.sum("l_quantity").alias("tokens"))
    e = report.llm_estimate(total, "tokens")
    return e.select("report", F.round("input_tokens", 4).alias("input_tokens"), F.round("output_tokens", 4).alias("output_tokens"), F.round("cost", 6).alias("cost"))


@query("select unnest(json_keys(props)) as field, count(*) as n from events group by 1")
def unexpected_fields(t: Tables) -> DataFrame:
    return audit.unexpected_fields(t.events.select(F.from_json("props", "map<string,string>").alias("extras")))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def events_by_hour(t: Tables) -> DataFrame:
    return ingest.counts_by_window(t.events, "ts", "event_type")


# ---- integrity


def _logics(t: Tables) -> DataFrame:
    """part as logics and the lineitems of each as its links."""
    kind = F.when(F.col("l_quantity") > 45, F.lit(None)).when(F.col("l_quantity") > 40, " ").otherwise(F.col("l_returnflag"))
    source = F.when(F.col("l_suppkey") % 10 == 0, F.concat(F.lit("x"), text_of("l_suppkey"))).otherwise(text_of("l_suppkey"))
    link = F.struct(F.col("l_linestatus").alias("from_output"), F.col("l_returnflag").alias("to_input"), kind.alias("kind"), source.alias("from_logic_id"))
    links = t.lineitem.groupBy("l_partkey").agg(F.collect_list(link).alias("links"))
    category = F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_brand"))
    base = t.part.select("p_partkey", text_of("p_partkey").alias("id"), F.col("p_name").alias("name"), category.alias("category"), (F.col("p_size") % 10 == 0).alias("archived"))
    return base.join(links, F.col("p_partkey") == F.col("l_partkey"), "left").drop("l_partkey", "p_partkey")


_SUMMARY = """with c as (select distinct p_brand as b from part where p_size < 3),
  lk as (select cast(l_partkey as varchar) as owner, case when l_quantity > 45 then null when l_quantity > 40 then ' ' else l_returnflag end as kind,
    case when l_suppkey % 10 = 0 then 'x' || l_suppkey else cast(l_suppkey as varchar) end as src from lineitem),
  ps as (select *, cast(p_partkey as varchar) as id, right(cast(p_partkey as varchar), 3) as code from part)
  select count(*) as total, count(*) filter (p_size % 10 = 0) as archived, count(*) filter (p_size % 10 <> 0) as active,
    (select count(*) from lk) as links, (select count(distinct owner) from lk) as logics_with_links, count(*) - (select count(distinct owner) from lk) as logics_without_links,
    count(*) filter (p_size % 7 <> 0) as logics_with_category, count(*) filter (p_size % 7 = 0) as logics_without_category,
    count(*) filter (p_size % 7 <> 0 and p_brand not in (select b from c)) as logics_with_unknown_category,
    (select count(*) from lk where src in (select id from ps)) as links_with_from_logic, (select count(*) from lk where src not in (select id from ps)) as links_missing_from_logic,
    (select count(*) from lk where kind is null) as links_missing_required_fields, (select count(*) from lk where kind = ' ') as links_with_blank_required_fields,
    cast(0 as bigint) as duplicate_logic_ids, (select count(*) from (select p_name from part group by 1 having count(*) > 1)) as duplicate_logic_names,
    (select count(*) from (select code, p_name from ps group by 1, 2 having count(*) > 1)) as short_code_name_collisions from part"""


def _summary(t: Tables) -> DataFrame:
    return audit.logic_summary(_logics(t), t.part.where("p_size < 3").select(F.col("p_brand").alias("name")))


@query(_SUMMARY)
def integrity_summary(t: Tables) -> DataFrame:
    return _summary(t)


@query(f"""with s as ({_SUMMARY}) select issue, n from (unpivot (select links_missing_from_logic, links_missing_required_fields, links_with_blank_required_fields,
  duplicate_logic_ids, duplicate_logic_names, short_code_name_collisions, logics_with_unknown_category from s) on columns(*) into name issue value n) where n > 0""")
def issue_list(t: Tables) -> DataFrame:
    return audit.issues(_summary(t)).select("issue", "n")


@query("""with r as (select o_custkey, o_orderkey from orders), h as (select c_custkey, case when c_custkey % 4 = 0 then '' else cast(c_custkey as varchar) end as top from customer)
  select (select count(*) from customer) as models, (select count(*) from r) as model_logic_refs, (select count(distinct o_orderkey) from r) as distinct_model_logic_refs,
    (select count(*) from r where o_orderkey not in (select p_partkey from part)) as missing_model_logic_refs, (select count(*) from h) as hierarchies,
    (select count(*) from h where top = '') as hierarchies_missing_top, (select count(*) from h where top <> '' and c_custkey in (select p_partkey from part)) as hierarchies_with_top,
    (select count(*) from h where top <> '' and c_custkey not in (select p_partkey from part)) as hierarchy_tops_missing_logic""")
def model_summary(t: Tables) -> DataFrame:
    refs = t.orders.groupBy("o_custkey").agg(F.collect_list(text_of("o_orderkey")).alias("logicIds"))
    top = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(text_of("c_custkey"))
    models = t.customer.select("c_custkey", F.array(F.struct(top.alias("topId"))).alias("hierarchies")).join(refs, F.col("c_custkey") == F.col("o_custkey"), "left")
    return audit.model_summary(models, t.part.select(text_of("p_partkey").alias("id")))


# ---- parsing


@query("""with h as (select page_id, unnest(regexp_extract_all(html, '<h[1-6]>(.*?)</h[1-6]>', 1)) as raw, generate_subscripts(regexp_extract_all(html, '<h[1-6]>(.*?)</h[1-6]>', 1), 1) as i from pages)
  select page_id, cast(i - 1 as integer) as position,
    regexp_replace(regexp_replace(regexp_replace(trim(raw), '^\\s*#{1,6}\\s*', ''), '\\s*#{1,6}\\s*$', ''), '^[ *\\t-]+|[ *\\t-]+$', '', 'g') as name from h""")
def sections(t: Tables) -> DataFrame:
    marked = F.regexp_replace(F.regexp_replace("html", "</h[1-6]>", "\n"), "<h[1-6]>", "\n## ")
    found = reports.sections(t.pages.select("page_id", F.concat(F.lit("x"), marked).alias("text")))
    return found.select("page_id", "position", reports.heading(F.col("section")).alias("name"))


@query("""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, cast(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) as bigint) as n_links from pages""")
def page_title_links(t: Tables) -> DataFrame:
    links = F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), links.cast("long").alias("n_links"))


@query("""select p_partkey, p_name as name, p_type as type, case when p_partkey % 3 = 0 then null else p_brand || '|' || p_size || '|' || 'a b' end as allowed from part""")
def dmn_decl_parse(t: Tables) -> DataFrame:
    values = F.concat(F.lit(' [Allowed Values: "'), "p_brand", F.lit('", '), text_of("p_size"), F.lit(", 'a b', ]"))
    line = F.concat(F.lit("- `"), "p_name", F.lit("` : "), "p_type", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(values))
    d = t.part.select("p_partkey", reports.declaration(line).alias("d"))
    return d.select("p_partkey", "d.name", "d.type", F.array_join("d.allowedValues", "|").alias("allowed"))


_NORMAL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\x0b\\f]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')"


@query(f"select left(sha256({_NORMAL}), 12) as fingerprint, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def fingerprint_groups(t: Tables) -> DataFrame:
    mark = F.left(F.sha2(T.normalise_text(F.col("text")), 256), F.lit(12))
    return t.documents.groupBy(mark.alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("select p_partkey, upper(right(md5(cast(p_partkey as varchar)), 3)) as code from part")
def short_codes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.short_code(F.concat_ws("-", F.lit("id"), F.md5(text_of("p_partkey")))).alias("code"))


@query("""select p_partkey, (p_size % 5 = 0) or (p_size % 7 = 0) or (p_size % 11 = 0) as is_outcome from part""")
def outcome_names(t: Tables) -> DataFrame:
    name = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" Is "), "p_type")).when(F.col("p_size") % 7 == 0, F.concat("p_brand", F.lit(" Eligible"))).when(F.col("p_size") % 11 == 0, F.lit("best route taken")).otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", T.is_outcome_name(name).alias("is_outcome"))


@query("select page_id from pages where regexp_replace(url, '^[^:]*://[^/?#]*', '') like '/en/%' or regexp_matches(regexp_replace(url, '^[^:]*://[^/?#]*', ''), '^/en$')")
def path_prefix(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", r"^[^:]*://[^/?#]*", "")
    return t.pages.where(T.path_under(path, "/EN/", ignore_case=True)).select("page_id")


@query("select event_id, props as json, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_lenient(t: Tables) -> DataFrame:
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here you are:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so {not json} "), "props", F.lit(" done"))).otherwise(F.col("props"))
    found = t.events.select("event_id", jsonish.lenient(said).alias("json"))
    return found.select("event_id", "json", F.get_json_object("json", "$.k").cast("long").alias("k"))


@query("""select conv_id, turn, cast(sum(s) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as island from (
  select *, case when role is distinct from lag(role) over (partition by conv_id order by turn) then 1 else 0 end as s from conversations)""")
def islands(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.withColumn("starts", ~F.col("role").eqNullSafe(before))
    return diagrams.islands(rows, ["conv_id"], "turn", F.col("starts")).select("conv_id", "turn", "island")


# ---- lineage and matching


@query("select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)")
def content_match(t: Tables) -> DataFrame:
    return match.containing(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


@query("""with w as (select item_id, string_split(text, ' ') as w from benchmark), p as (select distinct item_id, array_to_string(w[i:i + 7], ' ') as part from w, unnest(range(1, len(w) + 1, 8)) as r(i))
  select p.item_id, d.doc_id, count(*) as score from p join documents d on contains(d.text, p.part) group by 1, 2""")
def overlap_score(t: Tables) -> DataFrame:
    words = F.split("text", " ")
    parts = t.benchmark.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(words), F.lit(8)), lambda i: F.array_join(F.slice(words, i, 8), " "))).alias("part"))
    found = lineage.overlap_scores(parts, "item_id", "part", t.documents, "doc_id", "text")
    return found.select(F.col("document").alias("item_id"), F.col("run").alias("doc_id"), "score")


@query("""with s as (select user_id, event_type, count(distinct hour(ts)) as k, max(ts) as newest from events group by 1, 2),
  b as (select * from (select *, row_number() over (partition by user_id order by k desc, newest desc, event_type) as n from s) where n = 1)
  select user_id, event_type, cast(h as integer) as hour, event_id from (
    select e.*, hour(ts) as h, row_number() over (partition by e.user_id, hour(ts) order by ts desc, event_id) as n from events e join b on b.user_id = e.user_id and b.event_type = e.event_type) where n = 1""")
def best_series(t: Tables) -> DataFrame:
    runs = t.events.withColumn("hour", F.hour("ts"))
    return lineage.best_series(runs, ["user_id"], "event_type", "hour", "ts", "event_id").select("user_id", "event_type", "hour", "event_id")


@query("""with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders)
  select r.o_custkey, l.l_partkey as id from r join lineitem l on l.l_orderkey = r.o_orderkey where r.n = 1""")
def latest_run_ids(t: Tables) -> DataFrame:
    ids = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("logic_ids"))
    runs = t.orders.join(ids, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("logic_ids", F.coalesce("logic_ids", F.array().cast("array<bigint>")))
    return lineage.latest_run_ids(runs, "o_custkey", "o_orderdate", "o_orderkey")


@query("""with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
  s as (select a.vec_id as query, b.vec_id as target, round(list_dot_product(a.v, b.v), 9) as s from e a join e b on a.vec_id <> b.vec_id)
  select query, target, round(s, 6) as score from (select *, row_number() over (partition by query order by s desc, target) as n from s) where n = 1 and s >= 0.2""")
def knn_top1(t: Tables) -> DataFrame:
    found = match.best_vectors(t.embeddings, t.embeddings, "vec_id", "embedding", least=0.2)
    return found.select("query", "target", F.round("score", 6).alias("score"))


@query("""with recursive e as (select vec_id, cast(embedding as double[]) as v from embeddings),
  s as (select a.vec_id as query, b.vec_id as target, round(list_dot_product(a.v, b.v), 9) as s from e a join e b on b.vec_id % 20 <> 0 where a.vec_id % 20 = 0),
  o as (select query, list({'t': target, 's': s} order by s desc, target) as offers from s where s >= 0.25 group by 1),
  q as (select e.vec_id as query, coalesce(o.offers, []) as offers, row_number() over (order by e.vec_id) as n from e left join o on o.query = e.vec_id where e.vec_id % 20 = 0),
  r as (select cast(0 as bigint) as n, cast(null as bigint) as query, cast([] as bigint[]) as used, cast(null as bigint) as target, cast(0 as double) as score
    union all
    select q.n, q.query, case when f.best is null then r.used else list_append(r.used, f.best.t) end, f.best.t, coalesce(f.best.s, 0)
    from r join q on q.n = r.n + 1, lateral (select list_filter(q.offers, lambda x: not list_contains(r.used, x.t))[1] as best) f)
  select query, target, round(score, 6) as score from r where n > 0""")
def greedy_match(t: Tables) -> DataFrame:
    asked = t.embeddings.where("vec_id % 20 = 0")
    found = match.assign_vectors(asked, t.embeddings.where("vec_id % 20 <> 0"), "vec_id", "embedding", least=0.25)
    return match.with_unmatched(asked, "vec_id", found).withColumn("score", F.round("score", 6))


@query("""with a as (select distinct p_name[1:p_size % 4] || '#' || p_name[p_size % 4 + 2:] || case when p_size % 5 = 0 then ' (of old)' else '' end as n from part), b as (select distinct p_name as c from part),
  o as (select n, c, case when length(n) <= length(c) then lower(n) else lower(c) end as s, case when length(n) <= length(c) then lower(c) else lower(n) end as l from a, b),
  d as (select n, c, list_min(list_transform(range(0, length(l) - length(s) + 1), lambda i: list_sum(list_transform(range(1, length(s) + 1), lambda j: case when s[j] <> l[i + j] then 1 else 0 end)))) as dist from o)
  select n as name, c as candidate, cast(dist as integer) as distance from (select *, row_number() over (partition by n order by dist, c) as k from d) where k = 1 and dist <= 3""")
def substr_hamming(t: Tables) -> DataFrame:
    at = (F.col("p_size") % 4).cast("int")
    said = F.concat(F.substr("p_name", F.lit(1), at), F.lit("#"), F.substr("p_name", at + 2), F.when(F.col("p_size") % 5 == 0, " (of old)").otherwise(""))
    return match.nearest_names(t.part.select(said.alias("said")), "said", t.part, "p_name")


_PATHS = r"""p as (select page_id, list_filter(string_split(regexp_extract(regexp_replace(url, '^[^:]*://[^/?#]*', ''), '^[^?#]*'), '/'), lambda x: x <> '') as x from pages),
  q as (select page_id, case when page_id % 10 = 4 then list_concat(x[1:len(x) - 1], ['Box.lwc', 'box.js']) when page_id % 10 = 6 then list_concat(['lwc_bundle'], x[1:len(x) - 1], [upper(x[len(x)])])
    when page_id % 10 = 3 then list_concat(['src'], x[1:len(x) - 1], ['Box']) when page_id % 10 = 5 then list_concat(x[1:len(x) - 1], [x[len(x)] || '.lwc']) else x end as x from p where len(x) > 0)"""


@query(rf"""with {_PATHS}, n as (select page_id, x, list_transform(x, lambda c: case when regexp_replace(c, '\.lwc$', '') = 'lwc_bundle' then 'lwc' else regexp_replace(c, '\.lwc$', '') end) as y from q),
  a as (select distinct x, y from n where page_id % 2 = 0), b as (select distinct x as m, y as z from n where page_id % 2 = 1),
  direct as (select x, arg_min(array_to_string(m, '/'), (len(m), array_to_string(m, '/'))) as match from a join b on lower(x[len(x)]) = lower(m[len(m)]) group by x),
  ways as (select x, y as w from a union select x, y[1:len(y) - 1] from a where len(x) > 1 and x[len(x) - 1] like '%_.lwc' and starts_with(lower(x[len(x)]), lower(regexp_replace(x[len(x) - 1], '\.lwc$', '')) || '.')),
  s as (select x, m, len(m) as k, (select count(*) from (select unnest(range(1, least(len(w), len(z)) + 1)) as i) where list_reverse(w)[1:i] = list_reverse(z)[1:i]) as c
    from ways join b on w[len(w)] = z[len(z)] where x not in (select x from direct)),
  far as (select x, arg_min(array_to_string(m, '/'), (-c, k, array_to_string(m, '/'))) as match, max(c) as common from s group by x)
  select array_to_string(x, '/') as path, match, 0 as common from direct union all select array_to_string(x, '/'), match, cast(common as integer) from far""")
def suffix_path_match(t: Tables) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"^[^:]*://[^/?#]*", ""), r"[?#].*$", "")
    x = F.filter(F.split(path, "/"), lambda c: c != "")
    front, last = F.slice(x, 1, F.size(x) - 1), F.element_at(x, -1)
    n = F.col("page_id") % 10
    put = (
        F.when(n == 4, F.concat(front, F.array(F.lit("Box.lwc"), F.lit("box.js")))).when(n == 6, F.concat(F.array(F.lit("lwc_bundle")), front, F.array(F.upper(last))))
        .when(n == 3, F.concat(F.array(F.lit("src")), front, F.array(F.lit("Box")))).when(n == 5, F.concat(front, F.array(F.concat(last, F.lit(".lwc"))))).otherwise(x)
    )
    paths = t.pages.where(F.size(x) > 0).select("page_id", F.array_join(put, "/").alias("path"))
    return match.best_suffix(paths.where("page_id % 2 = 0"), "path", paths.where("page_id % 2 = 1"), "path")


@query("""select conv_id, turn, (select count(*) from conversations d where d.conv_id = c.conv_id and d.turn < c.turn) as n_before,
  (select count(*) from conversations d where d.conv_id = c.conv_id and d.turn > c.turn) as n_after from conversations c""")
def sequence_before_after(t: Tables) -> DataFrame:
    return graph.sequence_neighbours(t.conversations.withColumn("id", F.col("turn")), "conv_id", "turn", "id").select("conv_id", "turn", "n_before", "n_after")


# ---- graphs

_EDGES = "(select o_orderkey as src, o_orderkey // 4 as dst from orders union select o_orderkey // 4, o_orderkey from orders where o_custkey % 25 = 0)"


def _edges(t: Tables) -> DataFrame:
    """Every order leads to one of a quarter of its number, and those of some customers are led to by it too."""
    up = t.orders.select(F.col("o_orderkey").alias("src"), F.floor(F.col("o_orderkey") / 4).alias("dst"), "o_custkey")
    back = up.where("o_custkey % 25 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return up.select("src", "dst").union(back).distinct()


_CLOSURE = f"e as {_EDGES}, r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst)"


@query(f"with recursive {_CLOSURE} select src, dst from r")
def closure(t: Tables) -> DataFrame:
    return cycles.closure(_edges(t)).select("src", "dst")


@query(f"with recursive {_CLOSURE} select e.src, e.dst from e join r on r.src = e.dst and r.dst = e.src")
def cycle_edges(t: Tables) -> DataFrame:
    return cycles.cyclic_edges(_edges(t))


@query("""with k as (select o_orderkey as k, o_orderkey // 2 as c, o_custkey from orders),
  e as (select k as src, k + 1 as dst, c from k where k % 2 = 0 union select k, k - 1, c from k where k % 2 = 1 and o_custkey % 5 <> 0 union select k, k - 3, c from k where k % 2 = 1 and c % 500 <> 0
    union select min(k), min(k) // 1000 * 1000 + 998, min(c) from k where k % 2 = 1 group by k // 1000 having k // 1000 % 3 = 0)
  select src, dst from e where src // 1000 % 3 = 0 and exists (select 1 from k where k.k = src // 1000 * 1000 + 1) and src // 1000 = dst // 1000
    or (src // 2 = dst // 2 and exists (select 1 from e r where r.src = e.dst and r.dst = e.src))""")
def cycle_chain(t: Tables) -> DataFrame:
    """Orders two by two, most pairs leading to each other, each to the pair before; every third thousand is closed to a ring."""
    k = t.orders.select(F.col("o_orderkey").alias("k"), "o_custkey")
    even, odd = k.where("k % 2 = 0"), k.where("k % 2 = 1")
    to = lambda rows, step: rows.select(F.col("k").alias("src"), (F.col("k") + step).alias("dst"))
    first = F.floor(F.col("k") / 1000)
    ring = odd.groupBy(first.alias("n")).agg(F.min("k").alias("src")).where("n % 3 = 0").select("src", (F.floor(F.col("src") / 1000) * 1000 + 998).alias("dst"))
    chain = to(odd.where(F.floor(F.col("k") / 2) % 500 != 0), -3)
    return cycles.cyclic_edges(to(even, 1).unionByName(to(odd.where("o_custkey % 5 <> 0"), -1)).unionByName(chain).unionByName(ring))


@query(f"""with recursive {_CLOSURE}, p as (select o_orderkey as src, o_orderkey // 64 as dst from orders union select o_orderkey // 16, o_orderkey from orders union select o_orderkey, o_custkey from orders)
  select p.src, p.dst, r.src is not null as reached from p left join r on r.src = p.src and r.dst = p.dst""")
def reachable_pairs(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    up = t.orders.select(k.alias("src"), F.floor(k / 64).alias("dst"))
    down = t.orders.select(F.floor(k / 16).alias("src"), k.alias("dst"))
    return cycles.ReachIndex(_edges(t)).reaches(up.union(down).union(t.orders.select("o_orderkey", "o_custkey")))


@query(f"with e as {_EDGES} select a.src as u, a.dst as v from e a join e b on a.src = b.dst and a.dst = b.src where a.src < a.dst")
def mutual_pairs(t: Tables) -> DataFrame:
    return graph.mutual_pairs(_edges(t))


@query(f"""with e as {_EDGES}, n as (select src as id from e union select dst from e union select 10000000), o as (select src, count(distinct dst) as k from e group by 1), i as (select dst, count(distinct src) as k from e group by 1),
  d as (select id, coalesce(i.k, 0) as n_in, coalesce(o.k, 0) as n_out from n left join o on o.src = id left join i on i.dst = id)
  select id, n_in, n_out, n_out = 0 and n_in > 0 as is_terminal, n_in = 0 and n_out > 0 as is_source, n_in = 0 and n_out = 0 as is_isolated, n_in > 1 as has_many_before, n_out > 1 as has_many_after,
    n_in > 0 and n_out > 0 as is_mid_chain from d""")
def degree_roles(t: Tables) -> DataFrame:
    e = _edges(t)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).union(t.spark.range(10000000, 10000001)).distinct()
    return graph.roles(nodes, e)


# ---- upserts


@query("""with a as (select o_orderkey as k, cast(o_orderdate as date) as d, o_orderstatus as s from orders where o_orderkey % 3 <> 0),
  b as (select o_orderkey as k, cast(o_orderdate as date) + cast(o_orderkey % 4 - 1 as integer) as d, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end as s from orders where o_orderkey % 2 = 0)
  select coalesce(a.k, b.k) as o_orderkey, case when b.k is null then 'keep' when a.k is null then 'insert' when a.d >= b.d and a.s = b.s then 'skip' else 'update' end as decision
  from a full join b on a.k = b.k""")
def upsert_decision(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    old = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", day.cast("string").alias("stamp"), "o_orderstatus")
    status = F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus"))
    new = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.date_add(day, (F.col("o_orderkey") % 4 - 1).cast("int")).cast("string").alias("stamp"), status.alias("o_orderstatus"))
    return upsert.decide(old, new, "o_orderkey", "stamp", ["o_orderstatus"]).select("o_orderkey", "decision")


@query("""with s as (select l_orderkey as owner, cast(l_suppkey % 3 as varchar) as from_logic_id, l_returnflag as from_output, l_linestatus as to_input, 'SUPPORTS' as kind,
    case when l_linenumber % 2 = 0 then 1 else 0 end as age, case when l_partkey % 4 = 0 then null else cast(l_partkey as varchar) end as note from lineitem)
  select owner, from_logic_id, from_output, to_input, kind, arg_max(note, (age, note)) filter (note is not null) as link_explanation from s group by all""")
def link_merge(t: Tables) -> DataFrame:
    note = F.when(F.col("l_partkey") % 4 == 0, " ").otherwise(text_of("l_partkey"))
    source = F.concat(F.lit(" "), text_of(F.col("l_suppkey") % 3))
    links = t.lineitem.select(F.col("l_orderkey").alias("owner"), source.alias("from_logic_id"), F.col("l_returnflag").alias("from_output"), F.col("l_linestatus").alias("to_input"), F.lit("SUPPORTS").alias("kind"), note.alias("link_explanation"), "l_linenumber")
    return upsert.merge_links(links.where("l_linenumber % 2 <> 0"), links.where("l_linenumber % 2 = 0"), "owner")


@query("""select distinct l_orderkey as owner, l_suppkey as from_logic_id, l_returnflag as from_output, l_linestatus as to_input, 'X' as kind from lineitem
  where l_suppkey in (select s_suppkey from supplier where s_acctbal > 0)""")
def link_scrub(t: Tables) -> DataFrame:
    links = t.lineitem.select(F.col("l_orderkey").alias("owner"), F.col("l_suppkey").alias("from_logic_id"), F.col("l_returnflag").alias("from_output"), F.col("l_linestatus").alias("to_input"), F.lit("X").alias("kind"))
    return upsert.scrub_links(links, "owner", t.supplier.where("s_acctbal > 0"), "s_suppkey")


@query("""select o_custkey as log_path, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') as ids, max(o_orderkey) as created_at from orders group by 1""")
def array_union_sorted(t: Tables) -> DataFrame:
    rec = t.orders.select(F.col("o_custkey").alias("log_path"), F.array("o_orderpriority").alias("logic_ids"), F.col("o_orderkey").alias("created_at"))
    out = upsert.record_executions(rec.where("created_at % 2 = 0"), rec.where("created_at % 2 = 1"))
    return out.select("log_path", F.array_join("logic_ids", ",").alias("ids"), "created_at")


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'old ' || c_name else c_name end as name, c_acctbal from customer""")
def rename_coalesce(t: Tables) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name"))
    old = t.customer.select("c_custkey", name.alias("name"), F.concat(F.lit("old "), "c_name").alias("rule_name"), "c_acctbal", F.lit(1).alias("obsolete"))
    return upsert.rename(upsert.rename(old, {"rule_name": "name"}, ["obsolete"]), {"rule_name": "name"}, ["obsolete"]).select("c_custkey", "name", "c_acctbal")


@query("""select p_partkey, case when p_brand in (select p_brand from part where p_size = 1) then p_brand else '' end as category from part""")
def blank_unknown_categories(t: Tables) -> DataFrame:
    known = t.part.where("p_size = 1").select(F.col("p_brand").alias("name"))
    return upsert.blank_unknown_categories(t.part.select("p_partkey", F.col("p_brand").alias("category")), known).select("p_partkey", "category")


_GENERATED = """g as (select p_partkey as row, p_name as name, p_brand as kind, case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then cast(p_partkey as varchar) else cast(p_partkey - p_partkey % 10 as varchar) end as given,
    cast(p_partkey as varchar) as own, p_size % 3 as dmn, p_size % 5 as purpose, cast(2 * p_size as varchar) || '|o' || (p_size % 2) as link from part),
  e as (select row, own as id, name, kind, dmn, purpose, case when row % 4 <> 0 then '2|o0' end as link from g where row % 2 = 0), i as (select row, given as id, name, kind, dmn, purpose, link from g where row % 2 = 1),
  n as (select name, kind, arg_max({'id': id, 'dmn': dmn, 'purpose': purpose, 'row': row}, row) as x from e group by 1, 2),
  a as (select i.*, n.x, x.id is not null and i.dmn <> coalesce(lag(i.dmn) over (partition by i.name, i.kind order by i.row), n.x.dmn) as replaced, i.id in (select id from e) as known from i left join n on n.name = i.name and n.kind = i.kind),
  v as (select *, coalesce(last_value(case when replaced then {'dmn': dmn, 'purpose': purpose} end ignore nulls) over (partition by name, kind order by row rows between unbounded preceding and 1 preceding), {'dmn': x.dmn, 'purpose': x.purpose}) as ver from a),
  w as (select *, x.id is not null and ver.dmn = dmn and ver.purpose = purpose as by_version, min(case when not replaced and not known and id <> '' then row end) over (partition by id) as first_id from v),
  o as (select name, kind, dmn, purpose, min(row) as opened from w where not replaced and case when id <> '' then first_id = row else not by_version end group by all),
  s as (select name, kind, dmn, purpose, arg_min(id, row) as same from e where row not in (select x.row from n) group by all),
  d as (select w.row, w.link, case when replaced then 'replace' when id <> '' and known then 'merge' when id <> '' then case when first_id = w.row then 'append' else 'duplicate' end when same is not null or by_version or opened < w.row then 'duplicate' else 'append' end as decision,
    case when replaced then x.id when id <> '' and known then id when id = '' then coalesce(same, case when by_version then x.id end) end as target_id,
    case when replaced then null when id <> '' and not known then first_id when id = '' and same is null and not by_version then opened end as twin
    from w left join o on (o.name, o.kind, o.dmn, o.purpose) = (w.name, w.kind, w.dmn, w.purpose) left join s on (s.name, s.kind, s.dmn, s.purpose) = (w.name, w.kind, w.dmn, w.purpose)),
  t as (select *, coalesce(max(case when decision = 'replace' then row end) over (partition by target_id order by row rows between unbounded preceding and 1 preceding), -1) as epoch from d where decision in ('replace', 'merge')),
  b as (select id as target_id, -1 as epoch, link from e where link is not null union all select target_id, row, link from t where decision = 'replace'),
  f as (select *, split_part(link, '|', 1) in (select id from e) and row_number() over (partition by target_id, epoch, link order by row) = 1 and (target_id, epoch, link) not in (select (target_id, epoch, link) from b) as fresh from t where decision = 'merge')"""


def _generated(t: Tables) -> tuple[DataFrame, DataFrame]:
    """part as a catalog (even keys) and a batch (odd keys); both have names by the score in common, and a link each or none."""
    own, key, size = text_of("p_partkey"), F.col("p_partkey"), F.col("p_size")
    given = F.when(key % 3 == 0, "").when(key % 3 == 1, own).otherwise(text_of(key - key % 10))
    link = lambda a, b: F.struct(a.alias("from_logic_id"), b.alias("from_output"), F.lit("in").alias("to_input"), F.lit("S").alias("kind"), F.lit(None).cast("string").alias("link_explanation"))
    rec = t.part.select(
        key.alias("position"), given.alias("given"), own.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), (size % 3).alias("dmn"), (size % 5).alias("purpose"), (size % 2 == 0).alias("archived"),
        F.array(link(text_of(2 * size), F.concat(F.lit("o"), text_of(size % 2)))).alias("links"), F.array(link(F.lit("2"), F.lit("o0"))).alias("own_links"),
    )
    old = rec.where("position % 2 = 0").withColumn("links", F.when(F.col("position") % 4 != 0, F.col("own_links")).otherwise(F.slice("own_links", 1, 0)))
    new = rec.where("position % 2 = 1").withColumn("new_id", F.concat(F.lit("new"), "id")).withColumn("id", F.col("given"))
    return old.drop("given", "own_links"), new.drop("given", "own_links")


@query(f"""with {_GENERATED} select d.row as position, case when d.decision = 'merge' and not coalesce(f.fresh, false) then 'duplicate' else d.decision end as decision, d.target_id, case when d.twin < d.row then d.twin end as target_position from d left join f on f.row = d.row""")
def generated_merge(t: Tables) -> DataFrame:
    return generated.merge_generated(*_generated(t), ["name", "kind", "dmn", "purpose"], ["dmn"])[0]


@query(f"""with {_GENERATED}, l as (select target_id, arg_max(row, row) as row from t where decision = 'replace' group by 1), k as (select target_id, epoch, count(*) as n from f where fresh group by 1, 2)
  select e.id, coalesce(i.dmn, e.dmn) as dmn, coalesce(i.purpose, e.purpose) as purpose, coalesce(k.n, 0) + case when l.row is not null then 1 when e.link is not null then 1 else 0 end as n_links
  from e left join l on l.target_id = e.id left join i on i.row = l.row left join k on k.target_id = e.id and k.epoch = coalesce(l.row, -1)
  union all select case when i.id = '' then 'new' || i.row else i.id end, i.dmn, i.purpose, 1 from d join i using (row) where decision = 'append'""")
def generated_catalog(t: Tables) -> DataFrame:
    """The catalog after the batch of generated_merge: versions, and how many links they have."""
    after = generated.merge_generated(*_generated(t), ["name", "kind", "dmn", "purpose"], ["dmn"])[1]
    return after.select("id", "dmn", "purpose", F.size("links").cast("long").alias("n_links"))


_MODEL_GENERATED = """e as (select p_partkey as row, cast(p_partkey as varchar) as id, p_name as name, p_brand as kind, p_size % 2 = 0 as archived, case when p_partkey % 4 <> 0 then '2|o0' end as link from part where p_partkey % 2 = 0),
  i as (select p_partkey as row, case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then cast(p_partkey - 1 as varchar) else 'x' || p_partkey end as id, p_name as name, p_brand as kind, cast(2 * p_size as varchar) || '|o' || (p_size % 2) as link from part where p_partkey % 2 = 1),
  c as (select row, name, row_number() over (partition by lower(name) order by row) + case when lower(name) in (select lower(name) from e) then 1 else 0 end as n from i where id = ''),
  o as (select i.*, coalesce(e.id, n.id) as target_id from i left join e on e.id = i.id left join (select name, kind, arg_max(id, row) as id from e group by 1, 2) n on n.name = i.name and n.kind = i.kind where i.id <> ''),
  f as (select *, target_id is not null and split_part(link, '|', 1) in (select id from e) and row_number() over (partition by target_id, link order by row) = 1 and (target_id, link) not in (select (id, link) from e where link is not null) as fresh from o)"""


def _model_generated(t: Tables) -> tuple[DataFrame, DataFrame]:
    old, new = _generated(t)
    key = F.col("position")
    given = F.when(key % 3 == 0, "").when(key % 3 == 1, text_of(key - 1)).otherwise(F.concat(F.lit("x"), text_of(key)))
    return old, new.withColumn("id", given)


@query(f"""with {_MODEL_GENERATED} select row as position, case when n = 1 then name else name || ' (' || n || ')' end as unique_name, 'create' as decision, 'new' || row as target_id, 0 as added from c
  union all select row, name, case when target_id is null then 'skip' when fresh then 'links' else 'unchanged' end, target_id, cast(fresh as integer) from f""")
def model_generated_merge(t: Tables) -> DataFrame:
    return generated.merge_model_generated(*_model_generated(t), ["name", "kind", "dmn", "purpose"])[0]


@query(f"""with {_MODEL_GENERATED}, k as (select target_id, count(*) as n from f where fresh group by 1)
  select e.id, e.name, e.archived and k.n is null as archived, coalesce(k.n, 0) + cast(e.link is not null as integer) as n_links from e left join k on k.target_id = e.id
  union all select 'new' || row, case when n = 1 then name else name || ' (' || n || ')' end, false, 1 from c""")
def model_generated_catalog(t: Tables) -> DataFrame:
    """The catalog after the batch of model_generated_merge: new links come and wake archived records."""
    after = generated.merge_model_generated(*_model_generated(t), ["name", "kind", "dmn", "purpose"])[1]
    return after.select("id", "name", "archived", F.size("links").cast("long").alias("n_links"))


@query("""select p_brand as code_file, cast(min(p_partkey) as bigint) as first_position, array_to_string(list(p_name order by p_partkey), '|') as names from (
  select *, row_number() over (partition by p_brand, p_name order by (p_size % 2 = 0), p_partkey) as n from part) where n = 1 group by 1""")
def grouped_export(t: Tables) -> DataFrame:
    rec = t.part.select(F.col("p_brand").alias("code_file"), F.col("p_name").alias("name"), (F.col("p_size") % 2 == 0).alias("archived"), F.col("p_partkey").alias("position"))
    return report.grouped_export(rec).select("code_file", "first_position", F.array_join("names", "|").alias("names"))
