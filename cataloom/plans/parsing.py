"""Queries of the parsers: texts in the catalog's formats are made from the driver's tables, and SQL says what has to be read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions import text as T
from cataloom.operators import upsert
from cataloom.plans.registry import Tables, query, spread, text_of
from cataloom.sources import diagrams, jsonish, reports, runlogs


def said(*parts: Column | str) -> Column:
    """Columns and plain strings as one text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def by(value: Column, *choices: Column | str) -> Column:
    """The choice whose number the value has; the last for all others."""
    out = F
    for i, c in enumerate(choices[:-1]):
        out = out.when(value == i, F.lit(c) if isinstance(c, str) else c)
    last = choices[-1]
    return out.otherwise(F.lit(last) if isinstance(last, str) else last)


# ---- reports


def _report(t: Tables) -> DataFrame:
    """A report for each part, of one section."""
    key, brand, size = F.col("p_partkey"), F.col("p_brand"), F.col("p_size")
    name = said(F.col("p_name"), " ", key)
    text = said(
        "a preamble\n---\n",
        by(key % 4, said("### 1. **Rule Name:** ", name), said("## ", name), said("**Name:** ", name), said("#### Logic Name\nThe **Name:** ", name)), "\n",
        "**Kind:** ", by(size % 2, "Decision", "BKM"), "\n**Purpose:** on ", brand, "\n\n**Spec:** of ", F.col("p_type"), "\nand more\n",
        by(key % 3, said("**Code Block:** `code/", brand, "/", key, ".sql`", by(key % 2, " beside\n", said(" Lines ", key, "-", key + 2, "\n"))), said("**Code Block:**\nFile: src/", size, ".cob\n"), ""),
        by(size % 4, said("Lines: ", size, "–", size + 9, "\n"), said("Line: ", size, "\n"), said("Lines: ", size, " - ", size + 1, "\n"), ""),
        by(size % 3, said("Function: `fn_", size, "`\n"), ""),
        "```sql\nSELECT ", size, "\n  FROM t;\n```\n**Example:** say ", key, "\n",
        "**DMN:**\n```\nHit Policy: ", by(size % 2, "FIRST", "UNIQUE"), '\n\nInputs:\n- `a.', key, '` : ', F.col("p_type"), ' [Allowed Values: "x", \'', brand, "', z]\n- b : int\nOutputs:\n- valid : boolean\n\n",
        "| a | valid |\n|---|---|\n| ", size, " | yes |\n\ntext\n```\n",
        "**Links:**\n", by(size % 5, "none", said("Rule ", key - 1, ".out -> in.", size, " [kind=SUPPORTS]\nno link at all"), said("Rule ", key - 1, ".a -> b [kind=X]\nRule ", key + 1, ".c -> d [kind=Y]"), ""), "\n",
    )
    return spread(t.part, "p_partkey").select("p_partkey", text.alias("text"))


def _parsed(t: Tables) -> DataFrame:
    return reports.parse(reports.sections(_report(t)))


@query("""select p_partkey, 0 as position, p_name || ' ' || p_partkey as name, case when p_size % 2 = 0 then 'Decision' else 'BKM' end as kind,
    case p_partkey % 3 when 0 then 'code/' || p_brand || '/' || p_partkey || '.sql' when 1 then 'src/' || p_size || '.cob' else '' end as code_file,
    case when p_partkey % 6 = 3 then p_partkey || '..' || (p_partkey + 2) when p_size % 4 < 3 then p_size || '..' || (p_size + case p_size % 4 when 0 then 9 when 1 then 0 else 1 end) end as code_lines,
    case when p_size % 3 = 0 then 'fn_' || p_size else '' end as code_function from part""")
def report_code_fields(t: Tables) -> DataFrame:
    p = _parsed(t)
    lines = F.concat(F.col("code_lines")[0].cast("string"), F.lit(".."), F.col("code_lines")[1].cast("string"))
    return p.select("p_partkey", "position", "name", "kind", "code_file", lines.alias("code_lines"), "code_function")


@query("""select p_partkey, 'on ' || p_brand as purpose, 'of ' || p_type || chr(10) || 'and more' as spec, 'SELECT ' || p_size || chr(10) || '  FROM t;' as code_block, 'say ' || p_partkey as example from part""")
def report_text_fields(t: Tables) -> DataFrame:
    return _parsed(t).select("p_partkey", "purpose", F.regexp_replace("spec", r"(?s)\n(?:Line|File|Func|```).*", "").alias("spec"), "code_block", "example")


@query("""select p_partkey, case when p_size % 2 = 0 then 'FIRST' else 'UNIQUE' end as policy, 'a.' || p_partkey || ':' || p_type || '=x|' || p_brand || '|z;b:int' as inputs, 'valid:boolean' as outputs,
    '| a | valid |' || chr(10) || '|---|---|' || chr(10) || '| ' || p_size || ' | yes |' as dmn_table from part""")
def report_dmn_fields(t: Tables) -> DataFrame:
    one = lambda d: F.concat(d["name"], F.lit(":"), d["type"], F.coalesce(F.concat(F.lit("="), F.array_join(d["allowedValues"], "|")), F.lit("")))
    shown = lambda c: F.array_join(F.transform(c, one), ";")
    return _parsed(t).select("p_partkey", F.col("dmn_hit_policy").alias("policy"), shown("dmn_inputs").alias("inputs"), shown("dmn_outputs").alias("outputs"), "dmn_table")


@query("""select p_partkey, n, from_logic, from_output, to_input, kind, raw from (
  select p_partkey, 0 as n, 'Rule ' || (p_partkey - 1) as from_logic, 'out' as from_output, 'in.' || p_size as to_input, 'SUPPORTS' as kind, null as raw from part where p_size % 5 = 1
  union all select p_partkey, 1, null, null, null, null, 'no link at all' from part where p_size % 5 = 1
  union all select p_partkey, 0, 'Rule ' || (p_partkey - 1), 'a', 'b', 'X', null from part where p_size % 5 = 2
  union all select p_partkey, 1, 'Rule ' || (p_partkey + 1), 'c', 'd', 'Y', null from part where p_size % 5 = 2)""")
def report_links(t: Tables) -> DataFrame:
    return _parsed(t).select("p_partkey", reports.exploded_links("parsed_links")).where("n is not null").select("p_partkey", "n", "l.*")


@query("""select p_partkey as owner, cast(p_partkey - 1 as varchar) as from_logic_id, case p_size % 5 when 1 then 'out' else 'a' end as from_output from part
  where p_size % 5 in (1, 2) and p_partkey - 1 >= 0""")
def report_links_resolved(t: Tables) -> DataFrame:
    """Links to later sections are dropped, those to earlier ones found: all sections stand in one report."""
    p = _parsed(t).withColumns({"id": text_of("p_partkey"), "name": said("Rule ", F.col("p_partkey")), "position": F.col("p_partkey").cast("int")})
    none = t.spark.createDataFrame([], "id string, name string")
    out = upsert.resolve_links(p.select("p_partkey", "id", "name", "position", "parsed_links"), none)
    link = out.select(F.col("p_partkey").alias("owner"), F.explode("links").alias("l")).where("l.raw is null")
    return link.select("owner", "l.from_logic_id", "l.from_output")


@query("select p_brand as document, p_name as name, count(*) as n from part group by 1, 2")
def names_in_documents(t: Tables) -> DataFrame:
    """Each name once in its document, at its first place; ``n`` counts its sections."""
    heads = t.part.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: F.concat(F.lit("## "), x["p_name"], F.lit("\nbody\n"))), "").alias("text"))
    docs = heads.select(F.col("p_brand").alias("document"), F.concat("text", F.lit("## Logic Name\n")).alias("text"))
    names = reports.names_in(docs, "document")
    every = reports.sections(docs).select("document", reports.heading(F.col("section")).alias("name"))
    return names.select("document", "name").join(every, ["document", "name"]).groupBy("document", "name").agg(F.count("*").alias("n"))


@query("""with r as (select *, row_number() over (partition by p_brand, p_name, p_size % 3 order by p_partkey) as k from part),
  a as (select *, row_number() over (partition by p_brand, p_name order by p_partkey) as n from r where k = 1)
  select p_partkey, case when n = 1 then p_name else p_name || ' (' || n || ')' end as name, true as accepted from a union all select p_partkey, p_name, false from r where k > 1""")
def repeats_in_documents(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_brand").alias("document"), F.col("p_name").alias("name"), said("f", F.col("p_size") % 3).alias("code_file"), F.col("p_partkey").alias("position"))
    accepted, rejected = upsert.reject_repeats(rows, "document")
    return accepted.select("p_partkey", "name", F.lit(True).alias("accepted")).union(rejected.select("p_partkey", "name", F.lit(False)))


@query("""with s as (select p_partkey, case when p_size % 8 = 0 then '' else p_name end as name, p_brand, 'f' || (p_size % 3) as file, p_size % 4 as stamp, p_size % 2 as m from part where p_partkey % 2 = 0),
  e as (select p_name as name, max(p_size % 4) as stamp, arg_max(p_size % 2, p_size % 4) as m from part where p_partkey % 2 = 1 and p_size % 4 <> 3 group by 1),
  o as (select distinct p_name as name from part where p_partkey % 7 <> 0 and length(p_name) < 10),
  f as (select s.*, e.name is not null as there, e.stamp as es, e.m as em, o.name is not null as ok, min(p_partkey) over (partition by p_brand, s.name, file) as first from s left join e on e.name = s.name left join o on o.name = s.name)
  select p_partkey, case when name = '' then 'parse_error' when not ok then 'name_not_allowed' when p_partkey > first then 'duplicate_same_codefile' when es = stamp then 'dedupe_key_seen' when es >= stamp and em = m then 'existing_duplicate_or_older_nochange' end as reason from f""")
def skip_reasons(t: Tables) -> DataFrame:
    size = F.col("p_size")
    columns = [F.col("p_brand").alias("document"), F.when(size % 8 == 0, "").otherwise(F.col("p_name")).alias("name"), said("f", size % 3).alias("code_file"), F.col("p_partkey").alias("position"), (size % 4).alias("timestamp"), (size % 2).alias("m")]
    new = t.part.where("p_partkey % 2 = 0").select(*columns)
    old = t.part.where("p_partkey % 2 = 1 and p_size % 4 <> 3").groupBy(F.col("p_name").alias("name")).agg(F.max(size % 4).alias("timestamp"), F.max_by(size % 2, size % 4).alias("m"))
    allowed = t.part.where("p_partkey % 7 <> 0 and length(p_name) < 10").select(F.col("p_name").alias("name"))
    found = upsert.skip_reasons(new, old, allowed, material=["m"])
    return found.select(F.col("position").alias("p_partkey"), "reason")


@query("""select p_partkey, 'BR-' || lpad(cast(p_partkey % 1000 as varchar), 3, '0') as rule_id, p_name as rule_name, p_type as rule_category, p_brand as business_area, 'Team ' || p_size as owner from part""")
def documented_rules(t: Tables) -> DataFrame:
    number = F.lpad(text_of(F.col("p_partkey") % 1000), 3, "0")
    text = said(
        "# Rules\n### 📘 Rule ID: BR-", number, " – ", F.col("p_name"), " \n- **Category**: ", F.col("p_type"), "  \n- **Business Area**: ", F.col("p_brand"), "  \n- **Rule Name**: again  \n- **Text**: some\nlines\n- **Owner**: Team ", F.col("p_size"), "  \n\nend",
    )
    return reports.documented_rules(t.part.select("p_partkey", text.alias("text")), "p_partkey").drop("pos")


# ---- JSON


@query("""select event_id, cast(pos - 1 as integer) as pos, json_extract_string(v, '$.k') as k from (
  select event_id, unnest([props, '{"k": "' || event_type || '"}', props]) as v, unnest([1, 2, 3]) as pos from events where event_id % 4 <> 0)""")
def json_in_a_row(t: Tables) -> DataFrame:
    """Every fourth text breaks off and gives no values; its neighbours aren't touched by it."""
    text = said(F.col("props"), ' \n{"k": "', F.col("event_type"), '"}', F.when(F.col("event_id") % 4 == 0, '{"k": ').otherwise(""), F.col("props"))
    found = t.events.select("event_id", jsonish.split_values(text).alias("v"))
    return found.select("event_id", F.posexplode("v").alias("pos", "v")).select("event_id", "pos", F.get_json_object("v", "$.k").alias("k"))


@query("""select event_id, cast(case event_id % 7 when 4 then -1 when 0 then 2 when 5 then 2 when 6 then 0 else 1 end as integer) as n, case when event_id % 7 not in (4, 6) then json_extract_string(props, '$.k') end as k from events""")
def json_reports(t: Tables) -> DataFrame:
    p = F.col("props")
    deep = F.repeat(F.lit("["), F.lit(200_000))
    text = by(
        F.col("event_id") % 7, said('{"logics": [', p, ", ", p, "]}"), said("Here:\n```json\n", p, "\n```\nbye"), said("the list [", p, "] it is"), said("so ", p, " ends"),
        F.when(F.col("event_id") % 700 == 4, deep).otherwise("no JSON {here"), said('[1, ', p, ', "note", ', p, "]"), '{"logics": []}',
    )
    found = t.events.select("event_id", jsonish.records(text).alias("r"))
    return found.select("event_id", F.coalesce(F.array_size("r"), F.lit(-1)).alias("n"), F.get_json_object(F.get("r", F.lit(0)), "$.k").alias("k"))


_DEEP = {"rule_id": "logic_id", "rule_name": "name", "rule_ids": "logic_ids"}


@query("""select event_id, case event_id % 4 when 3 then null when 0 then '{"a":[{"b":{"c":[{"logic_id":' || event_id || ',"name":"' || event_type || '"}]}}],"logic_ids":[1]}' when 1 then '[{"logic_id":"kept","name":"x"}]' else '{"a":{"logic_id":' || event_id || '}}' end as text from events""")
def renamed_deep(t: Tables) -> DataFrame:
    """Old keys four levels down; a filled new key keeps its value; a second time changes nothing."""
    key = F.col("event_id")
    text = by(
        key % 4, said('{"rule_ids": [1], "a": [{"b": {"c": [{"rule_id": ', key, ', "name": "", "rule_name": "', F.col("event_type"), '", "gone": 1}]}}]}'),
        '[{"rule_id": 5, "logic_id": "kept", "rule_name": "x"}]', said('{"a": {"rule_id": ', key, ', "gone": {"rule_id": 1}}}'), "{no JSON",
    )
    once = jsonish.rename_deep(text, _DEEP, ("gone",))
    return t.events.select("event_id", once.alias("text")).select("event_id", jsonish.rename_deep(F.col("text"), _DEEP, ("gone",)).alias("text"))


# ---- run logs


def _logs(t: Tables) -> DataFrame:
    """A log of two records for each order; some are of old builds or of another prompt, some have no response."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def frame(n: int, response: Column) -> Column:
        head = [
            said("build=", F.lit(2510020935) - (key % 7 == 0).cast("int")), said("timestamp=", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), F.lit('mode="single"'), F.lit('root_dir="/r"'),
            said("source_path='code/", cust, "'"), said('output_path="docs/', cust, '"'), said("prompt_template=", by(key % 11, "other.templ", "business_rules_report.templ")), said('input_files=["', key, '.sql"]'),
            F.lit("total=2"), F.lit(f"index={n}"),
        ]
        lines = F.array_join(F.transform(F.array(F.lit(runlogs.HEADER_BEGIN.removeprefix(runlogs.MARK + " ")), *head, F.lit(runlogs.HEADER_END.removeprefix(runlogs.MARK + " "))), lambda x: F.concat(F.lit(runlogs.MARK + " "), x)), "\n")
        return F.concat(lines, F.lit("\n"), response)

    answer = said(runlogs.RESPONSE_BEGIN, "\n## Rule ", key, "\ntext = 1  \n", runlogs.RESPONSE_END, "\n")
    return spread(t.orders, "o_orderkey").select(said("/logs/", key, ".log").alias("path"), F.timestamp_seconds(key).alias("mtime"), F.concat(frame(1, F.when(key % 5 == 0, "").otherwise(answer)), frame(2, answer)).alias("text"))


@query("""select '/logs/' || o_orderkey || '.log' as log_file, n as index, cast(2 as integer) as total, cast(2510020935 as bigint) as build, 'single' as mode, 'code/' || o_custkey as source_path, 'docs/' || o_custkey as output_path,
    '["' || o_orderkey || '.sql"]' as input_files, case when n = 1 and o_orderkey % 5 = 0 then '' else '## Rule ' || o_orderkey || chr(10) || 'text = 1' end as response_text
  from orders, (select unnest([1, 2]) as n) where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0""")
def log_runs(t: Tables) -> DataFrame:
    found = runlogs.runs(runlogs.frames(_logs(t)))
    return found.select("log_file", "index", "total", "build", "mode", "source_path", "output_path", "input_files", "response_text")


@query("""select '/r' as root_dir, cast(count(distinct o_custkey) as integer) as n, min('code/' || o_custkey) as first_path from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0""")
def log_source_paths(t: Tables) -> DataFrame:
    found = runlogs.source_paths(runlogs.runs(runlogs.frames(_logs(t))))
    return found.select("root_dir", F.size("source_paths").alias("n"), F.col("source_paths")[0].alias("first_path"))


def _activity_logs(t: Tables) -> DataFrame:
    key = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd_HH-mm-ss")
    path = by(key % 3, said("/l/log_", stamp, ".txt"), said("/l/log-", stamp, "-build-", key, ".txt"), said("/l/other", key, ".txt"))
    asks = by(key % 4, "Please generate a sequence diagram", "Render it in PlantUML, the\ndomain model", "by finding business rules in code", "anything else")
    text = said(
        F.when(key % 3 == 2, said("timestamp=", stamp, "\n")).otherwise(""), "INSTRUCTIONS\n\n", asks, "\n\nHints\nFile: /source_path/b", F.col("user_id"), ".sql\nFile: a.sql\nFile: a.sql\n",
        "||| Tokens Used: 5 = Prompt Tokens: 4 + Generated Tokens: 1\nmore\n||| Tokens Used: 1,", F.lpad(text_of(key % 1000), 3, "0"), " = Prompt Tokens: 1,000 + Generated Tokens: ", key % 1000, "\nend",
    )
    return spread(t.events, "event_id").select("event_id", path.alias("path"), text.alias("text"))


@query("""select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp, case event_id % 4 when 0 then 'Analyze - Sequence Diagram' when 1 then 'Visualize - Domain Model' when 2 then 'Analyze - Business Rules' else 'Other' end as activity,
    '5' as tokens_used, 'a.sql,b' || user_id || '.sql' as files from events""")
def log_activities(t: Tables) -> DataFrame:
    logs = _activity_logs(t)
    found = runlogs.activity_facts(logs, ["event_id"])
    return found.select("event_id", "timestamp", "activity", "tokens_used", F.array_join("files", ",").alias("files"))


@query("""select event_id, case when event_id % 3 < 2 then strftime(ts, '%Y-%m-%d') end as day, case when event_id % 3 < 2 then cast(hour(ts) as varchar) end as hour, cast(1000 as bigint) as prompt_tokens, cast(event_id % 1000 as bigint) as completion_tokens from events""")
def log_tokens(t: Tables) -> DataFrame:
    logs = _activity_logs(t)
    found = runlogs.token_counts(logs, ["event_id"])
    return found.select("event_id", "day", text_of("hour").alias("hour"), "prompt_tokens", "completion_tokens")


# ---- diagrams


def _sequences(t: Tables) -> DataFrame:
    """A diagram for each conversation, a line for each turn; every fifth line is none of a message."""
    turn = F.col("turn")
    line = F.when(turn % 5 == 4, said("note left : ", turn)).otherwise(said(F.col("role"), by(turn % 3, " -> ", "-->", " => "), "Svc.", turn % 4, ": fn", turn, "(x, y)", F.when(turn % 2 == 0, " - does - it").otherwise("")))
    return t.conversations.select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query("""select conv_id, cast(row_number() over (partition by conv_id order by turn) as integer) as step, role as from_participant, 'Svc.' || (turn % 4) as to_participant, 'fn' || turn || '(x, y)' as function_name,
    case when turn % 2 = 0 then 'does - it' else '' end as description from conversations where turn % 5 <> 4""")
def sequence_messages(t: Tables) -> DataFrame:
    return diagrams.messages(_sequences(t), "conv_id").drop("raw_text")


def _domains(t: Tables) -> DataFrame:
    """A domain diagram for each region: nations as classes and enums, notes with logics, and relations to the region's first nation."""
    name, key = F.col("n_name"), F.col("n_nationkey")
    kind = by(key % 3, said('class "', name, '" <<DomainType>> {\n  +a', key, " : int\n  ' no attribute\n  note none\n  b\n}\nclass Other {\n +x\n}\n"), said("enum ", name, " {\n  low\n  note it\n}\n"), said('class "', name, '" <<DomainType>> {\n}\n'))
    note = by(key % 2, said('note top of "', name, '" : Logics: A', key, " · Logic ", key, "\n"), said("note right of ", name, "\n Logics:\n - B", key, " · Logic ", key, "\nend note\n"))
    relation = said('"', name, '" "1" -- "many" "', F.first("n_name").over(_in_region()), '" : near\n')
    lines = t.nation.select("n_regionkey", "n_nationkey", F.concat(kind, note, relation).alias("line"))
    return lines.groupBy(F.col("n_regionkey").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "").alias("text"))


def _in_region():
    from pyspark.sql import Window

    return Window.partitionBy("n_regionkey").orderBy("n_nationkey")


@query("select n_regionkey as path, n_name as name, case when n_nationkey % 3 = 1 then 'enum' else 'class' end as kind from nation")
def domain_types(t: Tables) -> DataFrame:
    return diagrams.domain_types(_domains(t), "path")


@query("""select n_regionkey as path, n_name as type, case n_nationkey % 3 when 0 then 'class' else 'enum' end as kind, m as member from nation, (select unnest([0, 1]) as i),
  lateral (select case n_nationkey % 3 when 0 then case i when 0 then 'a' || n_nationkey || ' : int' else 'b' end else case i when 0 then 'low' else 'note it' end end as m) where n_nationkey % 3 < 2""")
def domain_members(t: Tables) -> DataFrame:
    return diagrams.domain_members(_domains(t), "path").select("path", "type", "kind", "member")


@query("select n_regionkey as path, n_name as entity, case when n_nationkey % 2 = 0 then 'A' else 'B' end || n_nationkey as code, 'Logic ' || n_nationkey as name from nation")
def domain_notes(t: Tables) -> DataFrame:
    return diagrams.noted_logics(_domains(t), "path")


@query("""select n_regionkey as path, n_name as "left", first_value(n_name) over (partition by n_regionkey order by n_nationkey) as "right", 'near' as label from nation""")
def domain_relations(t: Tables) -> DataFrame:
    return diagrams.relations(_domains(t), "path")


def _described(t: Tables) -> DataFrame:
    """A description of each region: attributes up to an empty line, relationships and logics, each with its title bold or plain, and an enumeration."""
    plain = F.col("n_regionkey") % 2 == 0
    items = lambda body: F.array_join(F.array_sort(F.collect_list(body)), "")
    own = t.nation.groupBy("n_regionkey").agg(items(said("- ", F.col("n_name"), ": of ", F.col("n_nationkey"), "\n")).alias("items"), items(said("- near ", F.col("n_name"), "\n")).alias("near"), items(said("- L", F.col("n_nationkey"), ": a logic\n")).alias("used"))
    own = own.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    title = lambda name: F.when(plain, f"{name}:\n").otherwise(f"**{name}:**\n")
    text = said(
        "# Domain\n- x: not listed\n", F.when(plain, said("### ", F.col("r_name"))).otherwise(said("### **", F.col("r_name"), "**")), "\nAll of  \n\n ", F.col("r_name"), ".\n(note aside)\nnot said\n",
        title("Attributes"), F.col("items"), F.when(plain, "\n- y: not listed\n").otherwise(""), title("Relationships"), F.col("near"), title("Logics"), F.col("used"), "## Enumerations\n### Level\nhow high\n", title("Attributes"), "- low\n- high: a lot: much\n",
    )
    return own.select(F.col("r_regionkey").alias("path"), text.alias("text"))


@query("""select r_regionkey as path, r_name as entity, n_name as attribute, 'of ' || n_nationkey as description from nation join region on r_regionkey = n_regionkey
  union all select r_regionkey, 'Level', a, d from region, (select unnest(['low', 'high']) as a, unnest(['', 'a lot: much']) as d)""")
def domain_attributes(t: Tables) -> DataFrame:
    return diagrams.entity_attributes(_described(t), "path")


@query("""select r_regionkey as path, r_name as entity, 'class' as kind, 'All of ' || r_name || '.' as description, count(*) as n_attributes, max('of ' || n_nationkey) as last_attribute from nation join region on r_regionkey = n_regionkey group by all
  union all select r_regionkey, 'Level', 'enum', 'how high', 2, 'a lot: much' from region""")
def domain_descriptions(t: Tables) -> DataFrame:
    found = diagrams.entity_descriptions(_described(t), "path")
    return found.select("path", "entity", "kind", "description", F.size("attributes").cast("long").alias("n_attributes"), F.array_max(F.map_values("attributes")).alias("last_attribute"))


@query("""select r_regionkey as path, r_name as entity, 'relationships' as part, 'near ' || n_name as text from nation join region on r_regionkey = n_regionkey
  union all select r_regionkey, r_name, 'logics', 'L' || n_nationkey || ': a logic' from nation join region on r_regionkey = n_regionkey""")
def domain_parts(t: Tables) -> DataFrame:
    return diagrams.entity_parts(_described(t), "path").where("part in ('relationships', 'logics')").select("path", "entity", "part", "text")


@query("""select p_partkey, 'note right of X' || chr(10) || '- ' || upper(right(md5(p_name), 3)) || ' · ' || p_name || chr(10) || '- unknown' || chr(10) || 'end note' || chr(10) || '- ' || p_name as text from part""")
def annotated_notes(t: Tables) -> DataFrame:
    text = said("note right of X\n- ", F.when(F.col("p_size") % 2 == 0, "0F0 · ").otherwise(""), F.col("p_name"), "\n- unknown\nend note\n- ", F.col("p_name"))
    codes = t.part.select(F.col("p_name").alias("name"), T.short_code(F.md5("p_name")).alias("code")).distinct()
    return diagrams.annotate_notes(t.part.select("p_partkey", text.alias("text")), "p_partkey", codes)


@query("""select p_partkey, '(note right of X' || chr(10) || p_name || ',' || chr(10) || '  "Logics:' || chr(10) || '  ' || upper(right(md5(p_name), 3)) || '· ' || p_name || chr(10) || '  ' || upper(right(md5(p_name), 3)) || '· ' || p_name || ',' || chr(10)
    || '  ' || upper(right(md5(p_name), 3)) || '· ' || p_name || '.' || chr(10) || 'unknown one' || chr(10) || '")' || chr(10) || p_name as text from part""")
def annotated_text_notes(t: Tables) -> DataFrame:
    """Notes in round brackets: names in quotes, with a comma, with a full stop, unknown ones, and names outside the list."""
    n = F.col("p_name")
    text = said("(note right of X\n", n, ',\n  "Logics:\n  "', n, '"\n  ', n, ',\n  ', n, '.\n"unknown one\n")\n', n)
    codes = t.part.select(n.alias("name"), T.short_code(F.md5("p_name")).alias("code")).distinct()
    return diagrams.annotate_text_notes(t.part.select("p_partkey", text.alias("text")), "p_partkey", codes)


# ---- text functions


@query("""select p_partkey, replace(p_name, ' ', '') as compact, case when p_size % 2 = 0 then 'sql' else '' end as language, case when p_size % 3 = 0 then '—' else replace(p_name, ' ', '\\|') || '\\`' end as cell,
    lower(replace(p_name, ' ', '--')) as anchor, case when p_size % 3 = 0 then '—' when p_size % 3 = 1 then 'Line ' || p_size else 'Lines ' || p_size || '–' || (p_size + 5) end as lines, 'x' || p_brand as file from part""")
def text_functions(t: Tables) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    code = by(size % 2, said("select ", name), said("move ", size))
    cell = F.when(size % 3 != 0, said(F.replace(name, F.lit(" "), F.lit("|")), "`"))
    lines = by(size % 3, F.lit(None).cast("array<int>"), F.array(size), F.array(size + 5, size))
    return t.part.select(
        "p_partkey", T.compact_name(said(" ", name, "\t")).alias("compact"), T.fence_language(code).alias("language"), T.escape_markdown(cell).alias("cell"),
        T.anchor(said("(", F.regexp_replace(name, " ", ": "), ")")).alias("anchor"), T.lines_label(lines).alias("lines"), T.without_file_label(said(" file: x", F.col("p_brand"))).alias("file"),
    )


@query("""select o_orderkey, cast(o_orderkey as bigint) * 4294967296 + o_custkey as plain, -1 - o_custkey as negative from orders""")
def split_integers(t: Tables) -> DataFrame:
    minus = T.int64(F.lit(4294967295) - F.col("o_custkey"), F.lit(-1))
    return t.orders.select("o_orderkey", T.int64(F.col("o_custkey"), F.col("o_orderkey")).alias("plain"), minus.alias("negative"))


@query("""select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, event_id % 4 < 3 as flag from events""")
def timestamps_and_flags(t: Tables) -> DataFrame:
    forms = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd_HH-mm-ss", "yyyyMMddHHmmss")
    stamp = by(F.col("event_id") % 4, *[F.date_format("ts", f) for f in forms])
    flag = by(F.col("event_id") % 4, "true", " YES ", "1", "no")
    return t.events.select("event_id", F.date_format(T.timestamp_of(stamp), "yyyy-MM-dd HH:mm:ss").alias("at"), T.as_flag(flag).alias("flag"))
