"""PlantUML domain and sequence diagrams and entity descriptions, as tables of lines tagged by the block they stand in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.text import once, stripped


def lines(documents: DataFrame, document: str, text: str = "text") -> DataFrame:
    """(document, n, line) of every line."""
    return documents.select(document, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("n", "line"))


def islands(rows: DataFrame, keys: list[str], order: str, starts: Column, to: str = "island") -> DataFrame:
    """Numbers runs of rows: a run begins where ``starts`` holds; rows before the first run are in run 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.sum(F.when(starts, 1).otherwise(0)).over(w))


# Fixed value: a message of a sequence diagram.
MESSAGE = r"(?U)^\s*([\w.]+)\s*[-=]+>\s*([\w.]+)\s*:\s*(.+\S)\s*$"


def messages(documents: DataFrame, document: str, text: str = "text") -> DataFrame:
    """(document, step, from_participant, to_participant, function_name, description, raw_text) of ``A -> B : fn(x) - text`` lines.

    Steps count those lines. A function keeps its parameters; the description is what follows the first dash between blanks.
    """
    found = lines(documents, document, text).where(F.col("line").rlike(MESSAGE))
    said = stripped(F.regexp_extract("line", MESSAGE, 3))
    step = F.row_number().over(Window.partitionBy(document).orderBy("n"))
    parts = F.split(said, " - ", 2)
    return found.select(
        document, step.alias("step"), F.regexp_extract("line", MESSAGE, 1).alias("from_participant"), F.regexp_extract("line", MESSAGE, 2).alias("to_participant"),
        stripped(parts[0]).alias("function_name"), stripped(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("description"), said.alias("raw_text"),
    )


# Fixed value: the first line of a type's block in a domain diagram; classes that are no domain types don't count.
TYPE = r'^\s*(?:(class)\s+(?:"([^"]+)"|(\w+))\s*<<DomainType>>|(enum)\s+(?:"([^"]+)"|(\w+)))\s*\{'


def _in_types(documents: DataFrame, document: str, text: str) -> DataFrame:
    """Lines with the type that they stand in (__name, __kind), from its first line (__first) up to the one with the closing brace."""
    line = F.col("line")
    parts = [F.regexp_extract("line", TYPE, i) for i in range(1, 7)]
    upto = Window.partitionBy(document).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(documents, document, text)
    # a block opens where none is open: of two first lines without a brace between them the second is a line of the first one's block
    mark = F.when(line.rlike(TYPE), "opens").when(line.contains("}"), "closes")
    marked = rows.withColumn("__mark", mark)
    before = F.last("__mark", True).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    first = (F.col("__mark") == "opens") & (F.coalesce(before, F.lit("closes")) == "closes")
    tagged = marked.withColumn("__first", F.coalesce(first, F.lit(False)))
    tagged = tagged.withColumn("__block", F.sum(F.col("__first").cast("int")).over(upto))
    w = Window.partitionBy(document, "__block").orderBy("n")
    closed = F.max(F.coalesce((F.col("__mark") == "closes") & ~F.col("__first"), F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    name = F.first(F.when(F.col("__first"), stripped(F.concat(parts[1], parts[2], parts[4], parts[5]))), True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kind = F.first(F.when(F.col("__first"), F.when(parts[0] != "", "class").otherwise("enum")), True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return tagged.withColumns({"__closed": closed, "__name": name, "__kind": kind}).where("__block > 0 and not __closed")


def domain_types(documents: DataFrame, document: str, text: str = "text") -> DataFrame:
    """(document, name, kind) of the domain types: classes marked as such, and enums."""
    return _in_types(documents, document, text).where("__first").select(document, F.col("__name").alias("name"), F.col("__kind").alias("kind")).distinct()


def domain_members(documents: DataFrame, document: str, text: str = "text") -> DataFrame:
    """(document, type, kind, n, member): the attributes of classes, without their plus signs, and the values of enums; comments and notes don't count."""
    line = stripped(F.col("line"))
    kept = (line != "") & ~line.startswith("'") & ~((F.col("__kind") == "class") & line.startswith("note "))
    member = F.when(F.col("__kind") == "class", F.regexp_replace(line, r"^\++", "")).otherwise(line)
    return _in_types(documents, document, text).where(~F.col("__first")).where(kept).select(document, F.col("__name").alias("type"), F.col("__kind").alias("kind"), "n", member.alias("member"))


def relations(documents: DataFrame, document: str, text: str = "text") -> DataFrame:
    """(document, left, right, label) of ``"A" "1" -- "many" "B" : has`` lines."""
    line = r'^\s*("[^"]+"|\w+)\s*(?:"[^"]*"\s*)?(?:[<|*o]*[-.]+[>|*o]*)\s*(?:"[^"]*"\s*(?="|\w))?("[^"]+"|\w+)\s*(?::\s*(.*?))?\s*$'
    bare = lambda c: F.regexp_replace(c, '"', "")
    return lines(documents, document, text).where(F.col("line").rlike(line) & F.col("line").rlike("[-.]{2}")).select(
        document, bare(F.regexp_extract("line", line, 1)).alias("left"), bare(F.regexp_extract("line", line, 2)).alias("right"), F.regexp_extract("line", line, 3).alias("label")
    )


def noted_logics(documents: DataFrame, document: str, text: str = "text") -> DataFrame:
    """(document, entity, code, name): entries ``2B0 · Name`` of notes headed ``Logics:``, on one line or up to ``end note``."""
    one = r'(?i)^\s*note\s+\w+\s+of\s+"?([^":]+?)"?\s*(?::\s*(.*))?$'
    tagged = islands(lines(documents, document, text), [document], "n", F.col("line").rlike(one))
    inside = tagged.where("island > 0").withColumn("entity", F.max(F.when(F.col("line").rlike(one), stripped(F.regexp_extract("line", one, 1)))).over(Window.partitionBy(document, "island")))
    ended = Window.partitionBy(document, "island").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    single = F.max(F.col("line").rlike(one) & (F.regexp_extract("line", one, 2) != "")).over(Window.partitionBy(document, "island"))
    over = F.max(F.col("line").rlike(r"(?i)^\s*end\s*note")).over(ended)
    body = inside.withColumns({"__over": over, "__single": single}).where(~F.col("__over") & (~F.col("__single") | F.col("line").rlike(one)))
    said = F.when(F.col("line").rlike(one), F.regexp_extract("line", one, 2)).otherwise(F.col("line"))
    entries = body.select(document, "entity", F.explode(F.split(F.regexp_replace(said, r"(?i)^\s*(?:Logics|Rules)\s*:\s*", ""), ",")).alias("entry"))
    entry = r'^\s*[-*•"]*\s*([^\s·•]+)\s*[·•]\s*(.+?)"?\s*$'
    return entries.where(F.col("entry").rlike(entry)).select(document, "entity", F.regexp_extract("entry", entry, 1).alias("code"), F.regexp_extract("entry", entry, 2).alias("name"))


#: Titles that begin a part of an entity's description, bold or plain.
_PARTS = ("attributes", "relationships", "logics")


def entity_parts(documents: DataFrame, document: str, text: str = "text") -> DataFrame:
    """(document, entity, kind, part, n, name, text) of domain descriptions: what stands below each ``### Entity``, bold or plain, by part.

    A description is the text up to a title or a line that begins ``(note``. ``Attributes:`` are bullets ``- name: text`` up to an empty line,
    ``Relationships:`` and ``Logics:`` bullets, each up to the next title or heading. ``kind`` is enum below ``## Enumerations``, class elsewhere.
    """
    line = F.col("line")
    head = r"^###\s+(?:\*\*)?(.*?)(?:\*\*)?\s*$"
    title = lambda name: line.rlike(rf"^\s*(?:\*\*)?{name.capitalize()}:(?:\*\*)?\s*$")
    begins = F.when(line.rlike(head), "description")
    for name in _PARTS:
        begins = begins.when(title(name), name)
    begins = begins.when(line.startswith("## "), "none")
    upto = Window.partitionBy(document).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(documents, document, text).withColumn("__begins", begins).withColumns(
        {
            "part": F.last("__begins", True).over(upto),
            "__run": F.count("__begins").over(upto),
            "entity": F.last(F.when(line.rlike(head), stripped(F.regexp_extract("line", head, 1))), True).over(upto),
            "kind": F.when(F.last(F.when(line.startswith("## "), line.rlike(r"^##\s+Enumerations\s*$")), True).over(upto), "enum").otherwise("class"),
        }
    )
    stops = F.when(F.col("part") == "description", F.lower(stripped(line)).startswith("(note")).when(F.col("part") == "attributes", stripped(line) == "")
    stopped = F.max(F.coalesce(stops, F.lit(False))).over(Window.partitionBy(document, "__run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    inside = rows.withColumn("__stopped", stopped).where("__begins is null and not __stopped and entity is not null and part <> 'none'")
    said = stripped(F.regexp_replace(stripped(line), r"^- ", ""))
    bullet = stripped(line).startswith("- ")
    colon = F.instr(said, ":")
    pair = (F.col("part") == "attributes") & (colon > 0)
    name = F.when(F.col("part") != "attributes", F.lit("")).when(pair, stripped(F.substr(said, F.lit(1), colon - 1))).otherwise(said)
    body = F.when(F.col("part") == "description", stripped(line)).when(pair, stripped(F.substr(said, colon + 1))).when(F.col("part") == "attributes", "").otherwise(said)
    kept = inside.where(F.when(F.col("part") == "description", stripped(line) != "").otherwise(bullet))
    return kept.select(document, "entity", "kind", "part", "n", name.alias("name"), body.alias("text"))


def entity_descriptions(documents: DataFrame, document: str, text: str = "text") -> DataFrame:
    """(document, entity, kind, description, attributes) of each described entity; attributes map names to texts, the last of a name winning."""
    parts = entity_parts(documents, document, text)
    said = F.when(F.col("part") == "description", F.struct("n", "text"))
    item = F.when(F.col("part") == "attributes", F.struct("n", "name", "text"))
    own = parts.groupBy(document, "entity", "kind").agg(F.array_sort(F.collect_list(said)).alias("__d"), F.array_sort(F.collect_list(item)).alias("__a"))
    last = F.aggregate("__a", F.create_map().cast("map<string,string>"), lambda m, a: F.map_concat(F.map_filter(m, lambda k, v: k != a["name"]), F.create_map(a["name"], a["text"])))
    return own.select(document, "entity", "kind", F.array_join(F.transform("__d", lambda x: x["text"]), " ").alias("description"), last.alias("attributes"))


def entity_attributes(documents: DataFrame, document: str, text: str = "text") -> DataFrame:
    """(document, entity, attribute, description) of the attributes of each described entity."""
    return entity_parts(documents, document, text).where("part = 'attributes'").select(document, "entity", F.col("name").alias("attribute"), F.col("text").alias("description"))


def annotate_notes(documents: DataFrame, document: str, codes: DataFrame, text: str = "text") -> DataFrame:
    """The diagrams with each bulleted line of a note that names a known logic (``codes(name, code)``) led by its code."""
    w = Window.partitionBy(document).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    flag = F.when(F.col("line").rlike(r"(?i)^\s*note\s+\w+(\s+of)?\b[^:]*$"), 1).when(F.col("line").rlike(r"(?i)^\s*end\s*note"), 0)
    inside = lines(documents, document, text).withColumn("__in", F.coalesce(F.last(flag, ignorenulls=True).over(w), F.lit(0)) == 1)
    item = r"^(\s*[-*•]\s*)(?:[0-9A-F]{1,3}\s*·\s*)?(.+?)\s*$"
    known = codes.select(F.col("name").alias("__name"), F.col("code").alias("__code")).groupBy("__name").agg(F.min("__code").alias("__code"))
    key = F.when(F.col("__in") & F.col("line").rlike(item), F.regexp_extract("line", item, 2))
    joined = inside.withColumn("__key", key).join(known, F.col("__key") == F.col("__name"), "left")
    line = F.when(F.col("__code").isNotNull(), F.concat(F.regexp_extract("line", item, 1), "__code", F.lit(" · "), "__key")).otherwise(F.col("line"))
    return joined.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias(text))


def _note_states(text: str | None) -> list[str]:
    """Of each line: head (starts a note or its list), item (a line of the list), end, or plain; a list goes from ``Logics:`` to a closing bracket alone."""
    out, state = [], ""
    for line in (text or "").split("\n"):
        said = line.strip()
        if not state and said.startswith("(note"):
            state, kind = "note", "head"
        elif state == "note" and said.strip("\"'").lower().startswith("logics:"):
            state, kind = "list", "head"
        elif state == "list" and said in ('")', ")", "),"):
            state, kind = "", "end"
        else:
            kind = "item" if state == "list" else "plain"
        out.append(kind)
    return out


def annotate_text_notes(documents: DataFrame, document: str, codes: DataFrame, text: str = "text") -> DataFrame:
    """Markdown with the lines of its ``(note … Logics: … )`` blocks that name a known logic (``codes(name, code)``) led by its code.

    A name is looked up as it stands, then without its last full stop, then in small letters; quotes and closing brackets around it go, a comma stays.
    Lines of unknown names lose their leading quotes.
    """
    states = F.pandas_udf(lambda s: pd.Series([_note_states(x) for x in s], dtype=object), "array<string>")
    pairs = F.arrays_zip(F.split(F.coalesce(text, F.lit("")), "\n").alias("line"), states(F.coalesce(text, F.lit(""))).alias("state"))
    rows = documents.select(document, F.posexplode(pairs).alias("n", "p")).select(document, "n", "p.line", "p.state")
    said = F.regexp_replace(F.regexp_replace(stripped(F.col("line")), "^[\"']+|[\"']+$", ""), r"[,\s]+$", "")
    name = F.when(said.endswith(")"), F.regexp_replace(said, r"[)\"]+$", "")).otherwise(said)
    keys = once(name, lambda x: F.when((F.col("state") == "item") & (x != ""), F.array(x, F.regexp_replace(x, r"\.$", ""), F.lower(x))))
    # each line goes with its keys to the known names, and its ways come together again: no table of lines is joined with another one
    asked = rows.select("*", F.posexplode_outer(keys).alias("k", "key"))
    known = codes.groupBy(F.col("name").alias("key")).agg(F.min("code").alias("code"))
    hit = F.min(F.when(F.col("code").isNotNull(), F.struct("k", "code")))["code"]
    joined = asked.join(known, "key", "left").groupBy(document, "n", "line", "state").agg(hit.alias("code")).withColumn("name", name)
    lead = F.regexp_extract("line", r"^(\s*)", 1)
    line = F.when(F.col("code").isNotNull(), F.concat(lead, "code", F.lit("· "), "name", F.when(F.rtrim("line").endswith(","), ",").otherwise("")))
    line = F.coalesce(line, F.when(F.col("state") == "item", F.regexp_replace("line", '^"+', "")), F.col("line"))
    return joined.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias(text))
