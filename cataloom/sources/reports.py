"""Reports in markdown: sections and their fields, as columns.

A report is split where headings start; every field is a pattern over its section, so a report's sections are parsed side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.text import once, stripped

# Labels of headings, with or without a number and stars, and what stands for no name.
_LABELS = ("Rule Name", "Name")
_PLACEHOLDERS = ("logic name", "logic-name")
# The markers of a section's fields, as they stand at the start of a line, and the fields at which each field's text ends.
MARKERS = {
    "kind": ("Kind",), "purpose": ("Purpose", "Rule Purpose"), "spec": ("Spec", "Rule Spec", "Specification"), "code": ("Code Block",),
    "example": ("Example",), "dmn": ("DMN",), "links": ("Links",),
}
_ENDS = {"kind": tuple(MARKERS), "purpose": ("spec", "code", "example"), "spec": ("code", "example", "dmn"), "code": tuple(MARKERS), "example": ("dmn",), "dmn": (), "links": ()}
# Labels of the lines that say where the code is.
_PLACES = {"file": r"File", "lines": r"Lines?", "function": r"Function"}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text and timestamp (modification time in UTC, whole seconds, as a string) of text files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    stamp = F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return files.select("path", F.decode("content", "UTF-8").alias("text"), stamp.alias("timestamp"))


def normalise(text: Column) -> Column:
    """All variants of name headings become ``## ``; separator lines go."""
    label = "(?:" + "|".join(rf"\*\*{x}:\*\*|{x}:" for x in _LABELS) + r")\s*"
    headed = F.regexp_replace(text, r"#{2,6}\s*(?:\d+\.\s*)?" + label, "## ")
    return F.regexp_replace(F.regexp_replace(headed, r"\n---+\n", "\n"), r"(?m)^\s*" + label, "## ")


def sections(documents: DataFrame, text: str = "text") -> DataFrame:
    """A row for each section, with its position; what stands before the first heading is dropped."""
    parts = F.split(stripped(normalise(F.coalesce(F.col(text), F.lit("")))), r"(?m)^\s{0,3}#{1,6}\s+")
    rest = once(parts, lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))
    return documents.select("*", F.posexplode(rest).alias("position", "section")).drop(text)


def _with(use: Callable[[Column, Column], Column], second: Column) -> Callable[[Column], Column]:
    """A function of one argument, as Spark would take a second one for the index."""
    return lambda first: use(first, second)


def heading(section: Column) -> Column:
    """A section's name: its first line without marks and labels, else a name field."""
    line = stripped(F.regexp_extract(section, r"^\s*([^\n]*)", 1))
    line = F.regexp_replace(F.regexp_replace(line, r"^\s*#{1,6}\s*", ""), r"\s*#{1,6}\s*$", "")
    line = F.regexp_replace(F.regexp_replace(line, r"^[ *\-\t]+|[ *\-\t]+$", ""), r"(?i)^(?:Rule\s+Name|Name):\s*", "")
    placeholder = lambda c: (c == "") | F.lower(c).isin(*_PLACEHOLDERS)
    field = lambda label: stripped(F.regexp_extract(section, rf"\*\*{label}:\*\*[ \t]*([^\n]+)", 1))
    name = line
    named = lambda n, own: F.when(placeholder(n), once(own, lambda f: F.when(f != "", f).otherwise(n))).otherwise(n)
    for own in map(field, _LABELS):
        name = once(name, _with(named, own))
    return name


def _pieces(section: Column) -> Column:
    """A section cut before each marker: an array of (field, head, text), the first piece without a field."""
    name = "|".join(x.replace(" ", r"\s+") for names in MARKERS.values() for x in sorted(names, key=len, reverse=True))
    head = rf"(?:\*\*)?[ \t]*(?:{name})[ \t]*:(?:\*\*)?"
    cut = F.split(section, rf"(?mi)^(?={head})")

    def field(own: Column) -> Column:
        word = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(own, r"[*:]", ""), r"^\s*(?:rule\s+)?|\s+$", "")), r"\s+", " ")
        return once(word, lambda w: F.coalesce(*[F.when(w.isin(*{n.lower().removeprefix("rule ") for n in names}), F.lit(f)) for f, names in MARKERS.items()]))

    one = lambda x: once(F.regexp_extract(x, rf"(?i)\A({head})", 1), lambda own: F.struct(field(own).alias("field"), own.alias("head"), F.substr(x, F.length(own) + 1).alias("text")))
    return F.transform(cut, one)


def _value(pieces: Column, field: str) -> Column:
    """The text after a field's first marker, up to a marker that ends it; other markers on the way belong to it."""
    first = F.array_position(F.transform(pieces, lambda p: F.coalesce(p["field"], F.lit(""))), field).cast("int")

    def upto(rest: Column) -> Column:
        if not _ENDS[field]:
            return rest
        ends = F.array_position(F.transform(rest, lambda p: F.coalesce(p["field"].isin(*_ENDS[field]), F.lit(False))), True).cast("int")
        return once(ends, lambda e: F.when(e > 0, F.slice(rest, 1, e - 1)).otherwise(rest))

    def said(start: Column) -> Column:
        more = once(F.slice(pieces, start + 1, F.size(pieces)), upto)
        return F.concat(F.get(pieces, start - 1)["text"], F.array_join(F.transform(more, lambda p: F.concat(p["head"], p["text"])), ""))

    return once(first, lambda start: F.when(start > 0, stripped(said(start))).otherwise(""))


def _place(section: Column, label: str) -> Column:
    """What a line says after its label, without ticks."""
    line = F.regexp_extract(section, rf"(?mi)^[ \t*-]*{_PLACES[label]}\b[ \t*]*[:\-–—]*[ \t*]*(\S[^\n]*)$", 1)
    return stripped(F.replace(line, F.lit("`"), F.lit("")))


def _fenced(text: Column) -> Column:
    """Inside of the first block between fences, without the line that opens it."""
    return once(F.split(text, "```"), lambda parts: F.when(F.size(parts) > 2, F.regexp_replace(parts[1], r"\A[^\n]*\n", "")).otherwise(""))


def declaration(line: Column) -> Column:
    """``Name : Type [Allowed Values: a, "b"]`` as a struct; a line without a colon is a name alone."""
    bare = lambda c: stripped(F.regexp_replace(stripped(c), "^`+|`+$", ""))
    said = stripped(F.regexp_replace(F.regexp_replace(stripped(line), '"$', ""), r"^[-*]+", ""))

    def of(name: Column, rest: Column, listed: Column) -> Column:
        kind = F.when(listed != "", F.substring_index(rest, "[", 1)).otherwise(rest)
        values = F.transform(F.split(listed, ","), lambda v: F.regexp_replace(stripped(v), "^([\"'])(.*)\\1$", "$2"))
        values = once(F.filter(values, lambda v: v != ""), lambda vs: F.when((stripped(kind) != "") & (F.size(vs) > 0), vs))
        return F.struct(bare(name).alias("name"), bare(kind).alias("type"), values.alias("allowedValues"))

    def cut(s: Column) -> Column:
        colon = F.instr(s, ":")
        name, rest = F.when(colon > 0, F.substr(s, F.lit(1), colon - 1)).otherwise(s), F.when(colon > 0, F.substr(s, colon + 1)).otherwise("")
        return once(rest, lambda r: once(F.regexp_extract(r, r"(?i)\[\s*Allowed\s*Values\s*:(.*)\]\s*$", 1), lambda listed: of(name, r, listed)))

    return once(said, cut)


def declarations(body: Column, title: str) -> Column:
    """The bulleted declarations below a title."""
    block = F.regexp_extract(body, rf"(?i){title}\s*:[ \t]*\n((?:\s*[-*][^\n]*(?:\n|$))+)", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), stripped), lambda x: x.rlike(r"^[-*]"))
    return F.transform(lines, declaration)


def first_table(body: Column) -> Column:
    """The first run of lines with ``|``, ``+`` or ``--``."""
    row = r"[^\n]*(?:\||\+|--)[^\n]*"
    return stripped(F.regexp_replace(F.regexp_extract(body, rf"(?:^|\n)({row}(?:\n{row})*)", 1), r"(?m)[ \t]+$", ""))


def link_lines(body: Column) -> Column:
    """Lines of a links field as structs: ``From.output -> input [kind=K]`` in parts, all others as they are in ``raw``; ``none`` alone is no link."""
    lines = F.filter(F.transform(F.split(body, "\n"), stripped), lambda x: x != "")

    def cut(ends: Column) -> Column:
        source, target = ends[0], F.get(ends, F.lit(1))
        kind = F.regexp_extract(target, r"(?i)\[kind=([^\]]+)\]$", 1)
        to = stripped(F.regexp_replace(target, r"\s*\[[^\]]*\]$", ""))
        return F.struct(source.alias("source"), F.instr(source, ".").alias("dot"), to.alias("to"), kind.alias("kind"))

    def one(x: Column, c: Column) -> Column:
        source, dot = c["source"], c["dot"]
        fits = F.coalesce((dot > 1) & (dot < F.length(source)) & (c["kind"] != "") & (c["to"] != ""), F.lit(False))
        parts = {"from_logic": F.substr(source, F.lit(1), dot - 1), "from_output": F.substr(source, dot + 1), "to_input": c["to"], "kind": c["kind"]}
        return once(fits, lambda ok: F.struct(*[F.when(ok, stripped(v)).alias(n) for n, v in parts.items()], F.when(~ok, x).alias("raw")))

    some = F.when(F.lower(body) == "none", F.array().cast("array<string>")).otherwise(lines)
    return F.transform(some, lambda x: once(once(F.split(x, r"\s*->\s*", 2), cut), lambda c: one(x, c)))


def exploded_links(parsed: Column | str) -> Column:
    """Generator of (n, l) of a list of links. An outer one: Spark gives an inner one a filter on the list's size, pushes that below the parsing and so
    copies the list's whole expression, once for every use of each of its parts. Rows with n null have no link."""
    return F.posexplode_outer(parsed).alias("n", "l")


def parse(parts: DataFrame) -> DataFrame:
    """Sections with their fields: name, kind, code, purpose, spec, example, DMN and links.

    A section is cut at its markers once; each field is read from its own text, and the code's place from the lines that say it.
    """
    section = F.col("section")
    # read inside a generator: filters on fields stay above it, and don't cut the section again
    values = once(_pieces(section), lambda p: F.struct(*[_value(p, f).alias(f"__{f}") for f in MARKERS]))
    texts = parts.select("*", F.inline(F.array(values)))
    # the file ends at its closing tick; lines may follow it, or stand anywhere else
    inline = stripped(F.regexp_extract(section, r"(?mi)^\*\*Code\s*Block:\*\*[ \t]*`?([^`\n]+)", 1))
    numbers = F.regexp_extract_all(F.regexp_extract(section, r"(?i)\bLines?\s*:{0,2}\s*(\d+(?:\s*[-–—]\s*\d+)?)", 1), F.lit(r"(\d+)"), 1)
    whole = once(_fenced(F.col("__dmn")), lambda f: F.when(f != "", stripped(f)).otherwise(F.col("__dmn")))
    out = texts.withColumns(
        {
            "name": heading(section),
            "kind": F.regexp_extract("__kind", "^[A-Za-z]+", 0),
            "code_file": once(inline, lambda f: F.when(f != "", f).otherwise(_place(section, "file"))),
            "code_lines": once(numbers, lambda n: F.when(F.size(n) > 0, F.array(F.element_at(n, 1).cast("int"), F.element_at(n, -1).cast("int")))),
            "code_function": _place(section, "function"),
            "purpose": F.col("__purpose"),
            "spec": F.col("__spec"),
            "code_block": stripped(_fenced(section)),
            "example": F.col("__example"),
            "parsed_links": link_lines(F.col("__links")),
            "__body": F.replace(F.replace(whole, F.lit("`"), F.lit("")), F.lit("**"), F.lit("")),
        }
    )
    body = F.col("__body")
    policy = F.regexp_extract(body, r"(?i)Hit\s*Policy\s*:\s*([A-Za-z_]+)", 1)
    dmn = {"dmn_hit_policy": policy, "dmn_inputs": declarations(body, "Inputs"), "dmn_outputs": declarations(body, "Outputs"), "dmn_table": first_table(body)}
    return out.withColumns(dmn).drop("__body", "section", *[f"__{f}" for f in MARKERS])


def names_in(documents: DataFrame, document: str, text: str = "text") -> DataFrame:
    """(document, name, position) of the distinct section names, at their first place."""
    named = sections(documents, text).select(document, "position", heading(F.col("section")).alias("name"))
    return named.where((F.col("name") != "") & ~F.lower("name").isin(*_PLACEHOLDERS)).groupBy(document, "name").agg(F.min("position").alias("position"))


# How a documented rule is laid out, and the columns of its groups (the fifth repeats the name).
DOCUMENTED_RULE = (
    r"(?s)### 📘 Rule ID: (BR-\d{3}) – (.*?)\n- \*\*Category\*\*: (.*?)  \n- \*\*Business Area\*\*: (.*?)  \n"
    r"- \*\*Rule Name\*\*: (.*?)  \n.*?- \*\*Owner\*\*: (.*?)  \n"
)
DOCUMENTED_COLUMNS = {"rule_id": 1, "rule_name": 2, "rule_category": 3, "business_area": 4, "owner": 6}


def documented_rules(documents: DataFrame, document: str, text: str = "text") -> DataFrame:
    """(document, pos, rule_id, rule_name, rule_category, business_area, owner) of every rule laid out as documented; null texts have none."""
    blocks = documents.select(document, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(DOCUMENTED_RULE), 0)).alias("pos", "__block"))
    return blocks.select(document, "pos", *[stripped(F.regexp_extract("__block", DOCUMENTED_RULE, i)).alias(c) for c, i in DOCUMENTED_COLUMNS.items()])
