"""Counts, costs, coverage, file statistics, grouped exports and rendered reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions.text import anchor, blank, escape_markdown, lines_label
from cataloom.operators.keys import pick

# USD per 1,000 prompt and completion tokens, longer names first.
RATES = {"gpt-4.1": (0.01, 0.03), "gpt-4o": (0.005, 0.015), "gpt-4": (0.03, 0.06), "gpt-3.5": (0.001, 0.002)}
# Tokens in and out of each report at 1,872 source tokens, and the correction of the estimate.
REPORTS = (
    ("Analyze", 5287, 791), ("Component Model", 5961, 604), ("UX Model", 6053, 439), ("Domain Model", 6197, 773),
    ("Use Cases and Scenarios", 6719, 1731), ("Code Review", 5280, 1041), ("Business Rules", 5320, 1728),
)
REPORT_TOKENS, CORRECTION = 1872, 0.91566265
# Words that make a line of code count as complex.
COMPLEX_WORDS = ("IF", "DO", "SELECT", "WHEN", "ELSE", "FOR", "WHILE", "SUBR", "PROC", "CALLP")


def count_table(df: DataFrame, label: Column, default: str, to: str) -> DataFrame:
    """Counts by label, blank ones under a default; most frequent first, then by label."""
    return df.groupBy(F.when(blank(label), default).otherwise(label).alias(to)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), to)


def rate_key(model: Column) -> Column:
    low = F.trim(F.lower(model))
    out = F
    for name in RATES:
        out = out.when(low.startswith(name), name)
    return out.otherwise(low)


def cost(prompt: Column, completion: Column, model: Column) -> Column:
    """USD; null for a model without a rate."""
    key = rate_key(model)
    p, c = F, F
    for name, (per_prompt, per_completion) in RATES.items():
        p, c = p.when(key == name, per_prompt), c.when(key == name, per_completion)
    return prompt / 1000.0 * p.otherwise(None) + completion / 1000.0 * c.otherwise(None)


def cost_by_time(df: DataFrame, day: str = "day", hour: str = "hour", value: str = "cost") -> DataFrame:
    """Sums by (day, hour), by day, and in all, as one pass of grouping sets."""
    return df.groupingSets([[day, hour], [day], []], day, hour).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def llm_estimate(tokens: DataFrame, column: str, input_per_million: float = 2.5, output_per_million: float = 10.0) -> DataFrame:
    """(report, input_tokens, output_tokens, cost) for a total of source tokens."""
    rows = F.array(*[F.struct(F.lit(n).alias("report"), F.lit(float(i)).alias("i"), F.lit(float(o)).alias("o")) for n, i, o in REPORTS])
    scale = F.col(column) / REPORT_TOKENS / CORRECTION
    e = tokens.select(scale.alias("s"), F.explode(rows).alias("r")).select(F.col("r.report").alias("report"), (F.col("r.i") * F.col("s")).alias("input_tokens"), (F.col("r.o") * F.col("s")).alias("output_tokens"))
    return e.withColumn("cost", F.col("input_tokens") / 1e6 * input_per_million + F.col("output_tokens") / 1e6 * output_per_million)


def file_statistics(files: DataFrame, group: Column, text: Column, to: str = "extension", hours: float = 30.0) -> DataFrame:
    """Per group and in all (null): files, lines, complex lines, tokens, characters, ratio, effort = the groups' lines * ratio * hours / 100."""
    lines = F.filter(F.split(text, "(?<=\n)"), lambda x: x != "")
    complex_ = F.filter(lines, lambda x: _contains_any(x))
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    per_file = files.select(group.alias(to), F.size(lines).alias("l"), F.size(complex_).alias("c"), words.alias("t"), F.length(text).alias("k"))
    sums = [F.sum(x).cast("long") for x in "lctk"]
    out = per_file.rollup(to).agg(F.count("*").alias("files"), *[F.coalesce(s, F.lit(0)).alias(n) for s, n in zip(sums, ("lines", "complex_lines", "tokens", "chars"), strict=True)])
    ratio = F.when(F.col("lines") > 0, F.col("complex_lines") / F.col("lines")).otherwise(0.0)
    return out.withColumn("ratio", ratio).withColumn("effort", F.col("lines") * F.col("ratio") * hours / 100)


def _contains_any(x: Column) -> Column:
    out = x.contains(COMPLEX_WORDS[0])
    for w in COMPLEX_WORDS[1:]:
        out = out | x.contains(w)
    return out


def counts_by_folder(files: DataFrame, path: str) -> DataFrame:
    """(folder, extension, n): files below each folder, its descendants' included."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))
    extension = F.upper(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return files.select(F.explode(folders).alias("folder"), extension.alias("extension")).groupBy("folder", "extension").agg(F.count("*").alias("n"))


def coverage(seen: DataFrame, activity: str, file: str, all_files: DataFrame, all_file: str) -> DataFrame:
    """(activity, files, percent): distinct files of each activity, in percent of all distinct files."""
    total = all_files.agg(F.count_distinct(all_file).alias("__all"))
    per = seen.groupBy(activity).agg(F.count_distinct(file).alias("files"))
    percent = F.when(F.col("__all") > 0, 100.0 * F.col("files") / F.col("__all")).otherwise(0.0)
    return per.join(total, F.lit(True)).select(activity, "files", percent.alias("percent"))


def last_seen(seen: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    return seen.groupBy(*keys).agg(F.count("*").alias("n"), F.max(stamp).alias("last_seen"))


def grouped_export(logics: DataFrame, file: str = "code_file", name: str = "name", archived: str = "archived", position: str = "position") -> DataFrame:
    """(file, names): files in first-seen order, names once, from active records where there are any."""
    one = pick(logics, [file, name], [F.coalesce(F.col(archived), F.lit(False)), F.col(position)])
    order = F.transform(F.array_sort(F.collect_list(F.struct(position, name))), lambda x: x[name])
    return one.groupBy(file).agg(F.min(position).alias("first_position"), order.alias("names")).orderBy("first_position", file)


def excluded_by_category(logics: DataFrame, categories: DataFrame, excluded_groups: DataFrame) -> DataFrame:
    """(group, category, names) of logics whose category is in an excluded group."""
    gone = categories.join(excluded_groups.select(F.col("id").alias("groupId"), F.col("name").alias("group")), "groupId").select(F.col("name").alias("__c"), "group")
    return logics.join(gone, F.trim("category") == F.col("__c")).groupBy("group", F.col("__c").alias("category")).agg(F.array_sort(F.collect_set("name")).alias("names"))


def report_order(category: Column, name: Column, ranks: dict[str, int]) -> list[Column]:
    """Known categories by rank, others after them, none last; then by name, case aside."""
    rank = F
    for label, n in ranks.items():
        rank = rank.when(category == label, n)
    return [rank.when(blank(category), 999).otherwise(500), F.lower(name), name]


def markdown_sections(logics: DataFrame) -> DataFrame:
    """(id, toc, body): each logic's line of the table of contents and its section. Put together in report order by the writer."""
    field = lambda label, c: F.when(~blank(F.col(c)), F.concat(F.lit(f"**{label}:** "), escape_markdown(F.col(c)), F.lit("\n\n"))).otherwise("")
    code = F.when(~blank(F.col("code_file")), F.concat(F.lit("**Code:** `"), F.col("code_file"), F.lit("`"), F.when(F.size("code_lines") > 0, F.concat(F.lit(" ("), lines_label(F.col("code_lines")), F.lit(")"))).otherwise(""), F.lit("\n\n"))).otherwise("")
    body = F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"), field("Purpose", "purpose"), field("Spec", "spec"), code, field("Example", "example"))
    toc = F.concat(F.lit("- ["), F.col("name"), F.lit("](#"), anchor(F.col("name")), F.lit(")"))
    return logics.select("id", "name", "category", toc.alias("toc"), body.alias("body"))


def document(logics: DataFrame, order: Sequence[Column], title: str) -> DataFrame:
    """(line_no, text): a whole report, table of contents first; written as text in the order of ``line_no``.

    Sections are numbered over ranges of rows, and none of the text passes through one task.
    """
    from cataloom.operators.keys import numbered

    keys = {f"__o{i}": c for i, c in enumerate(order)}
    rows = logics.withColumns(keys).withColumn("__all", F.lit(0))
    placed = numbered(rows, ["__all"], [*keys], "__at").drop("__all", *keys)
    said = markdown_sections(placed).join(placed.select("id", "__at"), "id")
    head = logics.sparkSession.createDataFrame([(0, 0, f"# {title}")], "part int, __at long, text string")
    parts = head.unionByName(said.select(F.lit(1).alias("part"), "__at", F.col("toc").alias("text"))).unionByName(said.select(F.lit(2).alias("part"), "__at", F.col("body").alias("text")))
    return numbered(parts.withColumn("__all", F.lit(0)), ["__all"], ["part", "__at"], "line_no").select(F.col("line_no").cast("int").alias("line_no"), "text")


def export_text(grouped: DataFrame, form: str = "plain", file: str = "code_file") -> DataFrame:
    """(first_position, text): each file of a grouped export as plain lines, markdown or a JSON object."""
    names = F.col("names")
    if form == "json":
        text = F.to_json(F.struct(F.col(file).alias("file"), names.alias("logics")))
    elif form == "md":
        text = F.concat(F.lit("## "), file, F.lit("\n\n"), F.array_join(F.transform(names, lambda n: F.concat(F.lit("- "), n)), "\n"), F.lit("\n"))
    else:
        text = F.concat(file, F.lit("\n"), F.array_join(F.transform(names, lambda n: F.concat(F.lit("  "), n)), "\n"), F.lit("\n"))
    return grouped.select("first_position", text.alias("text"))


def audit_rows(tested: DataFrame, kind: str, path: str, source: str, tests: dict[str, Column], reasons: dict[str, str]) -> DataFrame:
    """(kind, path, source, decision, reason, tests) of candidates: kept if all tests hold, else rejected for the first that fails."""
    results = F.create_map(*[x for name, c in tests.items() for x in (F.lit(name), F.coalesce(c, F.lit(False)))])
    first = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), reasons[name]) for name, c in tests.items()])
    decided = tested.select(F.lit(kind).alias("kind"), F.col(path).alias("path"), F.col(source).alias("source"), first.alias("reason"), results.alias("tests"))
    return decided.select("kind", "path", "source", F.when(F.col("reason").isNull(), "kept").otherwise("rejected").alias("decision"), "reason", "tests")
