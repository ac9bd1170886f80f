"""Run logs: framed records, activity facts and token counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cataloom.functions.text import BLANKS, once, stripped

# The frames of a run log, the oldest build whose records count, the report's prompt, and how much of a file shows what it is.
MARK = "[PCPTLOG:]"
HEADER_BEGIN, HEADER_END = f"{MARK} ===== HEADER BEGIN =====", f"{MARK} ===== HEADER END ====="
RESPONSE_BEGIN, RESPONSE_END = f"{MARK} ===== RESPONSE BEGIN =====", f"{MARK} ===== RESPONSE END ====="
LEAST_BUILD, PROMPT_PREFIX, SNIFFED = 2510020935, "business_rules_report", 8192
# What the instructions of an activity contain; the first that fits names it.
ACTIVITIES = (
    ("Analyze - Domain Model", (("generate a semantically descriptive domain model",),)),
    ("Analyze - Use Cases", (("generate a list of functional use cases",), ("generate use cases",), ("generate list of use cases",))),
    ("Analyze - Sequence Diagram", (("generate a sequence diagram",),)),
    ("Visualize - Domain Model", (("render it in plantuml", "domain"),)),
    ("Visualize - Use Case", (("render it in plantuml", "use case"),)),
    ("Visualize - Sequence Diagram", (("render it in plantuml", "sequence"),)),
    ("Transform - To DMN", (("transforming rules descriptions into formal dmn",),)),
    ("Generate - Code (Drools)", (("implementing drools rules",),)),
    ("Analyze - Business Rules", (("finding business rules in code",),)),
)


def read_logs(spark: SparkSession, path: str | Sequence[str], glob: str = "*.{log,txt,out,md}") -> DataFrame:
    """path, mtime and text of files under one or more folders that look like run logs by their first characters; each once, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load([path] if isinstance(path, str) else list(path))
    texts = files.select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text")).dropDuplicates(["path"])
    head = F.substring("text", 1, SNIFFED)
    return texts.where(head.contains(MARK) & head.contains("HEADER")).orderBy(F.desc("mtime"), "path")


def read_frames(spark: SparkSession, path: str | Sequence[str], glob: str = "*.{log,txt,out,md}") -> DataFrame:
    """What ``frames(read_logs(...))`` gives, for logs of any size: files are read in splits, cut where headers begin, so a row is a frame and never a file.

    A frame's number comes from its place in its split and the counts of the splits before, one row a split, which are broadcast (the driver lists as
    many). ``path`` is that of the file's metadata. A file without any header is one row, which is dropped.
    """
    files = spark.read.option("lineSep", HEADER_BEGIN).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text([path] if isinstance(path, str) else list(path))
    meta = F.col("_metadata")
    rows = files.select(meta["file_path"].alias("path"), meta["file_modification_time"].alias("mtime"), meta["file_block_start"].alias("__block"), F.monotonically_increasing_id().alias("__at"), "value")
    head = F.substring(F.concat("value", F.lit(HEADER_BEGIN)), 1, SNIFFED)
    looks = F.when(F.col("__block") == 0, head.contains(MARK) & head.contains("HEADER"))
    splits = rows.groupBy("path", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"), F.min_by(looks, "__at").alias("__looks"))
    file = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    placed = splits.select("path", "__block", F.first("__looks").over(file).alias("__looks"), (F.sum("__n").over(file) - F.col("__n") - F.col("__first") - 1).alias("__before"))
    frame = (F.col("__at") + F.col("__before")).cast("int")
    found = rows.join(F.broadcast(placed), ["path", "__block"]).withColumn("frame", frame).where("__looks and frame >= 0")
    parsed = F.struct(header(F.col("value")).alias("header"), response(F.col("value")).alias("response_text"))
    # inside a generator, as in ``frames``
    return found.select("path", "mtime", "frame", F.inline(F.array(parsed)))


def coerce(value: Column) -> Column:
    """A header value: quoted as JSON or in either quote, or bare; as text."""


    def of(v: Column) -> Column:
        quoted = F.from_json(F.concat(F.lit('{"v":'), v, F.lit("}")), "v string")["v"]
        plain = F.when(v.rlike(r'\A"[^"\\\p{Cntrl}]*"\z'), F.substr(v, F.lit(2), F.length(v) - 2))
        return plain.when(v.startswith('"') | v.startswith("[") | v.startswith("{"), F.coalesce(quoted, F.regexp_replace(v, '^"|"$', ""))).when(v.rlike("^'.*'$"), F.regexp_extract(v, "^'(.*)'$", 1)).otherwise(v)

    return once(stripped(value), of)


def frames(logs: DataFrame) -> DataFrame:
    """A row for each header of each log: path, mtime, frame, header (map) and response_text ('' without one)."""
    parts = once(F.split(F.col("text"), rf"\Q{HEADER_BEGIN}\E"), lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))
    # parsed inside the generator: a filter on a header's value would else be pushed below, and parse the header again
    found = logs.select("path", "mtime", F.posexplode(F.transform(parts, lambda f: F.struct(header(f).alias("header"), response(f).alias("response_text")))).alias("frame", "__f"))
    return found.select("path", "mtime", "frame", "__f.header", "__f.response_text")


def header(frame: Column) -> Column:
    """The ``key=value`` lines of a frame's header as a map; the last of a key is the one."""
    head = F.substring_index(frame, HEADER_END, 1)
    lines = F.filter(F.transform(F.split(head, r"\r?\n"), lambda x: stripped(F.replace(x, F.lit(MARK), F.lit("")))), lambda x: x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(stripped(F.substring_index(x, "=", 1)).alias("k"), coerce(F.substr(x, F.instr(x, "=") + 1)).alias("v")))
    last = lambda p: F.filter(p, lambda x, i: ~F.array_contains(F.slice(p["k"], i + 2, F.size(p)), x["k"]))
    return once(pairs, lambda p: F.map_from_entries(F.when(F.size(F.array_distinct(p["k"])) == F.size(p), p).otherwise(last(p))))


def response(frame: Column) -> Column:
    return F.rtrim(F.regexp_extract(frame, rf"(?s)\Q{RESPONSE_BEGIN}\E\r?\n?(.*?)(?:\Q{RESPONSE_END}\E|\z)", 1), F.lit(BLANKS))


def runs(found: DataFrame, least_build: int = LEAST_BUILD, prompt_prefix: str = PROMPT_PREFIX) -> DataFrame:
    """Records of report runs, newest first by parsed time (those without one last), then by the log's time."""
    h = F.col("header")
    build = h["build"].cast("long")
    kept = found.where((build >= least_build) & F.coalesce(h["prompt_template"], F.lit("")).startswith(prompt_prefix))
    fields = {"timestamp": "timestamp", "mode": "mode", "provider": "provider", "model": "model", "prompt": "prompt_template", "source_path": "source_path", "output_path": "output_path", "input_files": "input_files", "output_file": "output_file", "root_dir": "root_dir"}
    columns = [h[v].alias(k) for k, v in fields.items()]
    out = kept.select(*columns, build.alias("build"), F.col("path").alias("log_file"), "response_text", h["total"].cast("int").alias("total"), h["index"].cast("int").alias("index"), "mtime", F.try_to_timestamp(h["timestamp"]).alias("run_time"), "frame")
    return out.orderBy(F.desc_nulls_last("run_time"), F.desc("mtime"), "log_file", "frame")


def source_paths(found: DataFrame) -> DataFrame:
    """root_dir and its sorted distinct source paths."""
    return found.groupBy("root_dir").agg(F.array_sort(F.collect_set("source_path")).alias("source_paths"))


def activity(instructions: Column) -> Column:
    low = F.lower(instructions)
    out = F
    for label, ways in ACTIVITIES:
        hit = None
        for words in ways:
            every = None
            for w in words:
                every = low.contains(w) if every is None else every & low.contains(w)
            hit = every if hit is None else hit | every
        out = out.when(hit, label)
    return out.otherwise("Other")


def _stamp(c: Column, pattern: str) -> Column:
    day, h, m, s = (F.regexp_extract(c, pattern, i) for i in range(1, 5))
    return F.when(day != "", F.concat(day, F.lit(" "), F.concat_ws(":", h, m, s)))


def activity_facts(logs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """path, timestamp (from the file's name, else its header, else ``?``), activity, tokens_used and the sorted distinct files of activity logs, and columns to keep."""
    name = F.element_at(F.split("path", "/"), -1)
    when = r"(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})-(\d{2})"
    stamp = F.coalesce(_stamp(name, rf"^log_{when}\.txt"), _stamp(name, rf"^log-{when}-build-.*\.txt"), _stamp(F.col("text"), f"timestamp={when}"), F.lit("?"))
    instructions = once(F.regexp_replace(stripped(F.regexp_extract("text", r"(?i)INSTRUCTIONS\s*\n+([^\n][\s\S]*?)(?:\n\s*\n|\nHints|\z)", 1)), "\n", " "), activity)
    tokens = F.regexp_extract("text", r"\|\|\|\s*Tokens Used:\s*(\d+)", 1)
    files = F.transform(F.regexp_extract_all("text", F.lit(r"File:\s+([^\n\r]+)"), 1), lambda f: stripped(F.regexp_replace(f, "/source_path/?", "")))
    return logs.select(
        "path", *keep, stamp.alias("timestamp"), instructions.alias("activity"), F.when(tokens != "", tokens).otherwise("?").alias("tokens_used"),
        F.array_sort(F.array_distinct(F.filter(files, lambda f: f != ""))).alias("files"),
    )


def token_counts(logs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """path, columns to keep, day, hour, prompt_tokens, completion_tokens: of the last line with counts; nulls where there is none or the name has no time."""
    line = F.try_element_at(F.filter(F.split("text", "\n"), lambda x: x.rlike(_TOKENS)), F.lit(-1))
    n = lambda i: F.regexp_replace(F.regexp_extract(line, _TOKENS, i), ",", "").cast("long")
    name = F.element_at(F.split("path", "/"), -1)
    when = r"log[_-](\d{4}-\d{2}-\d{2})_(\d{2})-\d{2}-\d{2}"
    day = F.regexp_extract(name, when, 1)
    return logs.select("path", *keep, F.when(day != "", day).alias("day"), F.when(day != "", F.regexp_extract(name, when, 2).cast("int")).alias("hour"), n(2).alias("prompt_tokens"), n(3).alias("completion_tokens"))


_TOKENS = r"Tokens Used:\s*([\d,]+)\s*=\s*Prompt Tokens:\s*([\d,]+)\s*\+\s*Generated Tokens:\s*([\d,]+)"
