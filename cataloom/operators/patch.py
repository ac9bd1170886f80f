"""Old run logs brought in line with reports whose paths were rewritten: new header values, new responses, and the same for the logs beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions.text import stripped
from cataloom.operators.keys import pick

#: Header fields that tell which logs belong together, and those of them that a patch sets.
QUARTET, SET = ("root_dir", "source_path", "output_path", "prompt_template"), ("root_dir", "source_path", "output_path")
# Fixed value: what leads the path of a code block in a report.
CODE_PATH = r"(?mi)(^[ \t]*\*\*Code[ \t]*Block:\*\*[ \t]*`?|^[ \t]*File:[ \t]*`?)"


def moved_paths(text: Column, old: Column, new: Column) -> Column:
    """A report's code paths below ``new`` where they stood below ``old``, or below the last components of it, the longest run of them first; bare file names
    go below ``new`` too."""
    parts = F.filter(F.split(old, "/"), lambda x: x != "")
    runs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("\\Q"), F.array_join(F.slice(parts, i, F.size(parts)), "/"), F.lit("\\E")))
    any_run = F.concat(F.lit(CODE_PATH + "(?:"), F.array_join(runs, "|"), F.lit(r")(?=/|`|[ \t]*$)"))
    below = F.when(F.size(parts) > 0, F.regexp_replace(text, any_run, F.lit("$1\x01"))).otherwise(text)
    bare = F.regexp_replace(below, F.lit(CODE_PATH + r"(?=[^\x01./`\s][^/`\n]*(?:`|[ \t]*$))"), F.lit("$1\x01/"))
    return F.replace(bare, F.lit("\x01"), F.regexp_replace(new, "/+$", ""))


def _with_values(header: Column, **values: Column) -> Column:
    fresh = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return F.map_concat(F.map_filter(header, lambda k, v: ~k.isin(*values)), F.map_filter(fresh, lambda k, v: v.isNotNull()))


def patch_logs(frames: DataFrame, reports: DataFrame) -> DataFrame:
    """The logs' records that change: path, frame, header, response_text, report, and whether the report's own (``matched``) or one beside it (``sibling``).

    ``frames`` is what the log parser gives, ``reports`` has report, old_text, new_text, root_dir, source_path and output_path. A report's own record is the newest
    whose response equals its old text, trimmed; they meet by digest. It takes the new values and the new text. Records with the same root, source,
    output and prompt as that one had take the new values too, and keep their response but for its paths. Of several reports the last one has the say.
    """
    mark = lambda c: F.sha2(stripped(c), 256)
    own = frames.where(F.trim("response_text") != "").select("path", "frame", "mtime", "header", mark(F.col("response_text")).alias("__mark"))
    asked = reports.select("*", mark(F.col("old_text")).alias("__mark")).where(F.trim("old_text") != "")
    # of equal responses only the newest matters
    newest = pick(own, ["__mark"], [F.desc("mtime"), F.col("path"), F.col("frame")])
    matched = asked.join(newest, "__mark").withColumnsRenamed({"path": "__path", "frame": "__frame"})
    put = {k: F.col(f"r.{k}") for k in SET}
    matched_rows = frames.alias("f").join(matched.alias("r"), (F.col("f.path") == F.col("r.__path")) & (F.col("f.frame") == F.col("r.__frame")))
    matched_rows = matched_rows.select("f.path", "f.frame", _with_values(F.col("f.header"), **put).alias("header"), F.col("r.new_text").alias("response_text"), "r.report", F.lit("matched").alias("change"))
    was = lambda c: F.coalesce(F.col(c), F.lit(""))
    groups = matched.select("report", "__path", "__frame", *SET, *[was(f"header.{k}").alias(f"__{k}") for k in QUARTET]).where(" and ".join(f"__{k} <> ''" for k in SET))
    beside = frames.where("response_text is not null").select("path", "frame", "header", "response_text", *[was(f"header.{k}").alias(f"__{k}") for k in QUARTET])
    met = beside.join(groups, [f"__{k}" for k in QUARTET]).where("path <> __path or frame <> __frame")
    moved = moved_paths(F.col("response_text"), F.col("__source_path"), F.col("source_path"))
    siblings = met.select("path", "frame", _with_values(F.col("header"), **{k: F.col(k) for k in SET}).alias("header"), moved.alias("response_text"), "report", F.lit("sibling").alias("change"))
    return pick(matched_rows.unionByName(siblings), ["path", "frame"], [F.desc("report"), F.col("change")])


def promoted(frames: DataFrame, patched: DataFrame) -> DataFrame:
    """All records, patched ones in the place of those that they came from."""
    kept = frames.join(patched.select("path", "frame"), ["path", "frame"], "left_anti")
    times = frames.select("path", "frame", *[c for c in frames.columns if c not in ("path", "frame", "header", "response_text")])
    return kept.unionByName(patched.select("path", "frame", "header", "response_text").join(times, ["path", "frame"]))
