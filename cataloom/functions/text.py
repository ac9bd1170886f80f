"""Column functions on names, ids and texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as ``\\s`` has it.
BLANKS = " \t\n\x0b\f\r"
# What marks a name as that of a business outcome.
OUTCOME_PREFIXES = ("is ", "should ", "determine ", "calculate ", "can ", "must ", "has ")
OUTCOME_SUFFIXES = (" valid", " eligibility", " eligible", " status", " decision", " allowed", " required")
OUTCOME_WORDS = ("valid", "status", "eligibility", "approval", "route", "result")


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def stripped(c: Column) -> Column:
    """Without white space, line ends included, at either end."""
    return F.btrim(c, F.lit(BLANKS))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` names it: it is a lambda's argument, which no optimizer rule copies."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def short_code(id_: Column) -> Column:
    """Last three characters of an id without dashes, upper case; shorter ids whole."""
    return F.upper(F.right(F.replace(id_, F.lit("-"), F.lit("")), F.lit(3)))


def looks_like_uuid(c: Column) -> Column:
    return (F.length(c) == 36) & (F.length(c) - F.length(F.replace(c, F.lit("-"), F.lit(""))) == 4)


def normalise_text(c: Column) -> Column:
    """For matching of whole texts: one kind of line end, no blanks at line ends, at most one empty line, trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")
    c = F.regexp_replace(c, "[ \t\x0b\f]+\n", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def name_and_number(name: Column) -> tuple[Column, Column]:
    """``Base (3)`` as base and 3; without a number 1."""
    number = F.regexp_extract(name, r"\s*\((\d+)\)$", 1)
    return F.regexp_replace(name, r"\s*\(\d+\)$", ""), F.when(number == "", F.lit(1)).otherwise(number.cast("int"))


def is_outcome_name(name: Column) -> Column:
    low = F.trim(F.lower(name))
    found = [low.startswith(p) for p in OUTCOME_PREFIXES] + [low.endswith(s) for s in OUTCOME_SUFFIXES] + [low.contains(w) for w in OUTCOME_WORDS]
    return F.coalesce(any_of(found), F.lit(False))


def compact_name(c: Column) -> Column:
    """An entity's name for comparison: without white space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")


# Words that mark a block of code as SQL.
SQL_WORDS = ("SELECT", "UPDATE", "CASE", "FROM", "WHERE", "JOIN", "SET")


def fence_language(code: Column) -> Column:
    """The language that a block of code is marked with: sql where it has one of SQL's words, else none."""
    return F.when(F.coalesce(any_of([F.upper(code).contains(w) for w in SQL_WORDS]), F.lit(False)), "sql").otherwise("")


def fingerprint(*columns: Column | str) -> Column:
    """First twelve hex digits of a hash over the given values as canonical JSON (columns in the given order)."""
    return F.left(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), F.lit(12))


def escape_markdown(c: Column) -> Column:
    """For cells of tables: pipes and backticks escaped, a dash for null."""
    return F.coalesce(F.regexp_replace(c, r"([|`])", r"\\$1"), F.lit("—"))


def anchor(c: Column) -> Column:
    """Heading text as a link target: lower case, a dash for all that is no letter or digit, none at the ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", "-")), r"^-+|-+$", "")


def lines_label(lines: Column) -> Column:
    """[10, 20] as ``Lines 10–20``, [7] as ``Line 7``, none as a dash."""
    span = F.concat(F.lit("Lines "), F.array_min(lines).cast("string"), F.lit("–"), F.array_max(lines).cast("string"))
    one = F.concat(F.lit("Line "), F.get(lines, F.lit(0)).cast("string"))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) <= 0, "—").when(F.size(lines) == 1, one).otherwise(span)


def path_under(path: Column, prefix: str, ignore_case: bool = False) -> Column:
    """Whether a path lies under a prefix, by whole path components."""
    parts = [p for p in prefix.split("/") if p not in ("", ".")]
    own = F.filter(F.split(F.lower(path) if ignore_case else path, "/"), lambda p: ~p.isin("", "."))
    want = [p.lower() if ignore_case else p for p in parts]
    return F.slice(own, 1, len(want)) == F.array(*[F.lit(p) for p in want]) if want else F.lit(True)


def without_file_label(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^\s*File:\s*", "")


def int64(low: Column, high: Column) -> Column:
    """A signed 64-bit integer from its unsigned low and signed high halves."""
    return F.shiftleft(high.cast("long"), 32) + F.pmod(low.cast("long"), F.lit(1 << 32))


def as_flag(c: Column) -> Column:
    """Truth of an ``archived`` value in any of its spellings."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y", "archived"), F.lit(False))


def timestamp_of(c: Column) -> Column:
    """A timestamp in any of the catalog's four formats, else null; the raw string stays what records are compared by."""
    tries = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd_HH-mm-ss", "yyyyMMddHHmmss")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(t)) for t in tries])
