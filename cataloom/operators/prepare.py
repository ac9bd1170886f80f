"""Records made ready: defaults and ids, what models are shown, records without a category, old names inside nested values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions.text import as_flag, blank, without_file_label
from cataloom.scratch import cut_lineage

# What a record has at least, what a model that suggests models is shown, and what a model's export leaves out.
DEFAULTS = ("category", "business_area", "owner")
SHOWN = ("id", "name", "spec", "category", "owner", "component", "code_file", "code_function", "dmn_inputs", "dmn_outputs")
NOT_EXPORTED = ("timestamp", "business_area", "archived")
# Fields of links and models under their old names.
LINK_NAMES = {"from_step_id": "from_logic_id", "fromLogicId": "from_logic_id", "from_step": "from_logic"}


def fill_defaults(records: DataFrame, defaults: Sequence[str] = DEFAULTS) -> DataFrame:
    """Records with an id (a random UUID where it was blank, drawn once), all default fields, and timestamps as text.

    ``filled`` says whose id is new. ``code_file`` loses its label.
    """
    out = records.withColumns({c: F.lit(None).cast("string") for c in defaults if c not in records.columns})
    if "timestamp" in out.columns:
        out = out.withColumn("timestamp", F.col("timestamp").cast("string"))
    if "code_file" in out.columns:
        out = out.withColumn("code_file", F.trim(without_file_label(F.col("code_file"))))
    return cut_lineage(out.withColumn("filled", blank(F.col("id"))).withColumn("id", F.when(F.col("filled"), F.expr("uuid()")).otherwise(F.col("id"))))


def shown(records: DataFrame, fields: Sequence[str] = SHOWN) -> DataFrame:
    """Records that aren't archived, with the fields that a model is shown; those that the table doesn't have are null."""
    live = records.where(~as_flag(F.col("archived"))) if "archived" in records.columns else records
    return live.select(*[F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in fields])


def for_export(records: DataFrame, dropped: Sequence[str] = NOT_EXPORTED) -> DataFrame:
    return records.drop(*dropped)


def uncategorised(records: DataFrame) -> DataFrame:
    """Active records whose category is null or blank."""
    return records.where(blank(F.col("category")) & ~as_flag(F.col("archived")))


def given(new: Column, old: Column) -> Column:
    """The new value if it isn't blank, else the old one."""
    return F.when(~blank(new.cast("string")), new).otherwise(F.coalesce(old, new))


def rename_nested(records: DataFrame, column: str, names: dict[str, str] = LINK_NAMES, dropped: Sequence[str] = ()) -> DataFrame:
    """As ``upsert.rename``, for the structs of an array: values move to the new names where these are blank, then the old ones go."""
    fields = [f.name for f in records.schema[column].dataType.elementType]

    def one(x: Column) -> Column:
        for old, new in names.items():
            if old in fields:
                x = x.withField(new, given(x[new], x[old]) if new in fields or new in seen else x[old])
                seen.add(new)
        gone = [f for f in (*names, *dropped) if f in fields]
        return x.dropFields(*gone) if gone else x

    seen: set[str] = set()
    return records.withColumn(column, F.transform(column, one))


def migrate(records: DataFrame, names: dict[str, str], dropped: Sequence[str] = (), nested: str = "links") -> DataFrame:
    """Records of an old catalog under today's names, links included, with ``archived`` as a flag. Doing it twice changes nothing."""
    from cataloom.operators.upsert import rename

    out = rename(records, names, dropped)
    if nested in out.columns:
        out = rename_nested(out, nested)
    return out.withColumn("archived", as_flag(F.col("archived")) if "archived" in out.columns else F.lit(False))
