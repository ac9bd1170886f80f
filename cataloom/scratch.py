"""Lineage cut in the folder that all executors share: by ``checkpoint()``, or by a written table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where none is named a folder of our own is set, which only one machine can do without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cataloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


_MADE: list[list[DataFrame]] = []


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables made by ``tabled`` inside are deleted at the end, but for those put into the list that this gives."""
    made, kept = [], []
    _MADE.append(made)
    try:
        yield kept
    finally:
        _MADE.pop()
        names = {getattr(k, "table_path", None) for k in kept}
        forget(*[t for t in made if t.table_path not in names])
        if _MADE:
            _MADE[-1].extend(k for k in kept if getattr(k, "table_path", None))


def tabled(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written as a table and read back. Unlike a checkpoint its size is known, so joins of a long iteration are planned by what is there,
    and not by a product of estimates that doubles its digits a round. ``forget`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cataloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    if _MADE:
        _MADE[-1].append(out)
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of ``tabled`` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "table_path", None):
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
