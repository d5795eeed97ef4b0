"""Shared plumbing: durable intermediate tables, worker imports, safe columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ensure_importable

#: White space that separates words: space and U+0009 to U+000D.
WORD_SPACE = "\\x20\\x09-\\x0D"


__all__ = ["WORD_SPACE", "ensure_importable", "hidden", "materialize", "quoted", "shared_dir", "table"]


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def hidden(columns: list[str]) -> str:
    """A prefix that no name of ``columns`` has, whatever its case: for helper columns."""
    taken, prefix = [c.lower() for c in columns], "__h"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``.  Where it is unset
    and the master is local (tests) a temporary folder of this process is set;
    on a cluster no other machine would see that, so it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_logweir_dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="logweir-shared-")
        spark.sparkContext._logweir_dir = base
    return f"{base.rstrip('/')}/logweir/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table.

    Cuts the lineage: later stages reread files that survive lost executors.
    """
    path = shared_dir(df.sparkSession, name)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
