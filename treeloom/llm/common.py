"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word for the operators that count words: anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def full_text(text: str | Column = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one named by ``spark.checkpoint.dir``.  Only a local master, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="treeloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/treeloom/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            _delete(spark, path)
        except Exception:  # the gateway may have gone first
            pass

    atexit.register(clean)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: what follows survives lost executors without
    computing ``df`` again, and nondeterministic row ids are fixed from here on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._treeloom_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing will read again."""
    for t in tables:
        if t is not None and hasattr(t, "_treeloom_path"):
            _delete(t.sparkSession, t._treeloom_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in have:
        name = f"_{name}"
    return name
