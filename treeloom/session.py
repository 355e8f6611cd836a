"""Sessions and the folder that a cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query go when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(master: str | None = None, *, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; sizes are left to it and to the cluster's settings."""
    b = SparkSession.builder.appName("treeloom")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Tables partitioned by doc_id are joined on doc_id and more without another shuffle.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    } | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}) | conf
    return b.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a temporary one only on a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="treeloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/treeloom/{name}-{uuid.uuid4().hex}"


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast, for what grows with the corpus.

    A plan judges a stored table by its files, and like nodes take a few bytes each
    there but a hundred in the driver's memory.  Adaptive execution does not take a
    broadcast back that was planned before the sizes were known.
    """
    return df.hint("merge")


def store(nodes: DataFrame, name: str = "nodes") -> DataFrame:
    """Write a table once to the shared folder and read it back, as for a plan that uses it in several places.

    Parsing then runs once, later scans read only the columns that they need, and a
    lost executor costs no second parse.  It is deleted when the driver ends.
    """
    spark = nodes.sparkSession
    path = shared_folder(spark, name)
    # What was shuffled for the table is of no use once it is written, and else stays until the driver collects its garbage.
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        nodes.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)

    def clean() -> None:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have gone first
            pass

    atexit.register(clean)
    return spark.read.schema(nodes.schema).parquet(path)
