"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is sent to all executors: some megabytes.
SMALL = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names (spark.checkpoint.dir); a local one only for a local master that names none."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        context.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame, *metrics) -> DataFrame:
    """df, computed once, written to the shared folder and read back; metrics, named aggregates, are in its ``told``.

    Unlike an eager checkpoint it isn't computed twice, is columnar, and its size is known to the planner, which
    then broadcasts small frontiers and shuffles large ones. Metrics are gathered by the write itself.
    """
    path = f"{shared_dir(df.sparkSession)}/graphloom-cut-{uuid.uuid4().hex}"
    seen = Observation() if metrics else None
    (df.observe(seen, *metrics) if metrics else df).write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.told, back.cut_at = seen.get if seen else {}, path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes the files of cut tables on which nothing depends any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def near(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it has few rows. A semi-join with it then goes below aggregates and unions, so that these see matching rows only."""
    return F.broadcast(df) if rows <= SMALL else df
