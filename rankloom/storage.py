"""Tables written to cut lineage, in a folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_stored: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, else that of setCheckpointDir; a temporary one of this process where Spark is local.

    On a cluster without either this raises: a folder of the driver's disk is not one that executors share.
    """
    global _own_dir
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = given.get() if given.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_dir = _own_dir or tempfile.mkdtemp(prefix="rankloom-")
        at = "file://" + _own_dir
    return at.rstrip("/")


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that drop_stored() deletes with what stands there."""
    path = f"{shared_dir(spark)}/rankloom/{uuid.uuid4().hex}"
    _stored.append((spark, path))
    return f"{path}/{name}"


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    The table stays until drop_stored() or the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rankloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _broadcast_bound(spark: SparkSession) -> int:
    """Bytes up to which Spark broadcasts a side of a join by itself; -1: never."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    given = (spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None))
    return max((-1 if x.startswith("-") else size(x) for x in given if x), default=-1)


def stored_rows(df: DataFrame) -> DataFrame:
    """stored() for tables of many short rows, which joins must not take by the size of their files.

    Lists that differ little from user to user shrink to a hundredth as Parquet, and Spark plans by the size of
    files: it would broadcast tens of millions of such rows through the driver. So rows are counted (footers
    only), and if they are over its bound in memory, joins on the table sort and merge.
    """
    back = stored(df)
    bound = _broadcast_bound(df.sparkSession)
    large = bound >= 0 and back.count() * 8 * (len(back.columns) + 1) > bound
    return back.hint("merge") if large else back


def drop_stored() -> None:
    """Delete what stored() has written; DataFrames that still read it are of no use afterwards."""
    while _stored:
        spark, path = _stored.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended already; the folder then goes with its owner
            pass


atexit.register(drop_stored)
