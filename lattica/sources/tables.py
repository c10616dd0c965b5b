"""Readers and the shared-folder materialisation used to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths of the tables that this session wrote to the shared folder.
_written: list[str] = []


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data directory (a Parquet file or folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset a local folder is made in local mode (tests), whose only executor is the driver; a cluster must name one.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark, "_lattica_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark._lattica_shared = own
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``localCheckpoint`` the copy survives the loss of an executor, and unlike ``cache`` it is not recomputed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lattica-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_drop_at_exit, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        drop_materialized(spark)


def drop_materialized(spark: SparkSession) -> int:
    """Deletes what ``materialize`` has written, once no DataFrame needs it; gives the number of tables."""
    n = len(_written)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    _written.clear()
    return n
