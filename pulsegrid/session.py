"""Session settings and lineage cuts."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SUGGESTED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "pulsegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the suggested settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SUGGESTED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Only where nothing is configured (tests, a laptop) a local folder is made,
    and only for a local master: on a cluster a local folder would be lost with
    its executor, so an unset directory is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="pulsegrid-")


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage at a point several later branches share.  Parquet keeps
    column pruning and gives the planner true sizes, which a row checkpoint
    does not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pulsegrid/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and that nothing reads any more.

    Only for frames that ``materialise`` returned, and only when every frame made from them has been written itself.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark).rstrip('/')}/pulsegrid/"
    files = df.inputFiles()
    if files:
        folder = files[0].rpartition("/")[0]
        name = folder.rpartition("/")[2]
        path = spark._jvm.org.apache.hadoop.fs.Path(top + name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
