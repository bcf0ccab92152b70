"""Tables written to a folder that driver and executors share, to end lineage at files that outlive any executor."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder (spark.checkpoint.dir). Where none is set: the default file system's, or, in local mode, a temporary folder of this machine.

    Raises where executors on other machines could not read it.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        default = sc._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if not default.startswith("file:"):
            shared = f"{default.rstrip('/')}/tmp/mediacat-{uuid.uuid4().hex}"
        elif sc.master.split("[")[0] == "local":
            shared = tempfile.mkdtemp(prefix="mediacat-")
        else:
            raise RuntimeError("spark.checkpoint.dir is not set and the default file system is a local disk: name a folder that all executors share")
        sc.setCheckpointDir(shared)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return shared.rstrip("/")


#: Whether Spark removes a query's shuffle files where the query ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read again; the shuffle files behind it go at once."""
    path = path or f"{scratch_dir(df.sparkSession)}/mediacat-{uuid.uuid4().hex}"
    with cleaned(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
