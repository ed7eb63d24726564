"""What a job needs of the cluster: shared folders for intermediate tables, and the code."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000
_shipped: set[str] = set()


def folder(spark: SparkSession, name: str) -> str:
    """A new path under `spark.checkpoint.dir`.

    Where that is unset, a session on one machine has a temporary folder; executors on others
    would not see it, so a cluster must name a shared folder.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir()
        if checkpoints.isDefined():
            base = checkpoints.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            base = tempfile.gettempdir()
        else:
            raise ValueError(f"set {SETTING} to a folder that the driver and executors share")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Sets the session to Arrow batches of some 4 MB, for texts of some 2 KB.

    An executor holds a batch of each task several times: on its way to Python, there, and on its
    way back. By default it has 10,000 rows, whatever their length; smaller settings stay.
    """
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for an application, as --py-files does."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        root, name = os.path.split(package)
        to = os.path.join(tempfile.mkdtemp(prefix="ship-"), name)
        context.addPyFile(shutil.make_archive(to, "zip", root, name))
        _shipped.add(context.applicationId)
