"""Session defaults and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def build(app: str = "pagewright", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per context: they need not have it installed.

    The archive is made beside the driver; Spark's own file server hands it to the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_pagewright_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pagewright-"), "pagewright-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._pagewright_shipped = True


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor and never change again.

    The shared folder comes from ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if shared:
            context.setCheckpointDir(shared)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder for intermediate tables and stream state, below the one all executors share.

    The place is ``spark.checkpoint.dir``; only a local session without it uses its own temporary
    folder.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = os.path.join(tempfile.gettempdir(), "pagewright-shared")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
