"""Session settings shared by the library, the bench and the tests."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corrobora", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator assumes (UTC clock, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # a side that turns out small at run time is broadcast, whatever was estimated
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a single-machine session without that setting gets a folder of its own, removed when Python ends. On a cluster a
    local folder would be a different one on every machine, so the setting is required there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not re.match(r"local(\[[^-]*\])?$", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    local = tempfile.mkdtemp(prefix="corrobora-checkpoint-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def drop_staged(spark: SparkSession) -> None:
    """Delete all staged tables of this application; frames that read them cannot be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_staging_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _staging_dir(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "staged", spark.sparkContext.applicationId)


def staged(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """The same rows as a written table in the shared folder; ``order`` fixes their place in it.

    For inputs of iterative work and for collapsed tables that several passes read: every pass
    reads files instead of recomputing (and shipping) the whole plan, and a lost executor costs one
    re-read. Files lie under ``staged/<application id>``; ``drop_staged`` removes them.
    """
    spark = df.sparkSession
    path = os.path.join(_staging_dir(spark), uuid.uuid4().hex)
    if order:
        df = df.repartition(parallelism(spark), *order).sortWithinPartitions(*order)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
