"""Session settings and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "meltemi", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; pass more as keyword pairs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``; whoever starts a session by hand names one too.
    Only a session inside one process (master ``local`` or ``local[...]``) that has no such setting gets a temporary folder of this machine, which all its tasks share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = os.path.join(tempfile.gettempdir(), "meltemi")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


#: Whether Spark removes the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read back: a lost executor costs no recomputation of what led to them.

    What was shuffled on the way to them goes once they are written, and not when the driver next happens to collect its garbage.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
