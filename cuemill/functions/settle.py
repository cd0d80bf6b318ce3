"""Intermediate tables that several later jobs read: written to the cluster's shared folder, not cached."""

from __future__ import annotations

import contextlib
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@contextlib.contextmanager
def session_conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings for the length of a block; names use ``__`` for dots."""
    named = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed: it is worked out once, its lineage ends, and lost executors take nothing with them.

    The folder is the session's ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster is
    refused. Spark deletes the files when nothing refers to the table any more, if the session says so, and nothing stays in memory.
    """
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()
