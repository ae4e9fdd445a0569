"""Cutting lineage in the shared folder that the cluster names, so that a lost executor loses no work."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset on one machine, as in tests, a folder of our own, removed at the end.
    A cluster must name one, since a folder of one machine is lost with it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(named)
        return named
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="leafmere-")
        atexit.register(shutil.rmtree, own, True)
        context.setCheckpointDir(own)
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, what: str) -> str:
    """A name in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
