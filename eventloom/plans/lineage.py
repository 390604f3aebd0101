"""Cutting of lineage, so that plans stay small and survive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}  # folders by application


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="eventloom-lineage-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        return _OWN[app]
    return folder


def local_folder(spark: SparkSession) -> str:
    """The shared folder as a path that open() takes."""
    path = re.sub(r"^file:(//)?(?=/)", "", shared_folder(spark))
    if re.match(r"\w+:", path):
        raise ValueError(f"FCS files are opened by path, and {path} is none")
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
