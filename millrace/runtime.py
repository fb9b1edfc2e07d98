"""Session-level helpers: reading tables, shipping the package, durable lineage cuts."""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(), "millrace.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("millrace", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names.

    A folder of our own is set only where the session names none and runs on this machine alone (tests).
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return df.checkpoint()
