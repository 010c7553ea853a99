"""A session with the settings that the operators count on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: UTC makes timestamps equal to what other engines read from the same Parquet; AQE sizes and splits shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "tidemark", **more: str) -> SparkSession:
    """The running session, or a new one; a cluster's own master and sizes are left alone unless given."""
    builder = SparkSession.builder.appName(name).config(map={**SETTINGS, **more})
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local master gets a new local folder;
    a cluster has none that all its machines see, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared folder; no two calls get the same."""
    return f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write once to shared storage and read again: what follows uses the rows several times without computing them again, and
    a lost executor loses none of them. options: of the writer."""
    path = run_dir(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for an application, unless they find it already: it lies in the working
    folder or on PYTHONPATH."""
    root, app = str(Path(__file__).resolve().parent.parent), spark.sparkContext.applicationId
    if app in _SHIPPED or os.getcwd() == root or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp()  # the driver's own: Spark serves the file from there while the application runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    stage = Path(folder) / "stage"
    shutil.copytree(Path(__file__).resolve().parent, stage / "tidemark", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tidemark-package", "zip", stage))
    _SHIPPED.add(app)
