"""Staged tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Folders of local sessions without spark.checkpoint.dir, by application; Spark lets no session set it later.
_TEMPORARY: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors see.

    Where that is unset, a local session (as in tests) gets a temporary folder, which goes when the process ends; on a cluster
    no folder of one machine would do, so there it raises.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or _TEMPORARY.get(context.applicationId)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = _TEMPORARY[context.applicationId] = f"file://{folder}"
    return f"{base.rstrip('/')}/lattica/{context.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table of this application."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back: cuts the lineage of a loop and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join by shuffle. Spark goes by the bytes of files and would broadcast tables of very many rows that compress well, as vertices in order and their labels do."""
    return df.hint("merge")


def clear(spark: SparkSession) -> None:
    """Delete all that this application has staged. For when its results have been written elsewhere: they are read from there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: they need not see the driver's folders."""
    context = spark.sparkContext
    if getattr(context, "_lattica_shipped", False):
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lattica-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "lattica_code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(home.rglob("*.py")):
            z.write(file, file.relative_to(home.parent))
    context.addPyFile(str(path))
    context._lattica_shipped = True
