"""The package on the executors, for functions that run there."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; map functions are imported there by name."""
    context = spark.sparkContext
    if getattr(context, "_sedimark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sedimark-")) / "sedimark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in package.rglob("*.py"):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._sedimark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all of the cluster sees, ``spark.checkpoint.dir``; without the setting a temporary one in local mode, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local["):
        root = spark.conf.get("spark.sql.warehouse.dir")
    return (root or "file://" + tempfile.mkdtemp(prefix="sedimark-")).rstrip("/")


def staged(rows: DataFrame) -> DataFrame:
    """rows written to the shared folder and read again, for what several branches of a query read."""
    path = f"{shared_folder(rows.sparkSession)}/staged/{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
