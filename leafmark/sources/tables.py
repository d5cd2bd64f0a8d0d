"""Tables written in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the setting is absent a temporary folder is used in local mode only; on a cluster
    its absence is an error, since a machine-local folder would lose files.
    """
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told is None:
        got = sc._jsc.sc().getCheckpointDir()
        told = got.get() if got.isDefined() else None
    if told is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        told = tempfile.mkdtemp(prefix="leafmark-")
        sc.setCheckpointDir(told)
    return told.rstrip("/")


def _fs_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_stored(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _fs_path(spark, path)
        fs.delete(p, True)


def stored(spark: SparkSession, df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and
    survives lost executors. The table goes when the application ends, or with drop_stored()."""
    path = f"{shared_dir(spark)}/leafmark-{uuid.uuid4().hex[:12]}-{name}"
    df.write.option("compression", codec).parquet(path)
    fs, p = _fs_path(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_leafmark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="leafmark-src-")) / "leafmark.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))
    sc._leafmark_shipped = True
