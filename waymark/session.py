"""Session defaults, worker import path and shared scratch space."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(app: str = "waymark", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the library is tested under: UTC, AQE, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever they start.

    On one machine its folder goes on their path. A cluster's executors don't share that folder:
    they get the package as one archive from the shared scratch space, and so do later ones.
    """
    sc = spark.sparkContext
    if sc.master.split("[")[0] == "local":
        paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in [ROOT, *paths] if p)
    elif not any(f.startswith("waymark-package-") for f in sc._python_includes):
        path = sc._jvm.org.apache.hadoop.fs.Path(shared_dir(spark, "waymark-package") + ".zip")
        sink = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        sink.write(packed_source())
        sink.close()
        sc.addPyFile(path.toString())
    return spark


def packed_source() -> bytes:
    """This package's modules as a ZIP archive, the same bytes each time."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(Path(ROOT, "waymark").rglob("*.py")):
            out.writestr(zipfile.ZipInfo(str(file.relative_to(ROOT))), file.read_bytes())
    return held.getvalue()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI under ``spark.checkpoint.dir``, the storage all executors share.

    Where the setting is absent (tests, a laptop) a temporary folder becomes the checkpoint
    folder; a cluster must name its own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="waymark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df):
    """Cut the lineage through the shared checkpoint folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared_dir(spark, "probe")
    return df.checkpoint()
