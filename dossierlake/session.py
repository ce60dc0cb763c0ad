"""Session helpers: configuration and shipping the package to executors."""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def session(app: str = "dossierlake", **conf: str) -> SparkSession:
    """A session with the settings that the engine's plans expect; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


#: Bytes of a batch that goes to a Python worker, and the default that it replaces: texts can be long.
BATCH_BYTES, DEFAULT_BATCH_BYTES = "4m", 64 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, whatever their own path holds, and keep their
    batches small unless the session sets its own size. Once for each context."""
    sc = spark.sparkContext
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting).rstrip("b") == str(DEFAULT_BATCH_BYTES):
        spark.conf.set(setting, BATCH_BYTES)
    if getattr(sc, "_dossierlake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="dossierlake-"), "dossierlake.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("dossierlake", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._dossierlake_shipped = True
