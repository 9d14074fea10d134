"""Session helpers shared by every subpackage."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Applications that have the archive, the folder it lies in until the driver ends, and what lets one thread at a time send it.
_SENT: set[str] = set()
_FOLDER: list[tempfile.TemporaryDirectory] = []
_LOCK = threading.Lock()


def build(master: str = "local[*]", app: str = "tidemill", **conf: str) -> SparkSession:
    """A session with the settings that the library expects; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def archive(folder: str) -> str:
    """This package as a zip file in ``folder``, for workers on other machines."""
    path = Path(folder) / "tidemill.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(Path(ROOT, "tidemill").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    return str(path)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: by the path that they share with the driver, or on a cluster from an archive that Spark sends them."""
    context = spark.sparkContext
    env = context.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if not context.master.startswith("local"):
        with _LOCK:
            if context.applicationId not in _SENT:
                if not _FOLDER:
                    _FOLDER.append(tempfile.TemporaryDirectory(prefix="tidemill-"))
                # executors fetch the file from this very path whenever they start, so it has to stay there
                context.addPyFile(archive(_FOLDER[0].name))
                _SENT.add(context.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the named Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
