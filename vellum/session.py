"""A session with the settings that the operators expect."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application.

    Nothing is done where they inherit a PYTHONPATH that holds it. With ``spark-submit``,
    ``--py-files`` does the same.
    """
    package = Path(__file__).resolve().parent
    application = spark.sparkContext.applicationId
    if application in _shipped or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(application)
    path = os.path.join(tempfile.mkdtemp(prefix="spark-vellum-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)


def session(app: str = "vellum", conf: dict[str, str] | None = None) -> SparkSession:
    """UTC and adaptive execution; everything else is the cluster's, or given in ``conf`` by the settings' own names."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
