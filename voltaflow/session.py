"""Session helpers: a local session for tests, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cores: str = "8", partitions: int = 8, app: str = "voltaflow") -> SparkSession:
    os.environ.setdefault("PYTHONPATH", str(ROOT.parent))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("VOLTAFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that can't import it: once per application, as a zip."""
    app = spark.sparkContext.applicationId
    on_path = str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if app in _SHIPPED or on_path:
        return
    _SHIPPED.add(app)
    out = Path(tempfile.mkdtemp(prefix="voltaflow-zip-")) / "voltaflow.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(out))
