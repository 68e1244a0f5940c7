"""What a session needs before Python functions of this library run on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors unless their import path already names its folder. Once a session."""
    root = str(PACKAGE.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_sparkwright_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._sparkwright_shipped = True
