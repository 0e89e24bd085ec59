"""Puts this package on the path of Python workers, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tintlake-package-")  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(package, Path(folder, "root", package.name), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/root"))
    _shipped.add(app)
