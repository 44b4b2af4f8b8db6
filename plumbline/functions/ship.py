"""Ships this package to Python workers that cannot import it otherwise."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: the package as a zip file, served by the driver. Not where PYTHONPATH already holds it."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.applicationId in _shipped or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(sc.applicationId)
    path = Path(tempfile.mkdtemp(prefix="plumbline-code-")) / "plumbline_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(path))


def shipped(fn: Callable) -> Callable:
    """fn(spark, ...) with the package shipped first."""

    @functools.wraps(fn)
    def run(spark, *args, **kwargs):
        ship(spark)
        return fn(spark, *args, **kwargs)

    return run
