"""The package for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

NAME = "perigon-package.zip"


def found_here() -> bool:
    """Whether Python processes that start in this folder, with this environment, find the package."""
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return any(p and Path(p, "perigon", "workers.py").is_file() for p in paths)


def send(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session.

    Workers of a local master start in the driver's folder with its environment, and need nothing where they find it there. What the
    driver finds says nothing about the executors of a cluster.
    """
    context = spark.sparkContext
    local = context.master.startswith("local") and not context.master.startswith("local-cluster")
    if NAME in context._python_includes or local and found_here():
        return
    root = Path(__file__).resolve().parents[1]
    with zipfile.ZipFile(Path(tempfile.mkdtemp(), NAME), "w") as archive:
        for file in sorted(root.glob("perigon/**/*.py")):
            archive.write(file, file.relative_to(root))
    context.addPyFile(archive.filename)
