"""Sends this package to the executors."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession, root: str) -> None:
    """Once an application: the session may run on machines, or since a time, without the repository's path."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    name = Path(tempfile.mkdtemp()) / "panelwright.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(Path(root, "panelwright").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(name))


def shipped(query: Callable[[SparkSession, str], DataFrame], root: str) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark, root)
        return query(spark, sf_dir)

    return run
