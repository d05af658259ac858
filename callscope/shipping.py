"""Sending the package to the Python workers."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_sent: set[str] = set()


def by_value(module: str) -> None:
    """Send a module's classes themselves instead of their names.

    Keyed stream processors are also loaded by a Python process beside the driver, which gets
    neither the driver's ``sys.path`` nor what ``ship`` sends.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


def ship(spark: SparkSession) -> None:
    """Let the workers import this package, whatever folder they were started from; once per application.

    The driver's ``sys.path`` does not reach the workers. The package travels as a zip file that Spark hands out.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="callscope-ship-")
    path = os.path.join(os.path.realpath(folder), "callscope-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _sent.add(context.applicationId)
