"""This package on the executors' Python path."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application.

    Operators that run Python call this first, so that neither a cluster nor a
    local session started from another folder needs an installation.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    # the driver serves the file to the executors; no executor reads this folder
    target = os.path.join(tempfile.mkdtemp(prefix="wardline-"), "wardline_package.zip")
    with open(target, "wb") as f:
        f.write(packed.getvalue())
    context.addPyFile(target)
    _sent.add(context.applicationId)
