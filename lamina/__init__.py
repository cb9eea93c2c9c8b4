"""lamina: similarity deduplication and delta storage on Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Let the session's Python workers import this package, once an application.

    The driver serves the file to the executors, so no shared folder is needed.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lamina-"), "lamina.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lamina", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
