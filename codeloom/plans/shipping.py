"""Give executors the source of this package, however the session was started."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Add a zip of the package to the application once; Spark serves it to every executor."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    digest = hashlib.sha256(data.getvalue()).hexdigest()[:12]
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{os.path.basename(root)}-{digest}.zip")
    with open(path, "wb") as out:
        out.write(data.getvalue())
    context.addPyFile(path)
    _shipped[context.applicationId] = path
