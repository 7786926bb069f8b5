"""Python workers need this package: where they cannot import it by path, it is sent to them with the job."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HOME = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package to all workers once a session, unless they find it by PYTHONPATH or the working folder."""
    paths = [Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    context = spark.sparkContext
    if HOME.parent in paths or "site-packages" in HOME.parts or getattr(context, "_geoweft", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="geoweft-"), "geoweft.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(HOME.rglob("*.py")):
            z.write(f, f.relative_to(HOME.parent))
    context.addPyFile(archive)
    context._geoweft = True
