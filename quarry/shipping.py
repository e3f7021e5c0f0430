"""Make this package importable where Spark's Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def ensure_importable(spark: SparkSession) -> None:
    """Send the package to the executors once per Spark context, unless they get it through PYTHONPATH."""
    context = spark.sparkContext
    if getattr(context, "_quarry_sent", False):
        return
    if context.master.startswith("local") and str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_ROOT.rglob("*.py")):
            out.write(path, path.relative_to(_ROOT.parent))
    context.addPyFile(str(archive))
    context._quarry_sent = True
