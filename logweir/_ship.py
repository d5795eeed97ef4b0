"""Let Python workers import this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]


def ensure_importable(spark: SparkSession) -> None:
    """Ship the sources once, unless the job was started with them on ``PYTHONPATH``."""
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(_ROOT) in paths or getattr(spark.sparkContext, "_logweir_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="logweir-src-")) / "logweir_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((_ROOT / "logweir").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._logweir_shipped = True
