"""Making the library importable in Python workers that were not started beside it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]

_SENT: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Sends the library's sources to the workers, unless they find them on PYTHONPATH or in the working directory.

    The archive is served by the driver, so workers need no access to its folder.
    """
    app = spark.sparkContext.applicationId
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _SENT or ROOT in paths or Path.cwd() == ROOT:
        return
    archive = Path(tempfile.mkdtemp(prefix="quillmill-src-")) / "quillmill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((ROOT / "quillmill").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _SENT.add(app)
