"""What a session needs to run Python functions of this package on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, for those that can't import it from their own path."""
    if (app := spark.sparkContext.applicationId) not in _shipped:
        _shipped.add(app)
        top = Path(__file__).resolve().parent
        with zipfile.ZipFile(archive := f"{tempfile.mkdtemp(prefix='package-')}/{top.name}.zip", "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(archive)
