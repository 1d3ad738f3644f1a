"""Makes this package importable on executors that do not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package as a zip to the application, once."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="spliceatlas-code-")) / f"{top.name}.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, file.relative_to(top.parent))
        context.addPyFile(str(path))
        _SHIPPED.add(context.applicationId)
    return spark


def session_of(df: DataFrame) -> SparkSession:
    """The session of df, with the package shipped: call it before handing Spark a Python function."""
    return ship(df.sparkSession)
