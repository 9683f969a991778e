"""Sessions: settings for large inputs, and the package on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that workers can import it wherever they run."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_plumbline_shipped", False) or not package.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(f"{folder}/{package.name}.zip")
    context._plumbline_shipped = True


#: Rows and bytes of one Arrow batch, so that a worker's memory does not depend on how many or how long the rows are.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session and make the package known to its executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def session(name: str = "plumbline", **options: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; options go by their Spark names with _ for dots."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in (defaults | {k.replace("_", "."): v for k, v in options.items()}).items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())
