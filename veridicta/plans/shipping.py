"""Send this package to the executors' Python, once a Spark application."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


ROWS_PER_BATCH = 1000  # texts have some KB; Spark's own number would hand over tens of MB at once


def ship(spark: SparkSession) -> None:
    context, key = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))
    if context.applicationId in _sent:
        return
    top = Path(__file__).resolve().parents[1]
    handle, path = tempfile.mkstemp(prefix=f"{top.name}-", suffix=".zip")  # the driver's copy; Spark serves it to all
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(path)
    _sent.add(context.applicationId)
