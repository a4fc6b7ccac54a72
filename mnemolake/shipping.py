"""Make the package importable in Python workers that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()

#: Bytes of an Arrow batch, where the session keeps Spark's default (64 MB, of which several lie in an executor's native memory at once).
BATCH_BYTES = "2m"
_DEFAULT = "67108864b"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the workers, once for each application, and keep Arrow batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", _DEFAULT) == _DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _sent:
        root = Path(__file__).resolve().parent
        to = os.path.join(tempfile.mkdtemp(prefix="mnemolake"), "mnemolake.zip")  # the driver serves it; workers fetch it
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(to)
        _sent.add(app)
    return spark
