"""The package itself, sent to the executors, so that their Python workers can import it wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()
BATCH_BYTES = 4 << 20


def _bytes(setting: str) -> int:
    digits = setting.rstrip("bkmgBKMG")
    return int(digits) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(setting[len(digits) :].lower()[:1], 1)


def ship(spark: SparkSession) -> None:
    """Once for each application: zip the package's modules and add them to the Python path of all tasks.

    Also bounds the bytes of an Arrow batch, unless the session has a smaller bound: batches of long texts are then no
    larger than batches of short ones.
    """
    if not 0 < _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="hexavane-")) / "hexavane_modules.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent))
    context.addPyFile(str(target))
    _SENT.add(context.applicationId)
