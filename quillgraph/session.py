"""Sessions, and the way the package reaches the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Rows and bytes of an Arrow batch: texts are long, and a batch stands in memory on both sides of a Python worker's pipe.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2500, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def build_session(master: str = "local[8]", partitions: int = 8, **more: str) -> SparkSession:
    """A session with the settings that the engine expects; a cluster sets its own sizes."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | more
    builder = SparkSession.builder.master(master).appName("quillgraph")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors once a session, as --py-files would, and bounds Arrow batches."""
    sc = spark.sparkContext
    for name, most in BATCH.items():
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    if getattr(sc, "_quillgraph_shipped", False):
        return
    with tempfile.NamedTemporaryFile(prefix="quillgraph-", suffix=".zip", delete=False) as held:
        path = held.name
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, os.path.join(PACKAGE.name, f.relative_to(PACKAGE)))
    sc.addPyFile(path)
    sc._quillgraph_shipped = True
