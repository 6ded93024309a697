"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings the library relies on.  All are runtime SQL settings except the last two, so a session
# somebody else built can be brought in line with ``tune_session``.
_SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may hold texts of many kilobytes; a batch of them is held several times over while Python works on it.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, so that they need no copy of their own."""
    application, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if application in _SHIPPED or not root.is_dir():
        return
    # The driver hands the file out itself; nobody else looks into this folder.
    packed = Path(tempfile.mkdtemp(prefix="emberlog-code-")) / "emberlog_package.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(packed))
    _SHIPPED.add(application)


def build_session(app: str = "emberlog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``master=None`` leaves the choice to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**_SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def tune_session(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session that exists already, and send it the package's code."""
    ship_package(spark)
    for key, value in _SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint location.

    A cluster names that location in ``spark.checkpoint.dir``.  Only where it is unset (a local run)
    is a temporary folder used instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="emberlog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
