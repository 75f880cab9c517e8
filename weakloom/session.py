"""Session set-up, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting for the bytes of rows it sends to a Python worker at once, and the size used here. An executor holds a batch several times
#: outside its heap, for each task, and keeps much of that memory; at 10,000 texts of some KB (Spark's own limits) it is most of what it has there.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def build_session(app: str = "weakloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    On a cluster leave ``master`` unset and let the submit command decide it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> bool:
    """From now on rows go to Python in batches of about ``BATCH_BYTES``, unless the session names a size. Whether that changed the session."""
    if BATCH_SETTING in spark.conf.getAll:
        return False
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary one is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("name a shared folder in spark.checkpoint.dir: executors do not see each other's disks")
    local = tempfile.mkdtemp(prefix="weakloom-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other job uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so a lost executor costs one re-read."""
    shared = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if its row count was checked, else ``df`` as it is."""
    small = fits(df, max_rows)
    return (F.broadcast(df) if small else df), small
