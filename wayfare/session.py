"""Session builder and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Shuffled bytes that adaptive execution puts into one task. They are compressed: sorted and grouped, a row of
# a few numbers takes some twenty times its share of them, so the default of 64 MB may fill over a gigabyte.
TASK_BYTES = "16m"
_TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

# Whether rows dealt by some of a join's keys are dealt again by all of them. The walk of ``search`` deals its
# tables once and joins them by more keys at every leg; dealt again, its paths would go through a shuffle each time.
_DEAL_AGAIN = "spark.sql.requireAllClusterKeysForCoPartition"


def build_session(app: str = "wayfare", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew-join handling on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        _TASK_BYTES: TASK_BYTES,
        _DEAL_AGAIN: "false",
        # Partitions measured to be below this size join by hash, without a sort.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        # Call-site capture makes several JVM round trips per column expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_tasks(spark: SparkSession) -> None:
    """Keep shuffled partitions apart beyond ``TASK_BYTES``, in sessions that set no size of their own."""
    if spark.conf.get(_TASK_BYTES, None) is None:
        spark.conf.set(_TASK_BYTES, TASK_BYTES)


def keep_dealt(spark: SparkSession) -> None:
    """Let joins take rows as they are dealt by some of their keys, in sessions that do not say otherwise."""
    if _DEAL_AGAIN not in spark.conf.getAll:
        spark.conf.set(_DEAL_AGAIN, "false")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, whose Python code some operators run there.

    For sessions whose executors do not find it by themselves; the archive goes through Spark's own
    file distribution.
    """
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="wayfare-ship-")) / "wayfare.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def staging_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without that setting stages below its warehouse folder. A cluster session
    must name one, because executors cannot share a folder of the driver's machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the staging folder and read it back.

    Cuts the lineage, survives the loss of executors, and fixes values that would differ if the
    plan ran twice (row positions, for one).
    """
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path in the staging folder. All paths of one application share a parent folder,
    which can go when the application has ended."""
    app = spark.sparkContext.applicationId
    return f"{staging_root(spark).rstrip('/')}/wayfare-{app}/{label}-{uuid.uuid4().hex}"
