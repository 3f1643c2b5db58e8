"""Session helpers: shared scratch tables, shipping the package, size checks."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many bytes (rows x a stated row width).
BROADCAST_BYTES = 64 << 20

_written: list[tuple[SparkSession, str]] = []


def _driver_gigabytes() -> int:
    """Heap of a local session: three fifths of the memory that the machine has, 20 GB at most."""
    try:
        whole = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / (1 << 30)
    except (ValueError, OSError, AttributeError):
        return 4
    return int(max(2, min(20, whole * 0.6)))


def build(app: str = "glosswork", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tuned for."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(max(8, os.cpu_count() or 8)) if cores == "*" else str(max(8, int(cores))),
        "spark.driver.memory": f"{_driver_gigabytes()}g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (a local test session) is a folder of
    this machine used instead.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='glosswork-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage at a place that outlives any executor. The table is
    removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glosswork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`materialise` before the driver ends."""
    for path in df.inputFiles()[:1]:
        folder = path.rsplit("/", 1)[0]
        for spark, known in list(_written):
            if folder.rstrip("/").endswith(known.rsplit("/", 1)[1]):
                _delete(spark, known)
                _written.remove((spark, known))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared folder that is not needed any more."""
    _delete(spark, path)


def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    context = spark.sparkContext
    if getattr(context, "_glosswork_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="glosswork-zip-"), "glosswork.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(archive)
    context._glosswork_shipped = True


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay below ``limit`` bytes, else as it is.

    Beyond the limit the planner shuffles both sides; the result is the same.
    """
    most = max(1, limit // row_bytes)
    counted = df.limit(most + 1).count()
    return F.broadcast(df) if counted <= most else df


#: Bytes that one task of a planned shuffle takes.
TASK_BYTES = 96 << 20


def tasks_for(spark: SparkSession, size: float) -> int:
    """Tasks to shuffle ``size`` bytes into: as many as they fill, and no fewer than the session's partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // TASK_BYTES) + 1)
