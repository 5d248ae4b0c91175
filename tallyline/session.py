"""Session construction and the places where Spark may cut lineage."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "tallyline", cores: str = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the operators are written for.

    On a cluster the session comes from the launcher and this is not used.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("TALLYLINE_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": str(shuffle_partitions or 8),
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session. A temporary one is made only where none is named and the
    executors are this very process; on a cluster a missing folder is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyline-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; it survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _signature(spark: SparkSession, path: str) -> str:
    """Changes whenever the files below ``path`` do: their names, lengths and times of change."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return path
    files, found = fs.listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return repr(sorted(found))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


_written: dict[tuple[str, str], str] = {}


def written_once(spark: SparkSession, name: str, paths: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, written as Parquet in the shared checkpoint folder at its first use and read from
    there by every later query of the application, until any file below ``paths`` changes."""
    digest = hashlib.sha256("\n".join(_signature(spark, p) for p in paths).encode()).hexdigest()[:24]
    key = (spark.sparkContext.applicationId, f"{name}-{digest}")
    if key not in _written or not _exists(spark, f"{_written[key]}/_SUCCESS"):
        target = f"{ensure_checkpoint_dir(spark)}/{key[0]}-{key[1]}"
        build().write.mode("overwrite").parquet(target)
        _written[key] = target
    return spark.read.parquet(_written[key])


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster on which it isn't installed. Call it once, before the first query."""
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tallyline-package-")
    archive = shutil.make_archive(os.path.join(folder, "tallyline"), "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(archive)
