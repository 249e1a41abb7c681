"""Cutting lineage in the folder all executors share, and shipping the package to workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where that is unset (local tests)."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"skarn-shared-{spark.sparkContext.applicationId}")
    if not os.path.isdir(own):
        os.makedirs(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    The result has no lineage to ``df``: a lost executor costs a re-read, not a re-run, and a frame used by
    several branches is computed once. Parquet keeps it several times smaller than a binary checkpoint.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/skarn-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


def _remember(spark: SparkSession, path: str) -> None:
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(_clean, spark, app)
    _written[app].append(path)


def _clean(spark: SparkSession, app: str) -> None:
    """Remove this session's stage tables at exit; a session already stopped leaves them to the cluster's cleaner."""
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        for path in _written.pop(app, []):
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the gateway may be gone
        pass


def ship(spark: SparkSession) -> None:
    """Give executors the package, whatever their PYTHONPATH is. Once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="skarn-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "skarn-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, str(source.relative_to(PACKAGE.parent)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
