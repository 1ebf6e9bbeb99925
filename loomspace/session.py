"""Sessions: a local one for tests and benchmarks, and the package on the executors' path."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8, name: str = "loomspace") -> SparkSession:
    """A single-machine session; on a cluster, take the cluster's own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Where it is unset, a local session gets a local one; on a cluster
    that would lose rows, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomspace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again, for tables that a query reads several times. The files
    go when the driver ends."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/w-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit
        pass


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application, unless their PYTHONPATH already has it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped and str(ROOT.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        path = Path(tempfile.mkdtemp()) / f"{ROOT.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(ROOT.rglob("*.py")):
                z.write(f, f.relative_to(ROOT.parent))
        spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
    return spark
