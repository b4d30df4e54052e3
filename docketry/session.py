"""Session defaults for local runs; a cluster brings its own session."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "docketry", cpus: int | None = None, partitions: int = 8) -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One driver table; Catalyst prunes the columns at the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()
#: Batches for Python are bounded in bytes: rows of whole texts may be long. A session's own setting stands.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once: they need not find it on a path of their own. Bounds their batches."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    home = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="docketry-"))
    with zipfile.ZipFile(where / "docketry_package.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    context.addPyFile(str(where / "docketry_package.zip"))  # Spark serves the file to the executors


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docketry-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def own_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{shared_dir(spark).rstrip('/')}/docketry/{spark.sparkContext.applicationId}"


#: Spark 4.1 and later: a query's shuffle files go when it ends. Before, the name means nothing and they go with the driver's garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, *, free: bool = False) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors, nothing is computed twice.

    The tables stay while the application may read them; `release` deletes them, at the latest when the driver ends.
    free: the write's shuffle files go as soon as it ends, as nothing reads them again; a session's setting is put back.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _ENDINGS:
        _ENDINGS.append(atexit.register(_release_last, spark))
    before = spark.conf.get(FREE_SHUFFLES, "false")
    if free and before != "true":
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if free and before != "true":
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


_ENDINGS: list = []


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application. Call it when results have been read or written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _release_last(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # noqa: BLE001 - the session may be gone, and its folders with it
        pass
