"""Session helpers shared by every part of the library."""

from __future__ import annotations

import atexit
import py_compile
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: weakref.WeakSet[SparkContext] = weakref.WeakSet()
_OWN_SHARED: dict[str, str] = {}
BATCH_BYTES = "4m"
DEFAULT_BATCH_BYTES = (None, "-1", "67108864b")  # a session that never set it


def _source_zip() -> str:
    """A zip of the package: sources, and compiled modules so that no worker compiles them again."""
    folder = Path(tempfile.mkdtemp(prefix="vellum-ship-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "vellum_src.zip", "w") as z:
        for f in sorted((ROOT / "vellum").rglob("*.py")):
            name = f.relative_to(ROOT)
            compiled = py_compile.compile(str(f), str(folder / "m.pyc"), doraise=True, invalidation_mode=py_compile.PycInvalidationMode.UNCHECKED_HASH)
            z.write(compiled, name.with_suffix(".pyc").as_posix())
            z.write(f, name.as_posix())
    return str(folder / "vellum_src.zip")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once an application), and keep Arrow batches small.

    Texts vary from a word to megabytes, so batches are bounded by bytes
    (BATCH_BYTES), not by rows alone, unless the session has a bound of its own.
    A zip of the sources goes out through Spark's file server whatever the
    driver's own path or PYTHONPATH says, since neither tells what JVMs that
    already run, or executors on other machines, can import.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in DEFAULT_BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if spark.sparkContext not in _SHIPPED:
        spark.sparkContext.addPyFile(_source_zip())
        _SHIPPED.add(spark.sparkContext)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master without the setting (tests, a laptop) gets a folder of
    our own, which is removed at exit; on a cluster executors would each write
    to a disk of theirs and rows would be missing without notice.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_SHARED:
        own = tempfile.mkdtemp(prefix="spark-vellum-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN_SHARED[app] = f"file://{own}"
    return _OWN_SHARED[app]


def scratch_root(spark: SparkSession) -> str:
    """Where this application's intermediate tables and files lie."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Remove the intermediate tables and files of this application; results that were not written elsewhere go with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This ends the lineage, so a lost executor costs a re-read and no
    recomputation, and a result with several consumers is computed once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
