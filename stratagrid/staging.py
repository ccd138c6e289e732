"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. Where that is unset a temporary one, but only if all runs in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="stratagrid-")
    return _OWN_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/stratagrid/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, over: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage.

    ``over``, a table staged before that nothing else reads any more, is removed once the new one stands.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    if over is not None:
        discard(over)
    return out


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that no later plan reads; frames that were not staged are left alone."""
    for df in staged:
        path = _PATHS.pop(df, None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
