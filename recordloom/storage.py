"""Tables that cut lineage, kept in the folder that every executor shares.

``spark.checkpoint.dir`` names that folder.  Where the session has none (tests on a
local master) a temporary folder is made once per session; a cluster without the
setting is an error, because a machine-local folder would lose rows there.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, read from the session's settings."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="recordloom-")
    return _LOCAL[app]


def save(df: DataFrame, name: str, clear: bool = False) -> DataFrame:
    """Write ``df`` once and return a reader of the written rows.

    Later uses read the files, so neither a second use nor a lost executor runs the
    steps before it again.  With ``clear`` the write's shuffle files are removed as soon as it
    has ended; otherwise they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recordloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAR, None)
    if clear:
        spark.conf.set(_CLEAR, "true")
    try:
        df.write.parquet(path)
    finally:
        if clear and before is None:
            spark.conf.unset(_CLEAR)
        elif clear:
            spark.conf.set(_CLEAR, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`save` that no later step reads."""
    path = getattr(df, "_written_path", None)
    if path is None:
        return
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
