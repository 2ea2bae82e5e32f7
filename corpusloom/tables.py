"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Rows that a task makes or sorts, about.
ROWS_A_TASK = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; on a local master without one, a temporary folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="corpusloom-tables-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return _OWN["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read again: cuts lineage, and a lost executor costs a re-read."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(rows: int) -> int:
    """Partitions to ask for where a stage makes or sorts so many rows. Spark plans by the bytes
    that come in, and merges partitions by them, but not those whose number is asked for."""
    return max(1, -(-rows // ROWS_A_TASK))


def discard(table: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    jvm = table.sparkSession._jvm
    for file in table.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own, not made yet, in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of scratch() that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
