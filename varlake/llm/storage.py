"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, on one machine only, a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="varlake-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


_folders: dict[str, list[str]] = {}  # what is staged, by application
_tables: dict[str, list[str]] = {}


def _note(spark: SparkSession, kind: dict[str, list[str]], name: str) -> None:
    kind.setdefault(spark.sparkContext.applicationId, []).append(name)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which release() deletes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _note(spark, _folders, path)
    return path


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so that lost executors cost nothing of it."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, keys: list[str], buckets: int, name: str) -> DataFrame:
    """As staged(), bucketed and sorted by keys: later joins and groupings on them don't shuffle this side again."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    _note(spark, _folders, path)
    _note(spark, _tables, table)
    writer = df.repartition(buckets, *keys).write.option("path", path).option("compression", "zstd")
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


def restored_by(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int) -> DataFrame:
    """A table that staged_by() has written, in a session that may not know it."""
    table = f"restored_{uuid.uuid4().hex}"
    by = ", ".join(keys)
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Deletes all that this application has staged. Results that aren't written yet, and runs of lines that are to be kept, need it: call this after them."""
    app = spark.sparkContext.applicationId
    for table in _tables.pop(app, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for folder in _folders.pop(app, []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def default_parallelism(spark: SparkSession) -> int:
    """Partitions that a shuffle makes in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
