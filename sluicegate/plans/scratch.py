"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names.

A multi-pass job writes its intermediate results as parquet in shared storage. That cuts
the lineage and outlives lost executors. They are deleted when the application ends. Only a local
session without the setting gets a temporary folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_dirs.setdefault(app, tempfile.mkdtemp(prefix="sluicegate-"))
    return f"{root.rstrip('/')}/sluicegate/{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def with_settings(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session of the same application with settings of its own; the caller's stay as they are."""
    other = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(name, spark.conf.get(name))
    for name, value in settings.items():
        other.conf.set(name, value)
    return other


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back."""
    path = new_path(df.sparkSession, name)
    _delete_at_end(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """Like ``materialise``, but bucketed by ``key``: grouping by it later needs no shuffle."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _delete_at_end(spark, path)
    table = f"sluicegate_{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key)
     .option("path", path).saveAsTable(table))
    return spark.table(table)


class Scratch:
    """Scratch tables of one job under short names, deleted when they are no longer needed.

    Whatever is left is deleted when the application ends.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job = spark, job
        self._paths: dict[str, str] = {}

    def path(self, name: str) -> str:
        """A new folder that this job owns."""
        self.drop(name)
        self._paths[name] = path = new_path(self.spark, f"{self.job}-{name}")
        _delete_at_end(self.spark, path)
        return path

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back; an older table of that name is deleted."""
        older = self._paths.pop(name, None)
        path = self.path(name)
        df.write.parquet(path)
        self._delete(older)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self._paths.pop(name, None))

    def free_shuffles(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str | None) -> None:
        if path:
            delete_folder(self.spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours; nothing happens if there is none."""
    where, files = _hadoop(spark, path)
    files.delete(where, True)


def folders(spark: SparkSession, path: str, holding: str) -> list[str]:
    """Names of the folders in ``path`` that have a file of the name ``holding``."""
    where, files = _hadoop(spark, path)
    if not files.exists(where):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(where) if entry.isDirectory()]
    return [name for name in names if files.exists(_hadoop(spark, f"{path}/{name}/{holding}")[0])]


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete the folder when the application ends."""
    where, files = _hadoop(spark, path)
    files.deleteOnExit(where)


def drop_scratch_tables(spark: SparkSession) -> int:
    """Forget the catalogue entries of bucketed scratch tables; call it when results are saved."""
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("sluicegate_")]
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    return len(names)
