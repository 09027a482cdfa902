"""Helpers that the training-data operators share: the shared folder, tables of a call, row ids."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import on_workers

#: Prefix of columns that operators add next to a caller's own.
OWN = "__fl_"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder under /tmp/checkpoints only where it is unset on a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """The tables that one call of an operator writes, in a folder of its own in the shared one.

    Leaving the context deletes all but what keep() has written; that stays as long as the caller's result needs
    it, until released(). Nothing is shared between calls, so they may run side by side.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.kept: list[str] = []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        _delete(self.spark, f"{self.path}/own")

    def written(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """df as a Parquet table: computed once, and safe when executors are lost. by: columns with a folder for each value."""
        return self._write(df, f"{self.path}/own/{name}-{uuid.uuid4().hex[:8]}", by)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """written(), for what the result reads."""
        self.kept.append(f"{self.path}/kept-{name}-{uuid.uuid4().hex[:8]}")
        return self._write(df, self.kept[-1], ())

    def _write(self, df: DataFrame, path: str, by: tuple[str, ...]) -> DataFrame:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        out._fl_path = path
        return out

    def dropped(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in tables:
            _delete(self.spark, df._fl_path)

    def dropped_kinds(self, df: DataFrame, *kinds: int) -> None:
        """Deletes the folders of some values of kind, by which a table was written."""
        for kind in kinds:
            _delete(self.spark, f"{df._fl_path}/kind={kind}")

    def result(self, df: DataFrame) -> DataFrame:
        """df, marked with the tables that it reads."""
        df._fl_kept = [*self.kept, *getattr(df, "_fl_kept", [])]
        return df


def released(result: DataFrame) -> None:
    """Deletes the tables behind an operator's result; it can't be read any more."""
    for path in getattr(result, "_fl_kept", []):
        _delete(result.sparkSession, path)


def settled(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are done: it does soon after the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_id() -> Column:
    """An id for a row, whatever its doc_id; only use it on what is then written."""
    return F.monotonically_increasing_id()


def _plain_scan(df: DataFrame) -> bool:
    """Whether df is files, filtered and projected only, so that every reading finds the same rows in the same places."""
    node = df._jdf.queryExecution().analyzed()
    while node.children().size():
        if node.nodeName() not in ("Project", "Filter", "SubqueryAlias") or not node.deterministic():
            return False
        node = node.children().apply(0)
    return node.nodeName().startswith("LogicalRelation")


def with_row_id(df: DataFrame, tables: Tables, name: str = f"{OWN}rid") -> DataFrame:
    """df with an id for each row that is the same whenever it is read: the place in its file, by a 64-bit hash of the path.

    Where df isn't a plain scan of files it is written first. A column of that name is replaced.
    """
    df = df.drop(name)
    if _plain_scan(df):
        try:
            out = df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))
            out.schema  # noqa: B018
            return out
        except AnalysisException:  # files of a format without row numbers
            pass
    return tables.keep(df.select("*", F.struct(F.lit(0).cast("long").alias("file"), row_id().alias("row")).alias(name)), "rows")


def without(df: DataFrame, rid: str, ids: DataFrame, most: int = 200_000) -> DataFrame:
    """df without the rows of ids, a written table of rid: broadcast where it has most rows or fewer, else by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, rid, "left_anti")
