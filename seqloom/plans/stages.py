"""Stage tables: written cuts of a long plan in the folder all executors share.

An iterative operator must not let its lineage grow, and must survive the loss of an executor, so
every step is written as Parquet and read back.  The folder is ``spark.checkpoint.dir`` of the
session; where that is unset, a temporary folder is used, and only in local mode.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_PARTITIONS = "spark.sql.shuffle.partitions"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder for stage tables: the session's ``spark.checkpoint.dir``, else a local one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="seqloom-")


class Stages:
    """Writes, counts, reads back and deletes the stage tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str = "stages"):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path, fs = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, where: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame, name: str, partitions: int = 0) -> DataFrame:
        """``df`` as a written table; the shuffle files that made it are freed as soon as it stands.

        Its shuffles have at least ``partitions`` partitions, for a step whose rows are known to be many.
        """
        return self.cut_counted(df, name, partitions=partitions)[0]

    def cut_counted(self, df: DataFrame, name: str, flag: Column | None = None, partitions: int = 0) -> tuple[DataFrame, int]:
        """As :meth:`cut`, with the number of rows (where ``flag`` is true), counted while writing."""
        self._n += 1
        where = f"{self.root}/{self._n:03d}-{name}"
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        before, usual = self.spark.conf.get(_CLEANUP, None), self.spark.conf.get(_PARTITIONS)
        try:
            if before is not None:
                self.spark.conf.set(_CLEANUP, "true")
            if partitions > int(usual):
                self.spark.conf.set(_PARTITIONS, str(partitions))
            df.observe(seen, F.count(F.lit(1) if flag is None else F.when(flag, 1)).alias("n")).write.option("compression", "zstd").parquet(where)
        finally:
            if before is not None:
                self.spark.conf.set(_CLEANUP, before)
            if partitions > int(usual):
                self.spark.conf.set(_PARTITIONS, usual)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._stage_path = where
        return out, int(seen.get["n"])

    def release(self) -> None:
        """Let the driver forget what finished steps hold: their plans, broadcasts and shuffles.

        A long loop makes hundreds of plans; without this they stay until the driver's heap is full.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete stage tables that nothing reads any more; other tables are left alone."""
        for t in tables:
            where = getattr(t, "_stage_path", None)
            if where and where.startswith(self.root):
                path, fs = self._fs(where)
                fs.delete(path, True)


class Scratch:
    """A folder of its own in the shared one, for a ``with`` block: gone at its end, but for what is saved."""

    def __init__(self, spark: SparkSession, name: str = "scratch"):
        self._stages = Stages(spark, name)
        self.path = self._stages.root

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path, fs = self._stages._fs(self.path)
        fs.delete(path, True)

    def file(self, name: str) -> str:
        """The place of a file or table in the folder."""
        return f"{self.path}/{name}"

    def save(self, name: str, target: str) -> None:
        """Moves a file or table of the folder to a place that stays; an existing one is not replaced."""
        source, fs = self._stages._fs(self.file(name))
        to, _ = self._stages._fs(target)
        if fs.exists(to):
            raise FileExistsError(target)
        fs.mkdirs(to.getParent())
        if not fs.rename(source, to):
            raise OSError(f"{name} cannot be moved to {target}")
