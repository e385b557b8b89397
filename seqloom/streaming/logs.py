"""A command log as a stream, and all-by-all pairs kept up to date by batches of new records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.pairs import incremental_pairs
from seqloom.sources.readers import history_lines


def history_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """``(pid, ts, command, month)`` of history files as they appear in a folder."""
    t = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).select("value")
    return history_lines(t, F.lit(""))


def newest_commands(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each command of a process once within the lateness that is waited for."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["pid", "command"])


def hourly_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Commands by hour, once an hour is over and the lateness has passed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "n")


def refresh_pairs(spark: SparkSession, known: str, pairs: str, id_: str = "id"):
    """A ``foreachBatch`` function: pairs of a batch's new records with each other and with the known ones are appended.

    A batch that is given again after a failure overwrites its own part, so nothing is counted twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        new = batch.select(id_).distinct()
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(known)
        begun = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        old = spark.read.parquet(known).where(F.col("batch") < number).select(id_) if begun else new.limit(0)
        new = new.join(old, id_, "left_anti")
        incremental_pairs(old, new, id_).write.mode("overwrite").parquet(f"{pairs}/batch={number}")
        new.write.mode("overwrite").parquet(f"{known}/batch={number}")

    return run
