"""A cube of grids from a stream of files: a table of cells with a folder per time, and a window of its latest times.

A micro-batch brings cells of some times. Those times' folders are written anew, with what they had and what has come,
and the others are not touched. The same batch again gives the same folders, so a batch that is replayed after a failure,
before or behind its write, changes nothing: each file counts once, as the checkpoint tells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrelake.sources.tables import written

CELL = ["t", "i", "j"]


def _known(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def merge(batch: DataFrame, path: str) -> None:
    """Writes the cells (t, i, j, ...) of a batch to their times' folders. A cell that is there already takes the batch's
    values; of a batch's own rows for one cell the largest counts. Columns that the table lacks are null for its old cells."""
    values = [c for c in batch.columns if c not in CELL]
    best = batch.groupBy(*CELL).agg(F.max(F.struct(*values)).alias("_v")).select(*CELL, "_v.*")
    old = _known(batch.sparkSession, path)
    if old is not None:
        kept = old.withColumn("t", F.col("t").cast(batch.schema["t"].dataType)).join(batch.select("t").distinct(), "t", "left_semi").join(best.select(*CELL), CELL, "left_anti")
        best = best.unionByName(kept, allowMissingColumns=True)
    whole = written(best)  # before the folders that it reads are written anew
    whole.repartition("t").sortWithinPartitions("t", "j", "i").write.partitionBy("t").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").parquet(path)


def ingest(spark: SparkSession, source: str, path: str, checkpoint: str, schema, each: Callable[[DataFrame, int], None] | None = None, files: int = 100) -> None:
    """Takes all files of `source` that the checkpoint does not know yet, `files` a micro-batch, into the table at `path`."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    each = each or (lambda batch, _: merge(batch, path))
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def window(spark: SparkSession, path: str, times: int, until: int | None = None) -> DataFrame:
    """The cells of the latest `times` times (up to `until`): a choice of folders, so that the rest is not read."""
    cube = spark.read.parquet(path)
    if until is not None:
        cube = cube.where(F.col("t") <= until)
    latest = [r["t"] for r in cube.select("t").distinct().orderBy(F.desc("t")).limit(times).collect()]
    return cube.where(F.col("t") >= min(latest)) if latest else cube
