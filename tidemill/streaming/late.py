"""Late rows of a stream as a side output.

Each micro-batch is an ordinary table: its rows are put in the order of their
source partition's offsets by ``Ordered``, which spills and cuts a hot partition,
and each row is held against the largest time before it. What a batch hands to the
next is one row a source partition, the largest time so far, written beside the
results under the batch's number. A repeated batch overwrites its own folders and
starts from the same progress, so it marks the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.ordered import DEFAULT_SKEW, Ordered, Skew
from tidemill.streaming.run import finish


def _progress(batch: DataFrame, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """What the batch before handed on; nothing before the first."""
    spark = batch.sparkSession
    folder = f"{path}/progress/batch={batch_id - 1}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(folder) if known else spark.createDataFrame([], schema)


def late_splitter(partition: str, ts: str, offset: str, delay_ms: int, path: str, skew: Skew = DEFAULT_SKEW) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rows on time go to ``path/rows``, late ones to ``path/late``.

    A row is late if it is more than ``delay_ms`` behind the largest time that
    its source partition showed before it. A null time is never late.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = T.StructType([T.StructField("_part", batch.schema[partition].dataType), T.StructField("_top", batch.schema[ts].dataType)])
        before = _progress(batch, path, batch_id, kept)
        batch = batch.persist()  # read for the marks, twice, and for the progress
        try:
            seen = Ordered(batch, [partition], offset, skew=skew).running({"_run": ("max", F.col(ts))}, current=False)
            seen = seen.join(before, F.col(partition).eqNullSafe(F.col("_part")), "left")
            behind = F.greatest("_run", "_top") - F.expr(f"interval {delay_ms} milliseconds")
            marked = seen.withColumn("_late", F.coalesce(F.col(ts) < behind, F.lit(False)))
            for name, rows in (("rows", ~F.col("_late")), ("late", F.col("_late"))):
                marked.where(rows).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
            tops = batch.select(F.col(partition).alias("_part"), F.col(ts).alias("_top")).unionByName(before)
            tops.groupBy("_part").agg(F.max("_top").alias("_top")).write.mode("overwrite").parquet(f"{path}/progress/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def split_to(df: DataFrame, partition: str, ts: str, offset: str, delay_ms: int, path: str, timeout: int | None = None, skew: Skew = DEFAULT_SKEW) -> tuple[DataFrame, DataFrame]:
    """Run the split over the input known now: the rows on time, and the late rows."""
    query = (
        df.writeStream.foreachBatch(late_splitter(partition, ts, offset, delay_ms, path, skew))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    finish(query, timeout)
    read = df.sparkSession.read.schema(df.schema)
    return read.parquet(f"{path}/rows"), read.parquet(f"{path}/late")
