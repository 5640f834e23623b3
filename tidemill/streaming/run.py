"""Running a streaming query over the input known now."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemill.operators.cdc import latest_per_key
from tidemill.operators.sizes import estimated_bytes

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for a query about to start (``__`` stands for a dot), restored afterwards."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_settings(backend: str = "rocksdb", parallelism: int | None = None) -> dict[str, str]:
    """State backend (``rocksdb`` or ``hashmap``) and number of state partitions."""
    out = {}
    if backend == "rocksdb":
        out["spark__sql__streaming__stateStore__providerClass"] = ROCKSDB
    if parallelism:
        out["spark__sql__shuffle__partitions"] = str(parallelism)
    return out


def state_partitions(batch: DataFrame, bytes_each: int = 64 << 20) -> int:
    """How many state partitions a stream of about this much data needs.

    One per ``bytes_each`` of the optimizer's estimate, at least one per core.
    The number is fixed for the life of a checkpoint, so size it for what the
    stream will hold.
    """
    spark = batch.sparkSession
    return max(spark.sparkContext.defaultParallelism, -(-estimated_bytes(batch) // bytes_each))


def append_to(df: DataFrame, path: str, timeout: int | None = None) -> DataFrame:
    """Run in append mode into parquet files and return what was written.

    Only final results are emitted, so each window appears once. The checkpoint
    lies beside the files; a restart goes on where the query stopped.
    """
    query = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{path}/rows")
    )
    finish(query, timeout)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def update_to(df: DataFrame, path: str, keys: list[str], timeout: int | None = None) -> DataFrame:
    """Run in update mode and return the newest result per key.

    Every batch overwrites its own folder, so a batch that is repeated after a
    failure leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    query = (
        df.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    finish(query, timeout)
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    written = df.sparkSession.read.schema(schema).parquet(f"{path}/rows")
    return latest_per_key(written, keys, ["batch"]).drop("batch")


def finish(query, timeout: int | None) -> None:
    done = query.awaitTermination(timeout) if timeout else (query.awaitTermination() or True)
    if not done:
        query.stop()
        raise TimeoutError(f"the query did not finish in {timeout} s")
