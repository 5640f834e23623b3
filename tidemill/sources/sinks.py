"""Writing results: appends, fan-out, databases, object stores, views."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators.cdc import latest_per_key

# Sink connector names and the Spark data source that serves each.
CONNECTORS = {
    "jdbc-sink": "jdbc",
    "s3-sink": "parquet",
    "gcs-sink": "parquet",
    "snowflake-sink": "snowflake",
    "bigquery-sink": "bigquery",
    "elasticsearch-sink": "org.elasticsearch.spark.sql",
}


def to_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as JSON messages, with the record key when one is named."""
    columns = [F.to_json(F.struct(*df.columns)).alias("value")]
    if key:
        columns.insert(0, F.col(key).cast("string").alias("key"))
    return df.select(*columns)


def partitioned(df: DataFrame, partitions: int, key: str | None = None) -> DataFrame:
    """Output partition count, rows of one key together."""
    return df.repartition(partitions, key) if key else df.repartition(partitions)


def append(df: DataFrame, fmt: str, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Append a stream to files; runs until the input known now is used up."""
    return (
        df.writeStream.format(fmt)
        .outputMode("append")
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def append_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Append a stream to a topic as JSON; ``interval`` sets the time between checkpoints."""
    writer = (
        to_messages(df, key)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(processingTime=interval) if interval else writer).start()


def with_time_folders(df: DataFrame, ts: str) -> DataFrame:
    """Adds year, month, day and hour, the folder levels of an object-store sink."""
    at = F.col(ts)
    return df.select(
        "*",
        F.date_format(at, "yyyy").alias("year"),
        F.date_format(at, "MM").alias("month"),
        F.date_format(at, "dd").alias("day"),
        F.date_format(at, "HH").alias("hour"),
    )


def write_time_partitioned(df: DataFrame, ts: str, path: str) -> None:
    """Parquet in year/month/day/hour folders.

    Rows are gathered by folder with a rebalance, which adaptive execution
    splits where an hour is large and merges where hours are small.
    """
    folders = ["year", "month", "day", "hour"]
    rows = with_time_folders(df, ts).hint("rebalance", *folders)
    rows.write.mode("overwrite").partitionBy(*folders).parquet(path)


def write_connector(df: DataFrame, connector: str, config: Mapping[str, str], mode: str = "append") -> None:
    """A batch through the named connector; its data source must be on the class path."""
    if connector not in CONNECTORS:
        raise ValueError(f"unknown connector {connector}")
    df.write.format(CONNECTORS[connector]).options(**config).mode(mode).save()


_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")


def _named(*names: str) -> None:
    for name in names:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a plain name: {name!r}")


def jdbc_stage(url: str, **options: str) -> Callable[[DataFrame, str], None]:
    """Writes a table of a database through JDBC, from the executors."""

    def stage(rows: DataFrame, table: str) -> None:
        rows.write.jdbc(url, table, mode="overwrite", properties=dict(options))

    return stage


def jdbc_batches(url: str, table: str, **options: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends to a database."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.jdbc(url, table, mode="append", properties=dict(options))

    return write


def upsert_batches(
    connect: Callable[[], Any],
    stage: Callable[[DataFrame, str], None],
    table: str,
    pk: Sequence[str],
    version: Sequence[str],
    stream: str,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges every batch into a database table, once.

    The newest row per key of the batch is staged under the batch's own number,
    by the executors. Then, in one transaction of the connection that
    ``connect`` opens (DB-API 2.0), the batch is entered in the ledger
    ``<table>_ledger`` and the staged rows are merged: a batch that is repeated
    after a failure finds itself entered and changes nothing, and one that failed
    on the way left neither. The ledger's key is the stream's name with the
    batch's number.
    """
    _named(table, *pk, *version, stream)

    def write(batch: DataFrame, batch_id: int) -> None:
        staging, ledger = f"{table}_staging_{stream}_{batch_id}", f"{table}_ledger"
        columns = batch.columns
        _named(*columns)
        connection = connect()
        try:
            run = connection.cursor().execute
            run(f"CREATE TABLE IF NOT EXISTS {ledger} (stream VARCHAR(200) NOT NULL, batch_id BIGINT NOT NULL, PRIMARY KEY (stream, batch_id))")
            connection.commit()
            seen = connection.cursor()
            seen.execute(f"SELECT count(*) FROM {ledger} WHERE stream = '{stream}' AND batch_id = {int(batch_id)}")
            if seen.fetchone()[0]:
                return
            stage(latest_per_key(batch, list(pk), list(version)), staging)
            run("BEGIN")
            run(f"INSERT INTO {ledger} (stream, batch_id) VALUES ('{stream}', {int(batch_id)})")  # a second writer fails here, on the key
            run(merge_statement(table, staging, pk, version, columns))
            connection.commit()
            run(f"DROP TABLE IF EXISTS {staging}")
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    return write


def merge_statement(table: str, staging: str, pk: Sequence[str], version: Sequence[str], columns: Sequence[str]) -> str:
    """The upsert of staged rows; a row that is older than the one in the table changes nothing."""
    on = " AND ".join(f"t.{k} = s.{k}" for k in pk)
    sets = ", ".join(f"{c} = s.{c}" for c in columns if c not in pk)
    names = ", ".join(columns)
    values = ", ".join(f"s.{c}" for c in columns)
    # Newer, or as new: (a, b) >= (c, d) spelt out, which every dialect reads.
    newer = " OR ".join(
        "(" + " AND ".join([*(f"s.{e} = t.{e}" for e in version[:i]), f"s.{v} {'>=' if i == len(version) - 1 else '>'} t.{v}"]) + ")" for i, v in enumerate(version)
    )
    matched = f"WHEN MATCHED AND ({newer}) THEN" if version else "WHEN MATCHED THEN"
    return f"MERGE INTO {table} t USING {staging} s ON {on} {matched} UPDATE SET {sets} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"


def upsert(current: DataFrame, changes: DataFrame, pk: Sequence[str], version: Sequence[str]) -> DataFrame:
    """A table after applying changes: the newest row per key of both."""
    return latest_per_key(current.unionByName(changes), list(pk), list(version))


def fan_out(outputs: Mapping[str, Callable[[DataFrame], DataFrame]], write: Callable[[DataFrame, str, int], None]):
    """A ``foreachBatch`` function that derives several outputs from one batch.

    The batch is kept while the outputs are written, so the source is read once.
    ``write`` gets the batch number, which makes a repeated batch recognisable.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, model in outputs.items():
                write(model(batch), name, batch_id)
        finally:
            batch.unpersist()

    return run


def union_sources(*frames: DataFrame) -> DataFrame:
    """Several upstream tables into one sink; columns a table lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def virtual_view(df: DataFrame, alias: str, where: str | None = None) -> DataFrame:
    """A named view, filtered on read; the filter is pushed into the scan of whoever reads it."""
    view = df.where(where) if where else df
    view.createOrReplaceTempView(alias)
    return view
