"""Reading messages: decoding payloads, bounded samples, generators."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kafka_options(servers: str, topic: str, latest: bool = False, **extra: str) -> dict[str, str]:
    """Options for ``format("kafka")``: from the earliest offset, or the latest for monitors."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "latest" if latest else "earliest",
        **extra,
    }


def kafka_stream(spark: SparkSession, servers: str, topic: str, latest: bool = False, **extra: str) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, latest, **extra)).load()


def kafka_batch(spark: SparkSession, servers: str, topic: str, ending: str = "latest", **extra: str) -> DataFrame:
    """A bounded read of what the topic holds now, or up to given offsets."""
    options = kafka_options(servers, topic, False, endingOffsets=ending, **extra)
    return spark.read.format("kafka").options(**options).load()


def skip_backlog(df: DataFrame, since: str | None = None) -> DataFrame:
    """A file stream (or table) without the files that were there before ``since``, by default before now.

    The counterpart of ``latest`` for folders: what a monitor that starts today
    reads. Files are left out by their time of change, before they are opened.
    """
    start = F.lit(since).cast("timestamp") if since else F.lit(datetime.now(timezone.utc))
    return df.where(F.col("_metadata.file_modification_time") > start)


def parse_json_records(
    df: DataFrame,
    schema: str | T.StructType | None = None,
    value: str = "value",
    event_time: str | None = None,
    proctime: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Payloads to columns, on a batch or a stream.

    Without a schema there is one column, ``_raw``. A missing or unreadable
    field is null, and so is a whole unreadable message. The event-time column
    is read as a timestamp, ``proctime`` adds the time of processing.
    """
    text = F.col(value).cast("string")
    if schema is None:
        out = df.select(*keep, text.alias("_raw"))
    else:
        fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        # Fields arrive as text and are cast one by one, so that one mistyped
        # field does not take its neighbours with it.
        scalar = (T.StructType, T.ArrayType, T.MapType, T.StringType)
        wire = T.StructType(
            [T.StructField(f.name, f.dataType if isinstance(f.dataType, scalar) else T.StringType()) for f in fields]
        )
        decoded = df.select(*keep, F.from_json(text, wire, {"mode": "PERMISSIVE"}).alias("_r"))

        def typed(f: T.StructField) -> Column:
            c = F.col("_r").getField(f.name)
            if f.name == event_time:
                return c.cast("string").try_cast("timestamp_ntz").alias(f.name)
            return c.alias(f.name) if isinstance(f.dataType, scalar) else c.try_cast(f.dataType).alias(f.name)

        out = decoded.select(*keep, *[typed(f) for f in fields])
    return out.withColumn(proctime, F.current_timestamp()) if proctime else out


def text_columns(df: DataFrame, columns: list[str], value: str = "value") -> DataFrame:
    """The monitor's view of a topic: every named field as text."""
    return parse_json_records(df, T.StructType([T.StructField(c, T.StringType()) for c in columns]), value)


def decode_payload(df: DataFrame, fmt: str, schema: str, value: str = "value", **options: str) -> DataFrame:
    """Payloads in the declared format. Avro and Protobuf need their Spark packages on the class path."""
    if fmt == "json":
        return parse_json_records(df, schema, value)
    if fmt == "avro":
        from pyspark.sql.avro.functions import from_avro

        return df.select(from_avro(F.col(value), schema, options).alias("_r")).select("_r.*")
    if fmt == "protobuf":
        from pyspark.sql.protobuf.functions import from_protobuf

        message, descriptor = options.pop("message"), options.pop("descriptor", None)
        return df.select(from_protobuf(F.col(value), message, descriptor, options).alias("_r")).select("_r.*")
    raise ValueError(f"unknown payload format {fmt}")


def sample_records(df: DataFrame, order: list[str], n: int = 100, value: str | None = None) -> DataFrame:
    """The first ``n`` messages with a payload, in replayable order (each task keeps ``n``)."""
    present = df.where(F.col(value).isNotNull()) if value else df
    return present.orderBy(*order).limit(n)


def generate_rows(df: DataFrame, kinds: list[str], seed: int) -> DataFrame:
    """Random but typed columns next to each row: amount, quantity, identifier and a pick from a list."""
    pick = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.floor(F.rand(seed) * len(kinds)).cast("int") + 1)
    return df.select(
        "*",
        F.rand(seed + 1).alias("amount"),
        F.floor(F.rand(seed + 2) * 100).cast("int").alias("quantity"),
        F.uuid().alias("id"),
        pick.alias("kind"),
    )


def rate_stream(spark: SparkSession, rows_per_second: int, kinds: list[str], seed: int = 0) -> DataFrame:
    """An endless stream of generated rows."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return generate_rows(rate, kinds, seed)
