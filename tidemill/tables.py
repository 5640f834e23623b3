"""Declared schemas of the input tables and a loader.

Schemas are declared rather than inferred, so that building a plan reads no
file footers, and so that the same declaration serves batch and streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables:
    """``t.events`` is the batch table; ``t.stream("events")`` the file stream."""

    def __init__(self, spark: SparkSession, folder: str):
        # Event time is UTC throughout: stored timestamps carry no zone.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str, event_time: str | None = None, files_per_batch: int | None = None) -> DataFrame:
        """File stream of one table, a folder of files or a single one; ``event_time`` is cast to the zoned type watermarks need."""
        path = f"{self.folder}/{name}.parquet"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            raise FileNotFoundError(path)
        reader = self.spark.readStream.schema(SCHEMAS[name])
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        if files.getFileStatus(at).isDirectory():
            df = reader.parquet(path)
        else:  # a file stream watches folders
            df = reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)
        return df.withColumn(event_time, F.col(event_time).cast("timestamp")) if event_time else df

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables the text names, registered as temporary views."""
        for name in SCHEMAS:
            if name in text:
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)
