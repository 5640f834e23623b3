"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import string
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import shared_dir

#: A set of keys up to this many bytes is sent to every executor; a larger one is joined by a shuffle.
SMALL_BYTES = 64 << 20


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage, so that an executor lost later costs nothing before this
    point. The files go when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tidemill-llm/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, the size of every explicit repartition here."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept_keys(df: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``key`` is (or, with ``left_anti``, is not) in ``keys``.

    The keys are 64-bit numbers. They are sent to the executors only if their
    count proves them small; otherwise both sides are shuffled.
    """
    small = keys.count() * 16 <= SMALL_BYTES
    return df.join(F.broadcast(keys) if small else keys, key, how)


def _give_back() -> None:
    """Freed memory back to the system, where the C library knows how."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition, with what it freed given back at its end.

    Python workers live on from task to task, and what one stage needed for a
    moment would otherwise stand against the memory of the next.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would change other letters as well)."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def sorted_runs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Rows sorted by ``keys`` (numbers) as frames of whole runs, with the runs' bounds.

    A run that goes on in the next batch is held back, so a run is never cut.
    """
    held: list[pd.DataFrame] = []

    def runs(frame: pd.DataFrame, starts: np.ndarray) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
        return frame, list(zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True))

    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy() for k in keys]
        change = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        starts = np.concatenate(([0], np.flatnonzero(change) + 1))
        goes_on = bool(held) and all(held[-1][k].iat[-1] == c[0] for k, c in zip(keys, columns, strict=True))
        if held and not goes_on:
            frame = pd.concat(held, ignore_index=True)
            held = []
            yield runs(frame, np.array([0]))
        last = int(starts[-1])
        if last:
            frame = pd.concat([*held, batch.iloc[:last]], ignore_index=True) if held else batch.iloc[:last].reset_index(drop=True)
            before = len(frame) - last
            held = []
            yield runs(frame, np.concatenate(([0], starts[1:-1] + before)))
        held.append(batch.iloc[last:])
    if held:
        yield runs(pd.concat(held, ignore_index=True), np.array([0]))
