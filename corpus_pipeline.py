"""Documents to token files, in stages that each work on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``docs``. ``run`` writes each stage's result as
Parquet to the shared folder and reads it back for the next.

Empty tables pass through every stage. Rows without text or id are judged like
the operators say; further columns of the documents are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontaminate, jaccard, mixing, quality, wavelet
from tidemill.llm.common import settled
from tidemill.tables import Tables

TOKENIZER = "byte_bpe_50k.json"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, Tables(spark, sf_dir).labels)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id."""
    return jaccard.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate.clean(docs, Tables(spark, sf_dir).benchmark)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that it takes in part is cut to as many words."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the token files and a checksum of its ids, read back from them."""
    return wavelet.read_documents(wavelet.write_shards(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("token_files", token_files),
]

#: No SQL: the classifier, the alignment and the tokenizer have none. Tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = Tables(spark, sf_dir).documents
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
