"""Corpus pipeline: from raw ``documents`` to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. A
stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe import encode_documents
from lectern.llm.common import table, written
from lectern.llm.decontaminate import decontaminate
from lectern.llm.jaccard import drop_near_duplicates
from lectern.llm.lines import drop_boilerplate
from lectern.llm.quality import keep_good

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Rows are judged by their text alone: null and repeated ids like others, a
    null text as the empty one."""
    return keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, but for one document's; documents stay, whatever is left of them, and null texts stay
    null. Null sources count for no site."""
    return _sized(drop_boilerplate(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles link at a Jaccard of 0.8, the least id stays.

    Rows are judged by their own text: of rows that repeat id and text one stays, and a row stays if another of its id goes.
    One without an id stays only where its group has no id; rows without words stay.
    """
    return drop_near_duplicates(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that benchmark items share go; so do documents that are benchmark text for more than half of their words. Null
    texts stay null; repeated and null ids are matched each for itself."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), columns=("clean_text", "drop"), keep=("lang", "source"))
    return _sized(found.where("not drop").withColumnRenamed("clean_text", "text"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of what they decode to, for each row; a null text has no ids."""
    return encode_documents(docs, columns=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe),
]

#: A trained classifier is no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{i}")
    return docs
