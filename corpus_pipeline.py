"""From raw documents to packed training sequences: five stages, each on all rows its predecessor kept."""

from pyspark.sql import DataFrame, SparkSession

from cinderline.llm.common import stored, table
from cinderline.llm.lines import drop_similar_lines
from cinderline.llm.mixing import mix_documents
from cinderline.llm.packing import pack_documents
from cinderline.llm.quality import keep_good
from cinderline.llm.simhash import keep_one_per_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the trees reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines after a similar one go, and documents left without a word."""
    return drop_similar_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest ``doc_id``."""
    return keep_one_per_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, by the sources' target weights: a row per copy taken, the last one cut at its budget."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in few sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Trees, similarity joins and packing are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
