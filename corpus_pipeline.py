"""A corpus pipeline: language, quality, near duplicates, mixing, packing.

Each stage works on all that its predecessor kept, is written as Parquet and read
back as the documents of the next one. All but the last return documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import language
from driftline.llm.entries import vocabulary
from driftline.llm.mixing import mixed_documents
from driftline.llm.packing import pack
from driftline.llm.quality import quality_rules
from driftline.llm.simhash import drop_near_duplicates
from driftline.session import table, written

#: A document whose language is less likely than this is rejected.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language or in none of the learned ones, and write the predicted one into ``lang``."""
    path = vocabulary("piece_bpe_32k.model")
    model = language.fit(docs.where(~language.held_out("doc_id")), path)
    carried = [c for c in docs.columns if c != "doc_id"]
    known = written(language.predict(docs, model, carry=tuple(carried)), "predicted")
    kept = known.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & language.plausible(known))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject."""
    trusted = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return quality_rules(docs, trusted).where("kept").select(*docs.columns)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that with the smallest id."""
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take of each source what its target asks for; a document can come once, in part, or twice."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all tokens into sequences: a row for each piece of a document."""
    return pack(docs, vocabulary()).drop("ids")


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Hashes, fitted models and tokenizers are beyond SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
