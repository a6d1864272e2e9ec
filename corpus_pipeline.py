"""From documents to training sequences: five stages, each a DataFrame in and a DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import line_dedup, near_dedup, packing, site_quality, toxicity
from lamina.llm.common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of under 0.5."""
    return docs.where(~toxicity.rejected(toxicity.trained(docs, read(spark, sf_dir, "labels"))))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return site_quality.kept(docs, site_quality.document_model(docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their later repeated runs of lines; n_chars follows the text."""
    out = line_dedup.deduplicated(docs)
    return out.select(*[F.when(F.col("lines_lost") > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.packed(docs, packing.tokenizer_spec())


STAGES = [("toxicity", drop_toxic), ("quality_classifier", drop_poor), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies), ("packing", pack)]

#: SQL can't express the models; the stages are tested against plain Python on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
