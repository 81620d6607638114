"""From raw documents to a mix: quality, line dedup, near-dedup, decontamination, mixing.

Every stage works on all that the stage before kept, and its decisions take effect. All but the last
return the columns of ``documents``; the last returns doc_id, size, source_size, target and taken.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewarden.llm import decontaminate, linededup, mixing, neardup, quality
from tidewarden.llm.common import fold, staged, table

#: a document stays when its quality score is at least this
KEEP_FROM = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), lambda d: fold(d, 4) != 2)

    def accepted(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(b.column("text").to_pylist()) >= KEEP_FROM))

    return docs.mapInArrow(accepted, docs.schema)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occurred before; n_chars follows the text."""
    left = linededup.drop_repeats(docs)
    if "n_chars" in left.columns:
        left = left.withColumn("n_chars", F.length("text").cast(left.schema["n_chars"].dataType))
    return left.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.deduplicate(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: classifier, edit join and seeded blocks have no SQL form; tests hold the stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
