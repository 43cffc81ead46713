"""The corpus pipeline: documents, stage by stage, to a training mix.

Each stage reads what the stage before wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoplane.llm import decontam, lines, mixing, similar, toxicity
from geoplane.llm.common import bound_batches, fresh, shared_dir, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity is 0.5 or more, by the model that the labelled tables give."""
    bound_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.learned(spark, sf_dir))


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that over a tenth of a source's documents hold; a source is a site here. n_chars follows the text."""
    bound_batches(spark)
    before, dropped = fresh("_lines", docs), fresh("_dropped", docs)
    out = lines.drop_boilerplate(docs, "source", "text", counts=(before, dropped))
    size = F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", size).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group that links join: a Jaccard similarity of five-word shingles of 0.8 or more."""
    bound_batches(spark)
    return similar.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold ten words in a row of a benchmark item, or the whole of a shorter item."""
    bound_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: sources weigh 5, 2, 1, repeating."""
    bound_batches(spark)
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxic),
    ("line dedup", boilerplate),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixture),
]
#: Toxicity is learned, and mixing draws: SQL expresses neither. tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
