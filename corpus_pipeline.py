"""The corpus pipeline: five stages from raw documents to a training mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.llm.common import written
from spindrel.llm.decontaminate import decontaminate
from spindrel.llm.line_dedup import line_dedup
from spindrel.llm.mixing import mixed
from spindrel.llm.quality import accept
from spindrel.llm.simhash import near_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from those that reached this stage and have labels.

    Null and empty texts, and those without words, are rejected; rows alike, and ties in score, are decided alike."""
    return accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go from all but their first document; documents left without a line go.
    n_chars, where docs has it, is that of the shortened text.

    Null and empty texts stay as they are. Rows that repeat an id with the same text are one document and are shortened alike."""
    out = line_dedup(docs, drop_emptied=True).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id (null ids last).

    Texts without words are in no group and stay. Of rows that repeat an id with the same text (or both without one) one stays."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a test item go.

    Null and empty texts leak nothing, and null items aren't leaked. Rows alike go or stay together."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample of every source, by its target weight.

    Null and empty texts count as documents without tokens; a null source is a source; a source without tokens gives
    nothing. Rows that repeat an id with the same text go or stay together."""
    return mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", benchmark),
    ("mixing", mix),
]

#: The classifier is trained; SQL can't express it. tests/llm/test_pipeline.py holds every stage, and the whole, against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
