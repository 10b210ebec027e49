"""The corpus pipeline: documents through quality, near duplicates, leaks, secrets and mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefero.llm import common, decontaminate, mixing, order_minhash, quality, secrets_scan

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    score = common.unused("_quality", docs)
    # a batch of rows is held by JVM and worker at once, so its bytes are bounded while Python reads whole texts
    with common.small_batches(spark):
        scored = quality.with_quality(docs, common.table(spark, sf_dir, "labels"), score)
        return common.staged(scored.where(f"{score} >= 0.5").drop(score), "quality")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of least id."""
    return order_minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a span with the benchmark go."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    with common.small_batches(spark):
        return common.staged(secrets_scan.redact(docs), "secrets")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Classifier, near duplicates and alignment are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written once and read again; what a stage read goes when it is written."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        found = found if common.is_staged(found) else common.staged(found, name)
        common.discard(docs)
        docs = found
    return docs
