"""Scoring streams with a fitted model, and shares over event-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefero.operators.mnl import probabilities
from prefero.operators.spec import Design


def score_stream(stream: DataFrame, design: Design, beta: Sequence[float], available: list[Column] | None = None) -> DataFrame:
    """A stateless map: the logit probability of each alternative for every arriving row."""
    return stream.select("*", *[p.alias(f"p_{a}") for p, a in zip(probabilities(design.utilities(beta), available), design.alternatives, strict=True)])


def windowed_shares(scored: DataFrame, time: str, alternatives: Sequence[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean predicted share of each alternative by window of event time; rows later than ``late`` are left out, as a watermark does."""
    timed = scored.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return timed.groupBy(F.window("_time", window)).agg(F.count("*").alias("n"), *[F.avg(f"p_{a}").alias(f"share_{a}") for a in alternatives])
