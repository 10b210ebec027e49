"""Counterfactual scenarios: overrides of columns, shares under each, and comparisons."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefero.operators.spec import given

Overrides = Mapping[str, object]
Scenarios = Mapping[str, Overrides]


def scenarios_of(scenarios: Scenarios | pd.DataFrame) -> dict[str, dict[str, object]]:
    """Scenarios as a dict; a frame has one scenario a row."""
    if isinstance(scenarios, pd.DataFrame):
        return {str(i): dict(row) for i, row in scenarios.iterrows()}
    return {k: dict(v) for k, v in scenarios.items()}


def runs_of(scenarios: Scenarios | pd.DataFrame | None) -> dict[str, dict[str, object]]:
    """The table as it is, named ``baseline``, and the scenarios; none of them may have that name."""
    found = {} if scenarios is None else scenarios_of(scenarios)
    if "baseline" in found:
        raise ValueError("a scenario cannot be named 'baseline': that is the table as it is")
    return {"baseline": {}} | found


def reader(columns: Sequence[str], overrides: Overrides) -> Callable[[str], Column]:
    """How a scenario reads a column: a number stands for every row, a name for that column of the table as it is.

    All right-hand sides see the original table, so two columns can be swapped.
    """
    for name, to in overrides.items():
        for c in (name, to) if isinstance(to, str) else (name,):
            if c not in columns:
                raise ValueError(f"a scenario names column {c!r}, which the table does not have")

    def read(name: str) -> Column:
        to = overrides.get(name, name)
        return given(to) if isinstance(to, str) else F.lit(float(to))

    return read


def read_by(scenarios: Iterable[Overrides]) -> list[str]:
    """The columns that scenarios put in place of others."""
    return [to for overrides in scenarios for to in overrides.values() if isinstance(to, str)]


def with_row_values(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``values`` in place of its own, row by row of the same ``key``.

    Every row of ``df`` needs one row of ``values``: ids that ``values`` repeats, or that it lacks or holds as null, are refused,
    as are columns that ``df`` does not have.  Ids that only ``values`` has play no part.
    """
    given_columns = [c for c in values.columns if c != key]
    unknown = [c for c in [key, *given_columns] if c not in df.columns] + ([key] if key not in values.columns else [])
    if unknown:
        raise ValueError(f"row values name columns that the table does not have: {unknown}")
    twice = values.groupBy(F.col(f"`{key}`").alias("k")).agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"row values repeat ids, for one {[r['k'] for r in twice]}")
    side = values.select(F.col(f"`{key}`").alias("_key"), *[F.col(f"`{c}`").alias(f"_value{i}") for i, c in enumerate(given_columns)])
    lost = df.select(F.col(f"`{key}`").alias("k")).join(side.select(F.col("_key").alias("k")), "k", "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"rows without row values, for one those of ids {[r['k'] for r in lost]}")
    at = {c: F.col(f"_value{i}") for i, c in enumerate(given_columns)}
    return df.join(side, df[key] == side["_key"]).select(*[at.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def apply_overrides(df: DataFrame, overrides: Overrides) -> DataFrame:
    reader(df.columns, overrides)  # refuses names that the table lacks
    return df.withColumns({name: (F.col(to) if isinstance(to, str) else F.lit(float(to))).cast("double") for name, to in overrides.items()})


def mean_by_scenario(df: DataFrame, columns: Mapping[str, Sequence[Column]], labels: Sequence[str]) -> DataFrame:
    """scenario, alternative, share: the means of each scenario's columns, in one pass over the table."""
    flat = [(s, label, c) for s, cs in columns.items() for label, c in zip(labels, cs, strict=True)]
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, (_, _, c) in enumerate(flat)])
    rows = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(label).alias("alternative"), F.col(f"m{i}").alias("share")) for i, (s, label, _) in enumerate(flat)])
    return means.select(F.explode(rows).alias("r")).select("r.*")


def _labels(shares: DataFrame) -> list[str]:
    return [c for c in shares.columns if c not in ("scenario", "share")]


def comparison(shares: DataFrame, base: str, treatment: str) -> DataFrame:
    """alternative (or outcome and category), base, treatment, change in per cent; NaN where the base is not above zero."""
    wide = shares.groupBy(*_labels(shares)).agg(
        F.max(F.when(F.col("scenario") == base, F.col("share"))).alias("base"), F.max(F.when(F.col("scenario") == treatment, F.col("share"))).alias("treatment")
    )
    return wide.withColumn("change", F.when(F.col("base") > 0, 100 * (F.col("treatment") - F.col("base")) / F.col("base")).otherwise(F.lit(float("nan"))))


def summary(shares: DataFrame) -> str:
    """Shares as text, a row per alternative (or outcome and category) and a column per scenario; there are few of either."""
    table = shares.toPandas().pivot(index=_labels(shares), columns="scenario", values="share")
    return table.to_string(float_format=lambda x: f"{x:.4f}")
