"""Multinomial logit: everything is a Column, so a fit is a handful of aggregates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefero.functions.algebra import COLUMNS, total
from prefero.operators.scenario import Overrides, Scenarios, mean_by_scenario, read_by, reader, runs_of
from prefero.operators.spec import Design, choice_index, compile_spec, complete, given
from prefero.plans.estimates import Estimates, covariance
from prefero.plans.likelihood import small_methods
from prefero.plans.optim import newton

#: The likelihood's floor.
FLOOR = 1e-4


def probabilities(utilities: list, available: list | None = None, m=COLUMNS) -> list:
    """Softmax over the available alternatives, shifted by the greatest; all zero if none is available."""
    if available is None:
        shift = m.greatest(*utilities)
        e = [m.exp(v - shift) for v in utilities]
        s = total(e)
        return [x / s for x in e]
    shift = m.greatest(*[m.where(a > 0, v, -1e300) for v, a in zip(utilities, available, strict=True)])
    e = [m.where(a > 0, m.exp(v - shift), 0.0) for v, a in zip(utilities, available, strict=True)]
    s = total(e)
    return [m.where(s > 0, x / s, 0.0) for x in e]


def chosen(values: list, y, m=COLUMNS):
    """The value of the chosen alternative."""
    out = m.lift(values[-1])
    for k in range(len(values) - 2, -1, -1):
        out = m.where(y == k, values[k], out)
    return out


def loglik(utilities: list, y, available: list | None = None, m=COLUMNS):
    return m.log(m.greatest(chosen(probabilities(utilities, available, m), y, m), FLOOR))


def row_terms(design: Design, beta: Sequence[float], y: Column, available: list[Column] | None = None) -> tuple[Column, list[Column], dict[tuple[int, int], Column]]:
    """A row's log-likelihood, score (by coefficient) and negative Hessian (upper triangle)."""
    p = probabilities(design.utilities(beta), available)
    ll = F.log(F.greatest(chosen(p, y), F.lit(FLOOR)))
    k, v = len(design.alternatives), len(design.names)
    x = [[design.value(j, i) for j in range(k)] for i in range(v)]
    zero = F.lit(0.0)
    mean = [total([p[j] * x[i][j] for j in range(k) if x[i][j] is not None] or [zero]) for i in range(v)]
    score = [chosen([zero if c is None else c for c in x[i]], y) - mean[i] for i in range(v)]
    if available is not None:  # a row without alternatives moves nothing
        any_left = F.greatest(*available) > 0 if len(available) > 1 else available[0] > 0
        score = [F.when(any_left, s).otherwise(zero) for s in score]
    curve = {
        (a, b): total([p[j] * x[a][j] * x[b][j] for j in range(k) if x[a][j] is not None and x[b][j] is not None] or [zero]) - mean[a] * mean[b] for a in range(v) for b in range(a, v)
    }
    return ll, score, curve


def sums(df: DataFrame, design: Design, beta: Sequence[float], y: Column, available: list[Column] | None = None) -> tuple[int, float, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, log-likelihood, score, negative Hessian and the scores' outer product, from one aggregate."""
    ll, score, curve = row_terms(design, beta, y, available)
    v = len(design.names)
    ins = df.select(ll.alias("ll"), *[s.alias(f"g{i}") for i, s in enumerate(score)], *[c.alias(f"h{a}_{b}") for (a, b), c in curve.items()])
    total_of = ins.agg(
        F.count("*").alias("n"),
        F.sum("ll").alias("ll"),
        *[F.sum(f"g{i}").alias(f"g{i}") for i in range(v)],
        *[F.sum(f"h{a}_{b}").alias(f"h{a}_{b}") for a, b in curve],
        *[F.sum(F.col(f"g{a}") * F.col(f"g{b}")).alias(f"b{a}_{b}") for a, b in curve],
    )
    with small_methods(df.sparkSession):
        row = total_of.collect()[0]
    g = np.array([row[f"g{i}"] or 0.0 for i in range(v)])
    h, b = np.zeros((v, v)), np.zeros((v, v))
    for i, j in curve:
        h[i, j] = h[j, i] = row[f"h{i}_{j}"] or 0.0
        b[i, j] = b[j, i] = row[f"b{i}_{j}"] or 0.0
    return row["n"], row["ll"] or 0.0, g, h, b


class MNL:
    """Multinomial logit over a table with an indicator column for each alternative.

    ``availability``: columns of 0 and 1, or None.  A null in a column of the model is refused: by
    ``fit`` with the number of rows, by predictions and effects as soon as a task meets it.
    """

    def __init__(self, df: DataFrame, alternatives: Sequence[str], spec: Mapping[str, Mapping[str, object]], availability: Sequence[str] | None = None, se: str = "bhhh") -> None:
        self.given, self.se = df, se
        self.design = compile_spec(spec, alternatives, df.columns)
        self.y = choice_index(alternatives) if set(alternatives) <= set(df.columns) else F.col("choice")
        self.available = None if availability is None else [given(c) for c in availability]
        self.asked = [*self.design.columns(), *(availability or [])]
        self.used = list(dict.fromkeys([*self.asked, *(alternatives if set(alternatives) <= set(df.columns) else ["choice"])]))
        self.df = complete(df, self.asked)
        self.results: Estimates | None = None

    def fit(self, start: Sequence[float] | None = None) -> Estimates:
        refuse_nulls(self.given, self.used)
        rows = self.df.select(*[F.col(f"`{c}`") for c in self.used]).persist()
        try:
            def objective(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
                n, ll, g, h, _ = sums(rows, self.design, beta, self.y, self.available)
                return -ll / max(n, 1), -g / max(n, 1), h / max(n, 1)

            best = newton(objective, np.zeros(len(self.design.names)) if start is None else np.array(start, float))
            n, ll, g, h, b = sums(rows, self.design, best.theta, self.y, self.available)
        finally:
            rows.unpersist()
        self.results = Estimates(list(self.design.names), best.theta, covariance(self.se, b, h), ll / max(n, 1), n, g / max(n, 1), best.iterations, best.converged, {"null_loglik": -math.log(len(self.design.alternatives))})
        return self.results

    def from_estimates(self, beta: Sequence[float]) -> Estimates:
        self.results = Estimates(list(self.design.names), np.array(beta, float))
        return self.results

    def _shares(self, overrides: Overrides) -> list[Column]:
        return probabilities(self.design.utilities(self.results.theta, reader(self.df.columns, overrides)), self.available)

    def predict(self, df: DataFrame | None = None) -> DataFrame:
        """The table with p_<alternative> for each alternative and the most likely one's number."""
        df = self.df if df is None else complete(df, self.asked)
        p = self._shares({})
        best = F.array_position(F.array(*p), F.array_max(F.array(*p))) - 1
        return df.select("*", *[c.alias(f"p_{a}") for c, a in zip(p, self.design.alternatives, strict=True)], best.cast("int").alias("predicted"))

    def ate(self, scenarios: Scenarios | None = None) -> DataFrame:
        """scenario, alternative, share: mean probabilities, for the table as it is and under each scenario."""
        runs = runs_of(scenarios)
        return mean_by_scenario(complete(self.df, read_by(runs.values())), {s: self._shares(o) for s, o in runs.items()}, self.design.alternatives)

    def ate_cell(self, alternative: str, coefficient: str, base: float, treatment: float) -> DataFrame:
        """Shares with one cell of the design held at ``base`` and at ``treatment``."""

        def shares(value: float) -> list[Column]:
            return probabilities(self.design.with_cell(alternative, coefficient, value).utilities(self.results.theta), self.available)

        return mean_by_scenario(self.df, {"base": shares(base), "treatment": shares(treatment)}, self.design.alternatives)


def refuse_nulls(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise if a column of the model holds a null, with the number of rows."""
    if not columns:
        return
    found = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).collect()[0].asDict()
    if bad := {c: n for c, n in found.items() if n}:
        raise ValueError(f"rows with nulls in columns of the model: {bad}")
