"""Likelihoods over the rows of a table, summed by Spark.

The driver holds the parameters; each call is one job that brings back the
number of rows, the log-likelihood, the score and the scores' outer product.

``Closed`` takes models whose rows' terms are Columns: a call is one aggregate without
Python workers.  ``Likelihood`` takes those that need a numpy kernel by batch.  Scores are a model's own
derivatives of the very function that is maximised; a kernel without them is differentiated by differences.

A fit reads its rows dozens of times, so it counts rows that are alike first (``alike``) and reads each
different one: the sums are the same, and a call's work grows with the different rows alone.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: theta, columns as arrays -> log-likelihood of each row.
Kernel = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]
#: The same, with the score of each row besides.
Scored = Callable[[np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]
STEP = 1e-5
#: The column that says how often a row of ``alike`` occurs.
TIMES = "_times"


def alike(rows: DataFrame) -> DataFrame:
    """The different rows, each with how often it occurs in ``TIMES``."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias(TIMES))


def as_arrays(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: np.stack(rows[c].to_numpy()).astype(float, copy=False) if rows[c].dtype == object else rows[c].to_numpy() for c in rows.columns}


def _steps(theta: np.ndarray) -> np.ndarray:
    return STEP * (1 + np.abs(theta))


def scores(kernel: Kernel, theta: np.ndarray, data: dict[str, np.ndarray], active: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(weights), len(theta)))
    for i, h in enumerate(_steps(theta)):
        if active[i]:
            e = np.zeros(len(theta))
            e[i] = h
            out[:, i] = (kernel(theta + e, data) - kernel(theta - e, data)) / (2 * h)
    return out * weights[:, None]


class Likelihood:
    """A kernel over the rows of a table; ``weight`` names a column of weights, ``scored`` gives values and scores at once.

    ``times`` names a column that says how many rows a row stands for.
    """

    def __init__(
        self, rows: DataFrame, kernel: Kernel, parameters: int, active: np.ndarray | None = None, weight: str | None = None, scored: Scored | None = None, times: str | None = None,
    ) -> None:
        self.rows, self.kernel, self.weight, self.scored, self.times = rows.persist(), kernel, weight, scored, times
        self.active = np.ones(parameters, bool) if active is None else np.asarray(active, bool)

    def close(self) -> None:
        self.rows.unpersist()

    def _sums(self, of: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """Sum of an array over all rows, by their weights and how often they occur: each task sums its batches, Spark sums the tasks."""
        weight, times = self.weight, self.times

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for rows in batches:
                if len(rows):
                    data = as_arrays(rows)
                    one = np.ones(len(rows))
                    total += of(data, data[weight] if weight else one, data[times] if times else one)
            yield pd.DataFrame({"s": [total]})

        sums = self.rows.mapInPandas(task, "s array<double>").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("s"))
        return np.array(sums.collect()[0]["s"], float)  # one row

    def _both(self) -> Callable:
        """Values and weighted scores of rows, by the model's closed form or by differences."""
        kernel, scored = self.kernel, self.scored

        def of(theta: np.ndarray, data: dict[str, np.ndarray], active: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if scored is None:
                return kernel(theta, data), scores(kernel, theta, data, active, w)
            value, s = scored(theta, data)
            return value, s * active * w[:, None]

        return of

    def values(self, thetas: Sequence[np.ndarray]) -> tuple[float, np.ndarray]:
        """Rows, and the log-likelihood at several points, in one job and without scores."""
        kernel = self.kernel
        out = self._sums(lambda data, w, n: np.array([n.sum(), *[(n * w * kernel(t, data)).sum() for t in thetas]]), 1 + len(thetas))
        return out[0], out[1:]

    def value(self, theta: np.ndarray) -> tuple[float, float]:
        """Rows and log-likelihood."""
        n, ll = self.values([theta])
        return n, ll[0]

    def at(self, theta: np.ndarray, to: np.ndarray | None = None) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Rows, log-likelihood, score and the scores' outer product; ``to`` turns each row's score into other units where it is made."""
        both, active, p = self._both(), self.active, len(theta)

        def of(data: dict[str, np.ndarray], w: np.ndarray, n: np.ndarray) -> np.ndarray:
            value, s = both(theta, data, active, w)
            s = s if to is None else s @ to.T
            return np.concatenate([[n.sum(), (n * w * value).sum()], n @ s, (s.T @ (s * n[:, None])).ravel()])

        out = self._sums(of, 2 + p + p * p)
        return out[0], out[1], out[2 : 2 + p], out[2 + p :].reshape(p, p)

    def rows_at(self, theta: np.ndarray, keep: Sequence[str] = (), to: np.ndarray | None = None) -> DataFrame:
        """The columns ``keep`` of each row (of ``rows``, so not of those alike) with its log-likelihood and its (weighted) score."""
        both, active, weight, kinds = self._both(), self.active, self.weight, self.rows.select(*keep).schema if keep else None

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    data = as_arrays(rows.drop(columns=list(keep)))
                    value, s = both(theta, data, active, data[weight] if weight else np.ones(len(rows)))
                    s = s if to is None else s @ to.T
                    yield rows[list(keep)].assign(loglik=value, score=list(s))

        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds or ()], "loglik double, score array<double>"])
        return self.rows.mapInPandas(task, schema)

    def hessian(self, theta: np.ndarray) -> np.ndarray:
        """Negative Hessian of the log-likelihood, by differences of the score in one job."""
        both, active, p = self._both(), self.active, len(theta)

        def of(data: dict[str, np.ndarray], w: np.ndarray, n: np.ndarray) -> np.ndarray:
            out = np.zeros((p, p))
            for i, h in enumerate(10 * _steps(theta)):
                if active[i]:
                    e = np.zeros(p)
                    e[i] = h
                    out[i] = n @ (both(theta + e, data, active, w)[1] - both(theta - e, data, active, w)[1]) / (2 * h)
            return out.ravel()

        h = self._sums(of, p * p).reshape(p, p)
        return -(h + h.T) / 2

    def objective(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean negative log-likelihood and its gradient."""
        n, ll, g, _ = self.at(theta)
        return -ll / max(n, 1), -g / max(n, 1)

    def ladder(self, thetas: Sequence[np.ndarray]) -> np.ndarray:
        """Mean negative log-likelihoods, in one job."""
        n, ll = self.values(thetas)
        return -ll / max(n, 1)


@contextlib.contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs inside the block whose generated method would be too long for the JVM to compile (8,000 bytes) run as shorter ones; the setting is put back."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: rows, parameters, whether scores are asked for -> the rows' log-likelihood ``ll`` and scores ``g0``, ``g1`` ... (of active parameters).
#: The rows may only be selected from: what is selected is built once and applied again for each call.
Terms = Callable[[DataFrame, list[Column], bool], DataFrame]


class _Recipe:
    """Takes the place of a table while its terms are written down."""

    def __init__(self, columns: list[str], steps: tuple = ()) -> None:
        self.columns, self.steps = columns, steps

    def select(self, *columns: Column | str) -> _Recipe:
        return _Recipe(self.columns, (*self.steps, columns))


class Closed(Likelihood):
    """Terms that are Columns.  Parameters are read from an array by the run's number, so one compiled plan serves all of a fit's calls.

    A score that ``terms`` leaves out is zero.
    """

    RUN, THETA = "_run", "_theta"

    def __init__(self, rows: DataFrame, terms: Terms, parameters: int, active: np.ndarray | None = None, times: str | None = None) -> None:
        self.rows, self.terms, self.times = rows.withColumn(self.RUN, F.lit(0)).persist(), terms, times
        self.active = np.ones(parameters, bool) if active is None else np.asarray(active, bool)
        self._steps: dict[bool, tuple] = {}

    def frame(self, thetas: Sequence[np.ndarray], scored: bool) -> DataFrame:
        """The terms of every row at every point; ``_run`` numbers the points."""
        p = len(self.active)
        if scored not in self._steps:
            theta = [F.get(F.col(self.THETA), F.col(self.RUN) * p + i) for i in range(p)]
            self._steps[scored] = self.terms(_Recipe([*self.rows.columns, self.THETA]), theta, scored).steps
        rows = self.rows if len(thetas) == 1 else self.rows.withColumn(self.RUN, F.explode(F.sequence(F.lit(0), F.lit(len(thetas) - 1))))
        rows = rows.withColumn(self.THETA, F.lit([float(x) for t in thetas for x in t]))
        for columns in self._steps[scored]:
            rows = rows.select(*columns)
        return rows

    def _total(self, of: Column | str) -> Column:
        """Sum of a column over all rows."""
        of = F.col(of) if isinstance(of, str) else of
        return F.sum(of if self.times is None else of * F.col(self.times))

    def _rows_seen(self) -> Column:
        return F.count("*") if self.times is None else F.coalesce(F.sum(self.times), F.lit(0))

    def _scores(self, frame: DataFrame) -> list[str]:
        return [f"g{i}" for i in range(len(self.active)) if self.active[i] and f"g{i}" in frame.columns]

    def at(self, theta: np.ndarray, to: np.ndarray | None = None) -> tuple[float, float, np.ndarray, np.ndarray]:
        frame, p = self.frame([theta], True), len(theta)
        names = self._scores(frame)
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
        sums = [self._rows_seen().alias("n"), self._total("ll").alias("ll"), *[self._total(g).alias(g) for g in names], *[self._total(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]]
        with small_methods(frame.sparkSession):
            row = frame.agg(*sums).collect()[0]
        g, outer = np.zeros(p), np.zeros((p, p))
        for name in names:
            g[int(name[1:])] = row[name] or 0.0
        for a, b in pairs:
            outer[int(a[1:]), int(b[1:])] = outer[int(b[1:]), int(a[1:])] = row[f"{a}_{b}"] or 0.0
        return (row["n"], row["ll"] or 0.0, g, outer) if to is None else (row["n"], row["ll"] or 0.0, to @ g, to @ outer @ to.T)

    def values(self, thetas: Sequence[np.ndarray]) -> tuple[float, np.ndarray]:
        with small_methods(self.rows.sparkSession):
            rows = self.frame(thetas, False).groupBy(self.RUN).agg(self._rows_seen().alias("n"), self._total("ll").alias("ll")).collect()  # one a point
        out = np.zeros(len(thetas))
        for r in rows:
            out[r[self.RUN]] = r["ll"]
        return rows[0]["n"] if rows else 0, out

    def hessian(self, theta: np.ndarray) -> np.ndarray:
        """Negative Hessian of the log-likelihood, by differences of the score in one job."""
        p, steps = len(theta), 10 * _steps(theta)
        moved = np.flatnonzero(self.active)
        points = [theta + sign * steps[i] * np.eye(p)[i] for i in moved for sign in (1, -1)]
        frame = self.frame(points, True)
        names = self._scores(frame)
        with small_methods(frame.sparkSession):
            found = {r[self.RUN]: r for r in frame.groupBy(self.RUN).agg(*[self._total(g).alias(g) for g in names]).collect()}  # two a parameter
        h = np.zeros((p, p))
        for k, i in enumerate(moved):
            for name in names:
                h[i, int(name[1:])] = (found[2 * k][name] - found[2 * k + 1][name]) / (2 * steps[i]) if found else 0.0
        return -(h + h.T) / 2
