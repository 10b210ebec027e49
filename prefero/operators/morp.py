"""Multivariate ordered probit: several ordinal answers with correlated normal errors."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefero.functions.algebra import ARRAYS, COLUMNS, product, total
from prefero.functions.distributions import normal_cdf, normal_pdf
from prefero.kernels.matrices import angles_of_correlation, correlation_of_angles, jacobian
from prefero.kernels.mvn import METHODS, mvn_cdf, mvn_rectangle, mvn_rectangle_gradient
from prefero.operators.mnl import refuse_nulls
from prefero.operators.scenario import Overrides, Scenarios, mean_by_scenario, read_by, reader, runs_of
from prefero.operators.spec import Design, compile_spec, complete, given, rebased
from prefero.plans.estimates import KINDS, Estimates, covariance
from prefero.plans.likelihood import TIMES, Closed, Likelihood, alike, as_arrays
from prefero.plans.optim import minimize

FLOOR = 1e-300
#: Combinations of a joint table that a task takes on, about.
VERTICES = 64
STRUCTURES = ("iid", "heteronly", "full")


def category_probabilities(mean, thresholds: Sequence[float], sd: float = 1.0, m=COLUMNS) -> list:
    """Marginal probability of each category of one outcome."""
    below = [m.lift(0.0), *[normal_cdf((t - mean) / sd, m) for t in thresholds], m.lift(1.0)]
    return [b - a for a, b in zip(below[:-1], below[1:], strict=True)]


class MORP:
    """``outcomes``: columns of ordered integers.  ``spec``: {coefficient: {outcome: column}}.

    ``structure``: iid, heteronly (scales differ) or full (correlations, and scales unless
    ``fix_scales``).  The lowest category of each outcome is that of the table first
    given and is kept for later tables.
    """

    def __init__(self, df: DataFrame, outcomes: Sequence[str], spec: Mapping[str, Mapping[str, object]], structure: str = "iid", fix_scales: bool = True, method: str = "ovus", se: str = "bhhh", all_se: bool = False) -> None:
        self.all_se = all_se
        if structure not in STRUCTURES:
            raise ValueError(f"no such structure: {structure!r}")
        self.given, self.outcomes, self.structure, self.fix_scales, self.method, self.se = df, list(outcomes), structure, fix_scales, method, se
        self.design = compile_spec(spec, outcomes, df.columns)
        self.df = complete(df, self.design.columns())
        self.lowest: list[float] | None = None
        self.categories: list[int] | None = None
        self.results: Estimates | None = None
        self._slopes: tuple[np.ndarray, np.ndarray] | None = None

    def bind(self) -> None:
        """Learn each outcome's lowest category and number of categories, once."""
        if self.categories is None:
            row = self.given.agg(*[F.min(o).alias(f"a{i}") for i, o in enumerate(self.outcomes)], *[F.max(o).alias(f"b{i}") for i, o in enumerate(self.outcomes)]).collect()[0]
            if any(row[f"a{i}"] is None for i in range(len(self.outcomes))):
                raise ValueError("an outcome has no values: the table is empty, or holds nulls alone")
            self.lowest = [float(row[f"a{i}"]) for i in range(len(self.outcomes))]
            self.categories = [int(row[f"b{i}"] - row[f"a{i}"]) + 1 for i in range(len(self.outcomes))]

    @property
    def names(self) -> list[str]:
        d = len(self.outcomes)
        scales = [f"scale_{o}" for o in self.outcomes[1:]] if self._scales() else []
        corr = [f"corr_{a}_{b}" for i, b in enumerate(self.outcomes) for a in self.outcomes[:i]] if self.structure == "full" and d > 1 else []
        return [*self.design.names, *[f"tau_{o}_{j + 1}" for o, c in zip(self.outcomes, self.categories, strict=True) for j in range(c - 1)], *scales, *corr]

    def _scales(self) -> bool:
        return self.structure == "heteronly" or self.structure == "full" and not self.fix_scales

    def unpack(self, theta: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Coefficients, thresholds (first, then rising by exponentials) and covariance."""
        d, at = len(self.outcomes), len(self.design.names)
        beta, cuts = theta[:at], []
        for c in self.categories:
            part = theta[at : at + c - 1]
            cuts.append(np.cumsum(np.concatenate([part[:1], np.exp(part[1:])])))
            at += c - 1
        sd = np.ones(d)
        if self._scales():
            sd[1:] = np.exp(theta[at : at + d - 1])
            at += d - 1
        corr = correlation_of_angles(theta[at:]) if self.structure == "full" and d > 1 else np.eye(d)
        return beta, cuts, corr * np.outer(sd, sd)

    def natural(self, theta: np.ndarray) -> np.ndarray:
        """The parameters as they are reported: thresholds, scales and correlations themselves."""
        beta, cuts, cov = self.unpack(theta)
        sd = np.sqrt(np.diag(cov))
        corr = (cov / np.outer(sd, sd))[np.tril_indices(len(sd), -1)] if self.structure == "full" else []
        return np.concatenate([beta, *cuts, sd[1:] if self._scales() else [], corr])

    def theta_of(self, natural: np.ndarray) -> np.ndarray:
        """The parameters of the fit from reported ones."""
        natural, d, at = np.asarray(natural, float), len(self.outcomes), len(self.design.names)
        parts = [natural[:at]]
        for c in self.categories:
            cuts = natural[at : at + c - 1]
            parts.append(np.concatenate([cuts[:1], np.log(np.diff(cuts))]))
            at += c - 1
        if self._scales():
            parts.append(np.log(natural[at : at + d - 1]))
            at += d - 1
        if self.structure == "full" and d > 1:
            corr = np.eye(d)
            corr[np.tril_indices(d, -1)] = natural[at:]
            parts.append(angles_of_correlation(corr + np.tril(corr, -1).T))
        return np.concatenate(parts)

    def _likelihood(self) -> Likelihood:
        """Sums over the rows; those that are alike are one row with their number."""
        refuse_nulls(self.given, [*self.design.columns(), *self.outcomes])
        self.bind()
        d, v = len(self.outcomes), len(self.design.names)
        if self._separate():
            return Closed(alike(self._rows()), self.terms, len(self.names), times=TIMES)
        return Likelihood(alike(self.df.select(*self._packed(), self._answers().alias("y"))), self._kernel(d, v), len(self.names), scored=self._scored(d, v), times=TIMES)

    def natural_sums(self, natural: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Rows, log-likelihood, score and outer product at reported parameters and in their units."""
        lik = self._likelihood()
        try:
            theta = self.theta_of(natural)
            return lik.at(theta, np.linalg.pinv(jacobian(self.natural, theta)))
        finally:
            lik.close()

    @staticmethod
    def _sides(means: np.ndarray, y: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Limits of the errors between which each answer lies."""
        lower, upper = np.empty(y.shape), np.empty(y.shape)
        for i, t in enumerate(cuts):
            edges = np.concatenate([[-np.inf], t, [np.inf]])
            lower[:, i], upper[:, i] = edges[y[:, i]] - means[:, i], edges[y[:, i] + 1] - means[:, i]
        return lower, upper

    def _probabilities(self, theta: np.ndarray, means: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rectangle probability of each row's answers."""
        _, cuts, cov = self.unpack(theta)
        lower, upper = self._sides(means, y, cuts)
        if self.structure != "full" or y.shape[1] == 1:
            sd = np.sqrt(np.diag(cov))
            edge = lambda x: normal_cdf(np.clip(x / sd, -40, 40), ARRAYS)
            return np.prod(edge(upper) - edge(lower), axis=1)
        return mvn_rectangle(lower, upper, cov, self.method)

    def _packed(self, overrides: Overrides = {}) -> list[Column]:  # noqa: B006
        read = reader(self.df.columns, overrides)
        d, v = len(self.outcomes), len(self.design.names)
        return [F.array(*[F.lit(0.0) if (c := self.design.value(j, i, read)) is None else c for j in range(d) for i in range(v)]).alias("x")]

    def _answers(self) -> Column:
        return F.array(*[rebased(o, low) for o, low in zip(self.outcomes, self.lowest, strict=True)])

    def _separate(self) -> bool:
        """Whether the outcomes are independent, so that all terms are Columns."""
        return self.structure != "full" or len(self.outcomes) == 1

    def _rows(self) -> DataFrame:
        """The columns that the likelihood reads, numbered, and the answers from 0."""
        return self.df.select(*[given(c).alias(f"_c{i}") for i, c in enumerate(self.design.columns())], *[rebased(o, low).alias(f"_y{i}") for i, (o, low) in enumerate(zip(self.outcomes, self.lowest, strict=True))])

    def terms(self, rows: DataFrame, theta: list[Column], scored: bool = True) -> DataFrame:
        """``ll`` and the scores ``g0``, ``g1`` ... of the rows (of ``_rows``), for independent outcomes.

        An answer's probability lies between two normal distributions; a side without a threshold is constant.
        """
        read = {c: F.col(f"_c{i}") for i, c in enumerate(self.design.columns())}.__getitem__
        keep, v, d = list(rows.columns), len(self.design.names), len(self.outcomes)
        at = v
        first, raised = [], []  # places of each outcome's first threshold parameter; its thresholds
        for c in self.categories:
            cuts = [theta[at]]
            for k in range(1, c - 1):
                cuts.append(cuts[-1] + F.exp(theta[at + k]))
            first.append(at)
            raised.append(cuts[: c - 1])
            at += c - 1
        sds = [F.lit(1.0)] * d
        if self._scales():
            sds = [F.lit(1.0), *[F.exp(theta[at + i]) for i in range(d - 1)]]
        means = self.design.utilities(theta[:v], read)
        out = rows.select(*keep, *[F.array(*cuts).alias(f"_t{i}") for i, cuts in enumerate(raised) if cuts], *[m.alias(f"_m{i}") for i, m in enumerate(means)], *[x.alias(f"_s{i}") for i, x in enumerate(sds)])
        edges = []
        for i, cuts in enumerate(raised):
            y, n = F.col(f"_y{i}"), len(cuts)
            edge = lambda place, i=i: (F.get(f"_t{i}", place) - F.col(f"_m{i}")) / F.col(f"_s{i}")
            # beyond the outer thresholds the distribution is 0 or 1, which limits of 40 give as well
            edges += [F.when(y < n, edge(y)).otherwise(40.0).alias(f"_u{i}") if n else F.lit(40.0).alias(f"_u{i}"), F.when(y > 0, edge(y - 1)).otherwise(-40.0).alias(f"_l{i}") if n else F.lit(-40.0).alias(f"_l{i}")]
        out = out.select("*", *edges)
        cut = lambda x: F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))
        out = out.select("*", *[(normal_cdf(cut(F.col(f"_u{i}"))) - normal_cdf(cut(F.col(f"_l{i}")))).alias(f"_p{i}") for i in range(d)])
        whole = product([F.col(f"_p{i}") for i in range(d)])
        ll = F.log(F.greatest(whole, F.lit(FLOOR))).alias("ll")
        if not scored:
            return out.select(*keep, ll)
        out = out.select("*", ll, (whole > FLOOR).alias("_live"))
        slopes = [F.when(F.col("_live"), normal_pdf(cut(F.col(f"_{side}{i}"))) / (F.col(f"_p{i}") * F.col(f"_s{i}"))).otherwise(0.0).alias(f"_b{side}{i}") for i in range(d) for side in "ul"]
        out = out.select("*", *slopes)
        up, down = [F.col(f"_bu{i}") for i in range(d)], [F.col(f"_bl{i}") for i in range(d)]
        scores = [total([(down[i] - up[i]) * x for i in range(d) if (x := self.design.value(i, k, read)) is not None] or [F.lit(0.0)]) for k in range(v)]
        for i, cuts in enumerate(raised):
            y = F.col(f"_y{i}")
            for k in range(len(cuts)):  # a threshold parameter moves its own threshold and all above
                inside = F.when((y >= k) & (y < len(cuts)), up[i]).otherwise(0.0) - F.when(y > k, down[i]).otherwise(0.0)
                scores.append(inside if k == 0 else inside * F.exp(theta[first[i] + k]))
        if self._scales():
            scores += [(F.col(f"_l{i}") * down[i] - F.col(f"_u{i}") * up[i]) * F.col(f"_s{i}") for i in range(1, d)]
        return out.select(*keep, "ll", *[g.alias(f"g{i}") for i, g in enumerate(scores)])

    def row_scores(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability and score of each row for correlated outcomes: x (N, D, V), y (N, D).

        The rectangle's derivatives by its sides go to coefficients and thresholds, those by
        covariances to scales and correlations, whose few derivatives are the driver's numbers.
        """
        v, d, n = len(self.design.names), len(self.outcomes), len(x)
        beta, cuts, cov = self.unpack(theta)
        lower, upper = self._sides(x @ beta, y, cuts)
        p, by_low, by_up, by_cov = mvn_rectangle_gradient(lower, upper, cov, self.method)
        live = p > FLOOR
        g = np.zeros((n, len(theta)))
        g[:, :v] = -np.einsum("nd,ndv->nv", by_low + by_up, x)
        at = v
        for i, t in enumerate(cuts):
            raised = np.exp(theta[at : at + len(t)])
            for k in range(len(t)):  # a threshold parameter moves its own threshold and all above
                inside = by_up[:, i] * ((y[:, i] >= k) & (y[:, i] < len(t))) + by_low[:, i] * (y[:, i] > k)
                g[:, at + k] = inside * (raised[k] if k else 1.0)
            at += len(t)
        for k in range(at, len(theta)):
            g[:, k] = np.einsum("nij,ij->n", by_cov, self._cov_slopes(theta)[k])
        return np.log(np.maximum(p, FLOOR)), np.where(live[:, None], g / np.where(live, p, 1.0)[:, None], 0.0)

    def _cov_slopes(self, theta: np.ndarray) -> np.ndarray:
        """Derivatives of the covariance by each parameter (P, D, D); kept for the last parameters asked for."""
        if self._slopes is None or not np.array_equal(self._slopes[0], theta):
            d = len(self.outcomes)
            self._slopes = theta.copy(), jacobian(lambda t: self.unpack(t)[2].ravel(), theta).reshape(len(theta), d, d)
        return self._slopes[1]

    def _start(self) -> np.ndarray:
        parts = [np.zeros(len(self.design.names))]
        for c in self.categories:
            parts.append(np.array([-0.5 * (c - 2), *[0.0] * (c - 2)], float)[: c - 1])
        return np.concatenate([*parts, np.zeros(len(self.names) - sum(map(len, parts)))])

    def fit(self, iterations: int = 200) -> Estimates:
        lik = self._likelihood()
        d, v = len(self.outcomes), len(self.design.names)
        try:
            best = minimize(lik.objective, self._start(), iterations=iterations, ladder=lik.ladder)
            n, ll, g, outer = lik.at(best.theta)
            hessian = lik.hessian(best.theta) if self.se != "bhhh" or self.all_se else None
            if self.structure == "full" and 2 < d <= 4:  # the report is of the exact probability at the optimum
                approximate, self.method = self.method, "exact"
                exact = Likelihood(lik.rows, self._kernel(d, v), len(self.names), times=TIMES)
                n, ll = exact.value(best.theta)
                self.method = approximate
        finally:
            lik.close()
        slope = jacobian(self.natural, best.theta)
        of = lambda kind: slope.T @ covariance(kind, outer, hessian) @ slope
        extra = {"theta": best.theta, "natural_gradient": np.linalg.pinv(slope) @ g / max(n, 1)} | ({"cov": {k: of(k) for k in KINDS}} if self.all_se else {})
        self.results = Estimates(self.names, self.natural(best.theta), of(self.se), ll / max(n, 1), int(n), g / max(n, 1), best.iterations, best.converged, extra)
        return self.results

    def _plain(self) -> MORP:
        """A copy without the table, to go with a task."""
        twin = object.__new__(MORP)
        twin.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("df", "given", "results")}
        return twin

    def _kernel(self, d: int, v: int):
        twin = self._plain()

        def kernel(theta: np.ndarray, data: dict[str, np.ndarray]) -> np.ndarray:
            means = data["x"].reshape(len(data["x"]), d, v) @ twin.unpack(theta)[0]
            return np.log(np.maximum(twin._probabilities(theta, means, data["y"].astype(int).reshape(-1, d)), FLOOR))

        return kernel

    def _scored(self, d: int, v: int):
        """Values and scores at once, where the method has them."""
        if d > 2 and self.method not in METHODS and not (d <= 4 and self.method in ("exact", "scipy")):
            return None
        twin = self._plain()
        return lambda theta, data: twin.row_scores(theta, data["x"].reshape(len(data["x"]), d, v), data["y"].astype(int).reshape(-1, d))

    def from_estimates(self, beta: Sequence[float], thresholds: Sequence[Sequence[float]], corr: np.ndarray | None = None, lowest: Sequence[float] | None = None) -> Estimates:
        """Results from natural numbers; variances are one, thresholds must rise."""
        for t in thresholds:
            if any(b <= a for a, b in zip(t[:-1], t[1:], strict=True)):
                raise ValueError("thresholds must rise")
        if corr is not None and not np.allclose(corr, np.transpose(corr)):
            raise ValueError("a correlation matrix is symmetric")
        self.categories = [len(t) + 1 for t in thresholds]
        if lowest is not None:
            self.lowest = [float(x) for x in lowest]
        parts = [np.array(beta, float), *[np.concatenate([t[:1], np.log(np.diff(t))]) for t in map(np.asarray, thresholds)]]
        if self._scales():
            parts.append(np.zeros(len(self.outcomes) - 1))
        if self.structure == "full" and len(self.outcomes) > 1:
            parts.append(angles_of_correlation(np.asarray(corr, float) if corr is not None else np.eye(len(self.outcomes))))
        theta = np.concatenate(parts)
        self.results = Estimates(self.names, self.natural(theta), extra={"theta": theta})
        return self.results

    def _marginals(self, overrides: Overrides = {}, design: Design | None = None) -> list[list[Column]]:  # noqa: B006
        beta, cuts, cov = self.unpack(self.results.extra["theta"])
        means = (design or self.design).utilities(beta, reader(self.df.columns, overrides))
        return [category_probabilities(mu, t, float(np.sqrt(cov[i, i]))) for i, (mu, t) in enumerate(zip(means, cuts, strict=True))]

    def _labels(self) -> list[tuple[str, int]]:
        return [(o, j + 1) for o, c in zip(self.outcomes, self.categories, strict=True) for j in range(c)]

    def predict(self) -> DataFrame:
        """The table with p_<outcome>_<category>, normalised per outcome, and the likeliest category (from 1) of each."""
        out = []
        for o, ps in zip(self.outcomes, self._marginals(), strict=True):
            ps = [F.greatest(p, F.lit(0.0)) for p in ps]
            s = ps[0]
            for p in ps[1:]:
                s = s + p
            out += [(p / s).alias(f"p_{o}_{j + 1}") for j, p in enumerate(ps)]
            out.append(F.array_position(F.array(*ps), F.array_max(F.array(*ps))).cast("int").alias(f"category_{o}"))
        return self.df.select("*", *out)

    def ate(self, scenarios: Scenarios | None = None) -> DataFrame:
        """scenario, outcome, category, share: mean marginal probabilities."""
        runs = runs_of(scenarios)
        return self._means({s: self._marginals(o) for s, o in runs.items()}, read_by(runs.values()))

    def ate_cell(self, outcome: str, coefficient: str, base: float, treatment: float) -> DataFrame:
        """The same with one cell of the design held at ``base`` and at ``treatment``."""
        return self._means({s: self._marginals(design=self.design.with_cell(outcome, coefficient, to)) for s, to in (("base", base), ("treatment", treatment))})

    def _means(self, runs: Mapping[str, list[list[Column]]], more: Sequence[str] = ()) -> DataFrame:
        labels = [f"{o}:{c}" for o, c in self._labels()]
        found = mean_by_scenario(complete(self.df, more), {s: [p for ps in marginals for p in ps] for s, marginals in runs.items()}, labels)
        cut = F.length("alternative") - F.length(F.substring_index("alternative", ":", -1)) - 1
        return found.select("scenario", F.col("alternative").substr(F.lit(1), cut).alias("outcome"), F.substring_index("alternative", ":", -1).cast("int").alias("category"), "share")

    def joint(self) -> DataFrame:
        """One row for each combination of categories (from 1) with its mean probability; marginalise by grouping.

        The distribution is taken once at each vertex of the thresholds' lattice, and differences along
        each axis give every combination.  Slabs of the first outcome's categories go to tasks of their own,
        so a small table with many combinations is spread as well as a large one.
        """
        theta, twin = self.results.extra["theta"], self._plain()
        d, v, counts = len(self.outcomes), len(self.design.names), list(self.categories)
        slabs = min(counts[0], max(1, int(np.prod(counts)) // VERTICES))
        starts = [counts[0] * i // slabs for i in range(slabs + 1)]

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, n = np.zeros(counts), np.zeros(slabs)
            for rows in batches:
                if len(rows):
                    x, slab = as_arrays(rows)["x"], rows["slab"].to_numpy()
                    for s in np.unique(slab):
                        own = x[slab == s]
                        means = own.reshape(len(own), d, v) @ twin.unpack(theta)[0]
                        sums[starts[s] : starts[s + 1]] += twin.lattice(theta, means, starts[s], starts[s + 1])
                        n[s] += len(own)
            of = np.repeat(n, np.diff(starts) * int(np.prod(counts[1:])))
            yield pd.DataFrame({"combo": range(sums.size), "s": sums.ravel(), "n": of})

        rows = self.df.select(*self._packed(), F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"))
        if slabs > 1:
            rows = rows.repartition("slab", F.monotonically_increasing_id())
        found = rows.mapInPandas(task, "combo int, s double, n double").groupBy("combo").agg((F.sum("s") / F.sum("n")).alias("probability"))
        table = F.array(*[F.array(*[F.lit(x + 1) for x in c]) for c in itertools.product(*[range(c) for c in counts])])
        return found.select(*[F.get(F.get(table, F.col("combo")), F.lit(i)).alias(o) for i, o in enumerate(self.outcomes)], "probability")

    def lattice(self, theta: np.ndarray, means: np.ndarray, start: int, end: int) -> np.ndarray:
        """Sums over rows of the probabilities of all combinations whose first category is in [start, end)."""
        _, cuts, cov = self.unpack(theta)
        sd, d = np.sqrt(np.diag(cov)), len(cuts)
        edges = [np.concatenate([[-np.inf], t, [np.inf]]) for t in cuts]
        edges[0] = edges[0][start : end + 1]
        if self._separate():
            parts = [np.diff(normal_cdf(np.clip((e[None] - means[:, [i]]) / sd[i], -40, 40), ARRAYS), axis=1) for i, e in enumerate(edges)]
            out = parts[0]
            for p in parts[1:]:
                out = out[..., None] * p.reshape(len(p), *[1] * (out.ndim - 1), -1)
            return out.sum(axis=0)
        sums = np.zeros([len(e) for e in edges])
        for at in np.ndindex(*sums.shape):
            limits = np.array([e[k] for e, k in zip(edges, at, strict=True)])
            if not np.isneginf(limits).any():
                sums[at] = mvn_cdf(limits[None] - means, cov, self.method).sum()
        for axis in range(d):
            sums = np.diff(sums, axis=axis)
        return sums


def marginal(joint: DataFrame, outcome: str) -> DataFrame:
    """category, probability of one outcome from the table of combinations."""
    return joint.groupBy(F.col(outcome).alias("category")).agg(F.sum("probability").alias("probability"))

