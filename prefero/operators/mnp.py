"""Multinomial probit: normal errors with free covariance, random coefficients and mixtures of segments."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefero.functions.algebra import COLUMNS
from prefero.functions.distributions import bivariate_normal_cdf, normal_cdf
from prefero.kernels.matrices import angles_of_correlation, correlation_of_angles, jacobian
from prefero.kernels.mvn import METHODS, mvn_cdf, mvn_cdf_gradient
from prefero.operators.mnl import refuse_nulls
from prefero.operators.scenario import Overrides, Scenarios, read_by, reader, runs_of
from prefero.operators.spec import Design, choice_index, compile_spec, complete, given, unused
from prefero.plans.estimates import KINDS, Estimates, covariance
from prefero.plans.likelihood import TIMES, Likelihood, alike, as_arrays
from prefero.plans.optim import Bounds, minimize

FLOOR = 1e-300
STRUCTURES = ("iid", "heteronly", "full")


def differences(kernel: np.ndarray, chosen: int) -> np.ndarray:
    """Covariance of the rivals' errors less the chosen one's; ``kernel`` is that of all but the first alternative's differences."""
    j = len(kernel) + 1
    whole = np.zeros((j, j))
    whole[1:, 1:] = kernel
    m = np.delete(np.eye(j), chosen, axis=0)
    m[:, chosen] -= 1.0
    return m @ whole @ m.T


def choice_probability(utilities: list, kernel: np.ndarray, chosen: int, m=COLUMNS):
    """Probability of one of two or three alternatives, in closed form.  ``utilities`` may be of any algebra."""
    cov = differences(kernel, chosen)
    limits = [(utilities[chosen] - u) / float(np.sqrt(cov[i, i])) for i, u in enumerate([u for k, u in enumerate(utilities) if k != chosen])]
    if len(limits) == 1:
        return normal_cdf(limits[0], m)
    if len(limits) == 2:
        return bivariate_normal_cdf(limits[0], limits[1], float(cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1])), m)
    raise ValueError("closed forms end at three alternatives")


def probabilities(v: np.ndarray, kernel: np.ndarray, which: np.ndarray, available: np.ndarray, method: str, spread: np.ndarray | None = None) -> np.ndarray:
    """Probability of alternative ``which`` of each row, on arrays: v (N, J); ``spread`` (N, J, J): covariance of random utilities."""
    n, j = v.shape
    out = np.zeros(n)
    for c in range(j):
        at = np.flatnonzero((which == c) & (available[:, c] > 0))
        if not len(at):
            continue
        rivals = [k for k in range(j) if k != c]
        limits = np.where(available[np.ix_(at, rivals)] > 0, v[at, c][:, None] - v[np.ix_(at, rivals)], np.inf)
        cov = differences(kernel, c)  # one for all rows, unless utilities vary by row
        if spread is not None:
            m = np.delete(np.eye(j), c, axis=0)
            m[:, c] -= 1.0
            cov = cov + np.einsum("aj,njk,bk->nab", m, spread[at], m)
        out[at] = mvn_cdf(limits, cov, method)
    return out


def probability_gradients(v: np.ndarray, kernel: np.ndarray, which: np.ndarray, available: np.ndarray, method: str, spread: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probability of alternative ``which`` of each row, and its derivatives: by utilities (N, J), by the kernel (N, J-1, J-1), and by the covariance of utilities (N, J, J)."""
    n, j = v.shape
    p, by_v, by_all = np.zeros(n), np.zeros((n, j)), np.zeros((n, j, j))
    for c in range(j):
        at = np.flatnonzero((which == c) & (available[:, c] > 0))
        if not len(at):
            continue
        m = np.delete(np.eye(j), c, axis=0)
        m[:, c] -= 1.0
        rivals = [k for k in range(j) if k != c]
        limits = np.where(available[np.ix_(at, rivals)] > 0, -(v[at] @ m.T), np.inf)
        cov = np.broadcast_to(differences(kernel, c), (len(at), j - 1, j - 1))
        if spread is not None:
            cov = cov + np.einsum("aj,njk,bk->nab", m, spread[at], m)
        p[at], by_limit, by_cov = mvn_cdf_gradient(limits, cov, method)
        by_v[at] = -by_limit @ m
        by_all[at] = np.einsum("aj,nab,bk->njk", m, by_cov, m)
    return p, by_v, by_all[:, 1:, 1:], by_all


class MNP:
    """Multinomial probit over a table with an indicator column for each alternative.

    ``structure``: iid, heteronly or full covariance of the errors.  ``random``: names of
    coefficients with normal variation, independent or (``correlated``) jointly.
    ``segments``: classes of decision-makers with coefficients of their own.
    """

    def __init__(
        self, df: DataFrame, alternatives: Sequence[str], spec: Mapping, availability: Sequence[str] | None = None, structure: str = "iid",
        random: Sequence[str] = (), correlated: bool = False, segments: int = 1, method: str = "ovus", se: str = "bhhh", all_se: bool = False,
    ) -> None:
        self.all_se = all_se
        if structure not in STRUCTURES:
            raise ValueError(f"no such structure: {structure!r}")
        self.given, self.alternatives, self.structure, self.segments, self.method, self.se = df, list(alternatives), structure, segments, method, se
        self.design = compile_spec(spec, alternatives, df.columns)
        missing = [r for r in random if r not in self.design.names]
        if missing:
            raise ValueError(f"random coefficients that the specification lacks: {missing}")
        self.random, self.correlated = [self.design.names.index(r) for r in random], correlated
        self.available, self.has_choice = availability, set(alternatives) <= set(df.columns)
        self.df = complete(df, [*self.design.columns(), *(availability or [])])
        self.results: Estimates | None = None
        self._slopes: tuple[np.ndarray, np.ndarray] | None = None

    def _spread_size(self) -> int:
        r = len(self.random)
        return r * (r + 1) // 2 if self.correlated else r

    @property
    def names(self) -> list[str]:
        j, v, r = len(self.alternatives), self.design.names, self.random
        out = list(v)
        if self.structure != "iid":
            out += [f"scale_{a}" for a in self.alternatives[2:]]
            if self.structure == "full":
                out += [f"corr_{a}_{b}" for i, b in enumerate(self.alternatives[1:]) for a in self.alternatives[1 : i + 1]]
        spread = lambda tail: [f"omega_{v[r[a]]}_{v[r[b]]}{tail}" for a in range(len(r)) for b in range(a + 1)] if self.correlated else [f"sd_{v[a]}{tail}" for a in r]
        out += spread("")
        out += [f"segment_{s}" for s in range(2, self.segments + 1)]
        for s in range(2, self.segments + 1):
            out += [f"{n}_s{s}" for n in v] + spread(f"_s{s}")
        assert j > 1
        return out

    def unpack(self, theta: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray | None], np.ndarray]:
        """Kernel covariance; coefficients, covariances of the random ones and shares of the segments."""
        v, j, at = len(self.design.names), len(self.alternatives), len(self.design.names)
        betas, kernel = [theta[:v]], 0.5 * np.eye(j - 1) + 0.5
        if self.structure != "iid":
            sd = np.concatenate([[1.0], np.exp(theta[at : at + j - 2])])
            at += j - 2
            corr = np.eye(j - 1)
            if self.structure == "full" and j > 2:
                n = (j - 1) * (j - 2) // 2
                corr, at = correlation_of_angles(theta[at : at + n]), at + n
            kernel = corr * np.outer(sd, sd)

        def spread(part: np.ndarray) -> np.ndarray | None:
            if not len(part):
                return None
            if not self.correlated:
                return np.diag(np.exp(2 * part))
            low = np.zeros((len(self.random),) * 2)
            low[np.tril_indices(len(low))] = part
            return low @ low.T

        n = self._spread_size()
        omegas, at = [spread(theta[at : at + n])], at + n
        logits = np.concatenate([[0.0], theta[at : at + self.segments - 1]])
        at += self.segments - 1
        for _ in range(1, self.segments):
            betas.append(theta[at : at + v])
            omegas.append(spread(theta[at + v : at + v + n]))
            at += v + n
        share = np.exp(logits - logits.max())
        return kernel, betas, omegas, share / share.sum()

    def natural(self, theta: np.ndarray) -> np.ndarray:
        """Reported parameters: scales, correlations, standard deviations or covariances, and shares themselves."""
        kernel, betas, omegas, share = self.unpack(theta)
        sd = np.sqrt(np.diag(kernel))
        parts = [betas[0]]
        if self.structure != "iid":
            parts.append(sd[1:])
            if self.structure == "full":
                parts.append((kernel / np.outer(sd, sd))[np.tril_indices(len(sd), -1)])
        flat = lambda o: [] if o is None else o[np.tril_indices(len(o))] if self.correlated else np.sqrt(np.diag(o))
        parts += [flat(omegas[0]), share[1:]]
        for b, o in zip(betas[1:], omegas[1:], strict=True):
            parts += [b, flat(o)]
        return np.concatenate([np.asarray(p, float) for p in parts])

    def theta_of(self, natural: np.ndarray) -> np.ndarray:
        """The parameters of the fit from reported ones."""
        v, j, r, size = len(self.design.names), len(self.alternatives), len(self.random), self._spread_size()
        natural, parts, at = np.asarray(natural, float), [np.asarray(natural[:v], float)], v

        def spread(part: np.ndarray) -> np.ndarray:
            if not self.correlated:
                return np.log(part)
            omega = np.zeros((r, r))
            omega[np.tril_indices(r)] = part
            return np.linalg.cholesky(omega + np.tril(omega, -1).T)[np.tril_indices(r)]

        if self.structure != "iid":
            parts.append(np.log(natural[at : at + j - 2]))
            at += j - 2
            if self.structure == "full":
                n = (j - 1) * (j - 2) // 2
                corr = np.eye(j - 1)
                corr[np.tril_indices(j - 1, -1)] = natural[at : at + n]
                parts.append(angles_of_correlation(corr + np.tril(corr, -1).T))
                at += n
        parts.append(spread(natural[at : at + size]))
        share = natural[at + size : at + size + self.segments - 1]
        parts.append(np.log(share / (1 - share.sum())))
        at += size + self.segments - 1
        for _ in range(1, self.segments):
            parts += [natural[at : at + v], spread(natural[at + v : at + v + size])]
            at += v + size
        return np.concatenate(parts)

    def row_probabilities(self, theta: np.ndarray, x: np.ndarray, which: np.ndarray, available: np.ndarray) -> np.ndarray:
        """x: (N, J, V)."""
        kernel, betas, omegas, share = self.unpack(theta)
        out = np.zeros(len(x))
        for beta, omega, s in zip(betas, omegas, share, strict=True):
            spread = None if omega is None else np.einsum("njr,rs,nks->njk", x[:, :, self.random], omega, x[:, :, self.random])
            out += s * probabilities(x @ beta, kernel, which, available, self.method, spread)
        return out

    def _plain(self) -> MNP:
        twin = object.__new__(MNP)
        twin.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("df", "given", "results")}
        return twin

    def _cells(self, overrides: Overrides = {}, design: Design | None = None) -> tuple[list[str | float], list[str | float]]:  # noqa: B006
        """Of x and of availability, alternative by alternative: the column that a scenario reads, or the number that stands for every row."""
        reader(self.df.columns, overrides)  # refuses names that the table lacks
        to = [overrides.get(c, c) if isinstance(c, str) else c or 0.0 for row in (design or self.design).cells for c in row]
        return [c if isinstance(c, str) else float(c) for c in to], [1.0] * len(self.alternatives) if self.available is None else list(self.available)

    def _packed(self) -> list[Column]:
        return [F.array(*[given(c) if isinstance(c, str) else F.lit(c) for c in cells]).alias(name) for name, cells in zip(("x", "a"), self._cells(), strict=True)]

    @property
    def used(self) -> list[str]:
        return list(dict.fromkeys([*self.design.columns(), *(self.available or []), *(self.alternatives if self.has_choice else ["choice"])]))

    def _cov_slopes(self, theta: np.ndarray) -> np.ndarray:
        """Derivatives of the kernel covariance by each parameter (P, J-1, J-1): a few numbers, kept for the last parameters asked for."""
        if self._slopes is None or not np.array_equal(self._slopes[0], theta):
            j = len(self.alternatives) - 1
            self._slopes = theta.copy(), jacobian(lambda t: self.unpack(t)[0].ravel(), theta).reshape(len(theta), j, j)
        return self._slopes[1]

    def row_scores(self, theta: np.ndarray, x: np.ndarray, which: np.ndarray, available: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability and score of each row; x is (N, J, V).

        The probability's derivatives by limits go to the coefficients, those by covariances to scales and
        correlations and, through each row's own values, to the factor of the random coefficients.  Of a mixture,
        a segment's score counts by the segment's share in the row's probability.
        """
        v, j, n = len(self.design.names), len(self.alternatives), len(x)
        kernel, betas, omegas, share = self.unpack(theta)
        z, size = x[:, :, self.random], self._spread_size()
        fixed = v + (j - 2 + (j - 1) * (j - 2) // 2 * (self.structure == "full") if self.structure != "iid" else 0)
        logits = fixed + size
        own = logits + self.segments - 1  # where the second segment's parameters start
        p, g, of_kernel, parts = np.zeros(n), np.zeros((n, len(theta))), np.zeros((n, j - 1, j - 1)), []
        for k, (beta, omega, s) in enumerate(zip(betas, omegas, share, strict=True)):
            spread = None if omega is None else np.einsum("njr,rs,nks->njk", z, omega, z)
            part, by_v, by_kernel, by_all = probability_gradients(x @ beta, kernel, which, available, self.method, spread)
            at, more = (0, fixed) if k == 0 else (own + (k - 1) * (v + size), own + (k - 1) * (v + size) + v)
            g[:, at : at + v] = s * np.einsum("nj,njv->nv", by_v, x)
            if omega is not None:
                g[:, more : more + size] = s * self._spread_scores(theta[more : more + size], np.einsum("njr,njk,nks->nrs", z, by_all, z))
            of_kernel += s * by_kernel
            p += s * part
            parts.append(part)
        if self.structure != "iid":
            g[:, v:fixed] = np.einsum("nab,pab->np", of_kernel, self._cov_slopes(theta)[v:fixed])
        for k in range(1, self.segments):
            g[:, logits + k - 1] = share[k] * (parts[k] - p)
        live = p > FLOOR
        return np.log(np.maximum(p, FLOOR)), np.where(live[:, None], g / np.where(live, p, 1.0)[:, None], 0.0)

    def _spread_scores(self, part: np.ndarray, by_omega: np.ndarray) -> np.ndarray:
        """Derivatives by the parameters of the random coefficients' covariance from those by the covariance (N, R, R)."""
        if not self.correlated:
            return 2 * np.exp(2 * part) * np.einsum("nrr->nr", by_omega)
        low = np.zeros((len(self.random),) * 2)
        at = np.tril_indices(len(low))
        low[at] = part
        return 2 * (by_omega @ low)[:, at[0], at[1]]

    def _likelihood(self, active: np.ndarray | None = None, keep: Sequence[str] = (), together: bool = False) -> Likelihood:
        """``together``: rows that are alike are one row with their number, for sums over rows."""
        refuse_nulls(self.given, self.used)
        j, v, twin = len(self.alternatives), len(self.design.names), self._plain()
        y = choice_index(self.alternatives) if self.has_choice else F.col("choice")

        def kernel(theta: np.ndarray, data: dict[str, np.ndarray]) -> np.ndarray:
            n = len(data["y"])
            return np.log(np.maximum(twin.row_probabilities(theta, data["x"].reshape(n, j, v), data["y"].astype(int), data["a"].reshape(n, j)), FLOOR))

        def scored(theta: np.ndarray, data: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            n = len(data["y"])
            return twin.row_scores(theta, data["x"].reshape(n, j, v), data["y"].astype(int), data["a"].reshape(n, j))

        closed = j <= 3 or self.method in METHODS or j <= 5 and self.method in ("exact", "scipy")
        rows = self.df.select(*[F.col(f"`{c}`") for c in keep], *self._packed(), y.alias("y"))
        return Likelihood(alike(rows) if together else rows, kernel, len(self.names), active, scored=scored if closed else None, times=TIMES if together else None)

    def natural_sums(self, natural: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Rows, log-likelihood, score and outer product at reported parameters and in their units; scores are turned and multiplied in the tasks."""
        theta, lik = self.theta_of(natural), self._likelihood(together=True)
        try:
            return lik.at(theta, np.linalg.pinv(jacobian(self.natural, theta)))
        finally:
            lik.close()

    def natural_scores(self, natural: np.ndarray, keep: Sequence[str] = ()) -> DataFrame:
        """The columns ``keep`` of each row with its log-likelihood and score at reported parameters and in their units."""
        theta = self.theta_of(natural)
        return self._likelihood(keep=keep).rows_at(theta, keep, np.linalg.pinv(jacobian(self.natural, theta)))

    def fit(self, iterations: int = 200, active: np.ndarray | None = None, start: np.ndarray | None = None, seed: int = 0, bounds: Bounds | None = None) -> Estimates:
        """Estimates by maximum likelihood; ``active``: which parameters move; ``bounds``: (least, greatest) of each, None for none."""
        if bounds is not None and len(bounds) != len(self.names):
            raise ValueError(f"bounds of {len(bounds)} for {len(self.names)} parameters")
        if active is not None and len(active) != len(self.names):
            raise ValueError(f"a mask of {len(active)} for {len(self.names)} parameters")
        lik = self._likelihood(active, together=True)
        if start is None:
            start = np.random.default_rng(seed).normal(0, 0.1, len(self.names)) if self.segments > 1 else np.zeros(len(self.names))
            if self.correlated:
                start[[i for i, n in enumerate(self.names) if n.startswith("omega_")]] += 0.3
        try:
            best = minimize(lik.objective, start, bounds, active, iterations=iterations, ladder=lik.ladder)
            n, ll, g, outer = lik.at(best.theta)
            hessian = lik.hessian(best.theta) if self.se != "bhhh" or self.all_se else None
        finally:
            lik.close()
        slope = jacobian(self.natural, best.theta)
        of = lambda kind: slope.T @ covariance(kind, outer, hessian) @ slope
        extra = {"theta": best.theta, "natural_gradient": np.linalg.pinv(slope) @ g / max(n, 1)} | ({"cov": {k: of(k) for k in KINDS}} if self.all_se else {})
        self.results = Estimates(self.names, self.natural(best.theta), of(self.se), ll / max(n, 1), int(n), g / max(n, 1), best.iterations, best.converged, extra)
        moved = np.ones(len(self.names), bool) if active is None else np.asarray(active, bool)
        return self.results.frozen(np.abs(slope[moved]).sum(axis=0) < 1e-9)

    def from_estimates(self, beta: Sequence[float], kernel: np.ndarray | None = None, theta_rest: Sequence[float] = ()) -> Estimates:
        """Results from coefficients and, unless iid, the kernel covariance (its first entry one); further parameters as in the fit."""
        parts = [np.array(beta, float)]
        if self.structure != "iid":
            sd = np.sqrt(np.diag(kernel))
            parts.append(np.log(sd[1:] / sd[0]))
            if self.structure == "full" and len(sd) > 1:
                parts.append(angles_of_correlation(kernel / np.outer(sd, sd)))
        theta = np.concatenate([*parts, np.array(theta_rest, float)])
        if len(theta) != len(self.names):
            raise ValueError(f"{len(theta)} numbers for {len(self.names)} parameters")
        self.results = Estimates(self.names, self.natural(theta), extra={"theta": theta})
        return self.results

    def closed_shares(self, overrides: Overrides = {}) -> list[Column]:  # noqa: B006
        """Probabilities as Columns, for two or three alternatives without random coefficients or segments."""
        kernel, betas, _, _ = self.unpack(self.results.extra["theta"])
        v = self.design.utilities(betas[0], reader(self.df.columns, overrides))
        return [choice_probability(v, kernel, c) for c in range(len(self.alternatives))]

    def _all(self, x: np.ndarray, a: np.ndarray) -> np.ndarray:
        theta, n, j = self._theta, len(x), len(self.alternatives)
        p = np.stack([self.row_probabilities(theta, x.reshape(n, j, -1), np.full(n, c), a.reshape(n, j)) for c in range(j)], axis=1)
        return p / np.maximum(p.sum(axis=1, keepdims=True), FLOOR)

    def _ready(self) -> MNP:
        twin = self._plain()
        twin._theta = self.results.extra["theta"]
        return twin

    def predict(self) -> DataFrame:
        """The table with p_<alternative> for each alternative, normalised, and the likeliest one's number."""
        twin, j = self._ready(), len(self.alternatives)

        @F.pandas_udf("array<double>")
        def shares(x: pd.Series, a: pd.Series) -> pd.Series:
            return pd.Series(list(twin._all(np.array(x.tolist()), np.array(a.tolist()))), dtype="object") if len(x) else pd.Series([], dtype="object")

        name = unused("_p", self.df)
        p = self.df.withColumn(name, shares(*self._packed()))
        best = F.array_position(name, F.array_max(name)) - 1
        return p.select("*", *[F.get(name, F.lit(k)).alias(f"p_{n}") for k, n in zip(range(j), self.alternatives, strict=True)], best.cast("int").alias("predicted")).drop(name)

    def ate(self, scenarios: Scenarios | None = None) -> DataFrame:
        """scenario, alternative, share: mean probabilities, all scenarios in one pass."""
        runs = runs_of(scenarios)
        return self._means({s: self._cells(o) for s, o in runs.items()}, read_by(runs.values()))

    def ate_cell(self, alternative: str, coefficient: str, base: float, treatment: float) -> DataFrame:
        """Shares with one cell of the design held at ``base`` and at ``treatment``."""
        return self._means({s: self._cells(design=self.design.with_cell(alternative, coefficient, to)) for s, to in (("base", base), ("treatment", treatment))})

    def _means(self, runs: Mapping[str, tuple[list[str | float], list[str | float]]], more: Sequence[str] = ()) -> DataFrame:
        """Mean probabilities of each run's cells.  A task gets each column that some run reads once, as a double, and fills the cells itself."""
        twin, j, names = self._ready(), len(self.alternatives), list(runs)
        read = {c: f"c{i}" for i, c in enumerate(dict.fromkeys(c for run in runs.values() for cells in run for c in cells if isinstance(c, str)))}
        columns = [given(c).alias(name) for c, name in read.items()] or [F.lit(0.0).alias("c0")]  # without a column a batch would have no rows

        def filled(cells: list[str | float], data: dict[str, np.ndarray], n: int) -> np.ndarray:
            out = np.empty((n, len(cells)))
            for i, c in enumerate(cells):
                out[:, i] = data[read[c]] if isinstance(c, str) else c
            return out

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros((len(names), j)), 0
            for rows in batches:
                if len(rows):
                    data = as_arrays(rows)
                    total += [twin._all(filled(x, data, len(rows)), filled(a, data, len(rows))).sum(axis=0) for x, a in runs.values()]
                    n += len(rows)
            yield pd.DataFrame({"scenario": np.repeat(names, j), "alternative": twin.alternatives * len(names), "s": total.ravel(), "n": n})

        sums = complete(self.df, more).select(*columns).mapInPandas(task, "scenario string, alternative string, s double, n long")
        return sums.groupBy("scenario", "alternative").agg((F.sum("s") / F.sum("n")).alias("share"))
