"""Multiple discrete-continuous extreme value: one budget spread over goods, the first always consumed.

The likelihood is one closed formula: with M inside goods consumed and scale s,

    c M! prod(consumed) e^(-d/s) / s^M / (1 + sum(all) e^(-d/s))^(M+1)

where d is a good's baseline difference to the outside good and c the Jacobian.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefero.functions.algebra import COLUMNS, product, total
from prefero.operators.mnl import refuse_nulls
from prefero.operators.scenario import Overrides, Scenarios, read_by, reader, runs_of, with_row_values
from prefero.operators.spec import Design, compile_spec, complete, given, known
from prefero.plans.estimates import KINDS, Estimates, covariance
from prefero.plans.likelihood import Closed, as_arrays
from prefero.plans.optim import minimize

FLOOR = 1e-4
#: The outside good's log-satiation: its translation e^-1000 is zero.
OUTSIDE = -1000.0


def likelihood(v: list, f: list, q: list, price: list, sigma, traditional: bool = True, m=COLUMNS):
    """A row's likelihood from baseline utilities v, translations f, quantities q and prices; the first good is the outside one.

    ``f[0]`` is not used: the outside good has no translation.
    """
    n = len(v)
    inside = range(1, n)
    base = v[0] - m.log(price[0]) - (m.log(q[0]) if traditional else 0.0)
    gaps = [base - (v[k] - m.log((q[k] + f[k]) / f[k]) - m.log(price[k])) for k in inside]
    e = [m.exp(-g / sigma) for g in gaps]
    used = [q[k] > 0 for k in inside]
    count = total([m.where(u, 1.0, 0.0) for u in used])
    if traditional:
        terms = [m.lift(1.0) / q[0]] + [m.where(u, 1.0 / (q[k] + f[k]), 1.0) for u, k in zip(used, inside, strict=True)]
        spent = price[0] * q[0] + total([m.where(u, price[k] * (q[k] + f[k]), 0.0) for u, k in zip(used, inside, strict=True)])
        jacobian = product(terms) * spent / price[0]
    else:
        jacobian = product([m.where(u, 1.0 / ((q[k] + f[k]) * price[k]), 1.0) for u, k in zip(used, inside, strict=True)])
    ways = m.lift(1.0)
    for i in range(2, n):
        ways = m.where(count >= i, ways * float(i), ways)
    above = product([m.where(u, x / sigma, 1.0) for u, x in zip(used, e, strict=True)])
    below = 1.0 + total(e)
    power = below
    for i in range(1, n):
        power = m.where(count >= i, power * below, power)
    return jacobian * ways * above / power


def loglik(v: list, f: list, q: list, price: list, sigma, traditional: bool = True, weight=1.0, m=COLUMNS):
    value = likelihood(v, f, q, price, sigma, traditional, m)
    return m.log(m.where(value > 0, value, FLOOR)) * weight


def allocate(v: np.ndarray, price: np.ndarray, f: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Optimal quantities for given utilities (already with errors, per price): goods join by falling utility.

    Rows at once: v, price, f are (N, J).  The multiplier for the first r inside goods
    is (e^v0 + sum f p e^v) / (budget + sum f p); a good joins while its e^v / p exceeds it.
    """
    n, j = v.shape
    gain = np.exp(v) / price
    order = np.argsort(-gain[:, 1:], axis=1, kind="stable") + 1
    rows = np.arange(n)
    spent = f * price
    top, bottom = np.exp(v[:, 0]), np.where(budget > 0, budget, 1.0)
    level = top / bottom
    taken = np.zeros((n, j), bool)
    going = np.ones(n, bool)
    for r in range(j - 1):
        k = order[:, r]
        going &= gain[rows, k] > level
        top = np.where(going, top + spent[rows, k] * gain[rows, k], top)
        bottom = np.where(going, bottom + spent[rows, k], bottom)
        level = top / bottom
        taken[rows, k] |= going
    out = np.where(taken, (gain / level[:, None] - 1) * f, 0.0)
    out[:, 0] = np.exp(v[:, 0]) / price[:, 0] / level
    return out


class MDCEV:
    """``goods``: quantity columns, the outside good first.  ``utility`` and ``satiation``: specifications over the goods.

    ``prices``: columns, or None for one.  ``traditional``: log utility of the outside
    good, else linear.  Parameters: utility coefficients, log-satiations (the outside
    good's held at -1000), log scale; the scale is reported itself.
    """

    def __init__(self, df: DataFrame, goods: Sequence[str], utility: Mapping, satiation: Mapping, prices: Sequence[str] | None = None, traditional: bool = True, weight: str | None = None, se: str = "bhhh", all_se: bool = False) -> None:
        self.all_se = all_se
        self.given, self.goods, self.traditional, self.weight, self.se = df, list(goods), traditional, weight, se
        self.x, self.z = compile_spec(utility, goods, df.columns), compile_spec(satiation, goods, df.columns)
        self.prices = prices
        self.used = list(dict.fromkeys([*self.x.columns(), *self.z.columns(), *(prices or []), *([weight] if weight else [])]))
        self.df = complete(df, self.used)
        self.results: Estimates | None = None

    def _price(self, read=given) -> list[Column]:
        return [F.lit(1.0)] * len(self.goods) if self.prices is None else [read(c) for c in self.prices]

    def _packed(self, overrides: Overrides = {}, utility: Design | None = None, quantities: bool = True) -> list[Column]:  # noqa: B006
        read = reader(self.df.columns, overrides)
        pack = lambda d: F.array(*[F.lit(0.0) if (c := d.value(j, v, read)) is None else c for j in range(len(self.goods)) for v in range(len(d.names))])
        q = [F.array(*[read(g) for g in self.goods]).alias("q")] if quantities else []
        return [pack(utility or self.x).alias("x"), pack(self.z).alias("z"), *q, F.array(*self._price(read)).alias("p")]

    @property
    def names(self) -> list[str]:
        return [*self.x.names, *[f"g_{n}" for n in self.z.names], "sigma"]

    def _rows(self) -> DataFrame:
        """The columns that the likelihood reads, numbered, so that no name of the table meets one of the terms."""
        return self.df.select(*[given(c).cast("double").alias(f"_c{i}") for i, c in enumerate(self._read())])

    def _read(self) -> list[str]:
        return list(dict.fromkeys([*self.goods, *self.used]))

    def terms(self, rows: DataFrame, theta: list[Column], scored: bool = True) -> DataFrame:
        """``ll`` and the scores ``g0``, ``g1`` ... of the rows (of ``_rows``) by utility coefficients, log-satiations and log scale.

        By a good's utility the log-likelihood moves by r / s, with r the good's being consumed
        less (M + 1) times its share of ``below``; by the outside good's it moves by the others' sum against it.
        """
        at = {c: F.col(f"_c{i}") for i, c in enumerate(self._read())}
        read, n, nx, nz = at.__getitem__, len(self.goods), len(self.x.names), len(self.z.names)
        q, price, weight = [at[g] for g in self.goods], self._price(read), at[self.weight] if self.weight else F.lit(1.0)
        v, u = self.x.utilities(theta[:nx], read), self.z.utilities(theta[nx : nx + nz], read)
        keep = [c for c in rows.columns]
        staged = rows.select(*keep, *[x.alias(f"_v{k}") for k, x in enumerate(v)], *[F.exp(x).alias(f"_f{k}") for k, x in enumerate(u) if k], F.exp(theta[-1]).alias("_s"))
        v, f, s = [F.col(f"_v{k}") for k in range(n)], [F.lit(0.0), *[F.col(f"_f{k}") for k in range(1, n)]], F.col("_s")
        value = likelihood(v, f, q, price, s, self.traditional)
        staged = staged.select("*", value.alias("_p"))
        ll = (F.log(F.when(F.col("_p") > 0, F.col("_p")).otherwise(FLOOR)) * weight).alias("ll")
        if not scored:
            return staged.select(*keep, ll)
        base = v[0] - F.log(price[0]) - (F.log(q[0]) if self.traditional else 0.0)
        inside = range(1, n)
        staged = staged.select("*", *[(base - (v[k] - F.log((q[k] + f[k]) / f[k]) - F.log(price[k]))).alias(f"_d{k}") for k in inside])
        staged = staged.select("*", *[F.exp(-F.col(f"_d{k}") / s).alias(f"_e{k}") for k in inside])
        is_used = {k: F.when(q[k] > 0, 1.0).otherwise(0.0) for k in inside}
        many = total([is_used[k] for k in inside]) + 1.0
        below = total([F.col(f"_e{k}") for k in inside]) + 1.0
        staged = staged.select("*", *[(is_used[k] - many * F.col(f"_e{k}") / below).alias(f"_r{k}") for k in inside])
        spent = price[0] * q[0] + total([F.when(q[k] > 0, price[k] * (q[k] + f[k])).otherwise(0.0) for k in inside])
        r = {k: F.col(f"_r{k}") for k in inside}
        by_v = [-total([r[k] / s for k in inside]), *[r[k] / s for k in inside]]
        by_u = [None]
        for k in inside:
            own = is_used[k] * (price[k] * f[k] / spent - f[k] / (q[k] + f[k])) if self.traditional else -is_used[k] * f[k] / (q[k] + f[k])
            by_u.append(r[k] * q[k] / (s * (q[k] + f[k])) + own)
        staged = staged.select("*", *[x.alias(f"_bv{k}") for k, x in enumerate(by_v)], *[x.alias(f"_bu{k}") for k, x in enumerate(by_u) if k])
        cells = lambda design, i, kind, first: total([F.col(f"_{kind}{k}") * x for k in range(first, n) if (x := design.value(k, i, read)) is not None] or [F.lit(0.0)])
        of_scale = total([r[k] * F.col(f"_d{k}") / s - is_used[k] for k in inside])
        scores = [*[cells(self.x, i, "bv", 0) for i in range(nx)], *[cells(self.z, i, "bu", 1) for i in range(nz)], of_scale]
        live = F.when(F.col("_p") > 0, weight).otherwise(0.0)
        return staged.select(*keep, ll, *[(g * live).alias(f"g{i}") for i, g in enumerate(scores)])

    def _active(self) -> np.ndarray:
        active = np.ones(len(self.names), bool)
        if self.z.names and self.z.cells[0][0] is not None:
            active[len(self.x.names)] = False  # the outside good's own satiation is no parameter
        return active

    def fit(self, iterations: int = 200) -> Estimates:
        refuse_nulls(self.given, list(dict.fromkeys([*self.used, *self.goods])))
        lik = Closed(self._rows(), self.terms, len(self.names), self._active())
        try:
            start = np.where(self._active(), 0.0, OUTSIDE)
            best = minimize(lik.objective, start, active=self._active(), iterations=iterations, ladder=lik.ladder)
            n, ll, g, outer = lik.at(best.theta)
            hessian = lik.hessian(best.theta) if self.se != "bhhh" or self.all_se else None
        finally:
            lik.close()
        natural = best.theta.copy()
        natural[-1] = np.exp(natural[-1])
        slope = np.ones(len(natural))
        slope[-1] = natural[-1]  # from the log scale to the scale
        of = lambda kind: covariance(kind, outer, hessian) * np.outer(slope, slope)
        extra = {"theta": best.theta} | ({"cov": {k: of(k) for k in KINDS}} if self.all_se else {})
        self.results = Estimates(self.names, natural, of(self.se), ll / max(n, 1), int(n), g / max(n, 1), best.iterations, best.converged, extra)
        return self.results.frozen(~self._active())

    def natural_sums(self, natural: Sequence[float]) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Rows, log-likelihood, score and outer product at reported parameters (the scale itself) and in their units."""
        refuse_nulls(self.given, list(dict.fromkeys([*self.used, *self.goods])))
        theta = np.array(natural, float)
        theta[-1] = math.log(theta[-1])
        to = np.ones(len(theta))
        to[-1] = 1 / natural[-1]
        lik = Closed(self._rows(), self.terms, len(self.names), self._active())
        try:
            return lik.at(theta, np.diag(to))
        finally:
            lik.close()

    def from_estimates(self, utility: Sequence[float], satiation: Sequence[float], sigma: float) -> Estimates:
        theta = np.array([*utility, *satiation, math.log(sigma)], float)
        self.results = Estimates(self.names, np.array([*utility, *satiation, sigma], float), extra={"theta": theta})
        return self.results

    def loglik_column(self) -> Column:
        """A row's log-likelihood at the results, as a Column."""
        nx, nz = len(self.x.names), len(self.z.names)
        theta = self.results.extra["theta"]
        v, u = self.x.utilities(theta[:nx]), self.z.utilities(theta[nx : nx + nz])
        weight = given(self.weight) if self.weight else 1.0
        # quantities are refused where they are null like every other column of the model
        return loglik(v, [F.exp(x) for x in u], [known(g) for g in self.goods], self._price(), float(math.exp(theta[-1])), self.traditional, weight)

    def _simulated(self, runs: Mapping[str, list[Column]], budget: str | float, id_column: str | None, more: Sequence[str] = ()) -> tuple[DataFrame, Callable]:
        """Rows with the packed columns of every run, and what allocates a batch of them for one run and replication."""
        theta, j, nx, nz = self.results.extra["theta"], len(self.goods), len(self.x.names), len(self.z.names)
        sigma, names = float(math.exp(theta[-1])), list(runs)
        of_table = isinstance(budget, str) and budget in self.df.columns
        money = given(budget) if of_table else F.lit(1.0 if isinstance(budget, str) else float(budget))
        row_id = given(id_column).cast("long") if id_column else F.xxhash64(*self._packed(quantities=False))
        packed = [c.alias(f"{n}{i}") for i, cols in enumerate(runs.values()) for c, n in zip(cols, "xzp", strict=True)]
        whole = complete(self.df, [*more, *([budget] if of_table else []), *([id_column] if id_column else [])])
        rows = whole.select(row_id.alias("row_id"), *packed, money.alias("budget"))

        def prepared(part: pd.DataFrame) -> Callable[[str, int, int], np.ndarray]:
            n, data = len(part), as_arrays(part)
            of = {}
            for i, name in enumerate(names):
                v = data[f"x{i}"].reshape(n, j, nx) @ theta[:nx]
                f = np.exp(np.clip(data[f"z{i}"].reshape(n, j, nz) @ theta[nx : nx + nz], OUTSIDE, 300)) if nz else np.ones((n, j))
                of[name] = v, f, data[f"p{i}"].reshape(n, j)

            def allocated(name: str, seed: int, replication: int) -> np.ndarray:
                v, f, p = of[name]
                errors = gumbel(seed, data["row_id"], np.full(n, replication), j) * sigma if seed is not None else 0.0
                return allocate(v + errors, p, f, data["budget"].astype(float))

            return allocated

        return rows, prepared

    def with_values(self, values: DataFrame, id_column: str) -> MDCEV:
        """The model over its table with each row's own values in place of columns; see ``with_row_values``."""
        twin = object.__new__(MDCEV)
        twin.__dict__ = dict(self.__dict__)
        twin.given = with_row_values(self.given, values, id_column)
        twin.df = complete(twin.given, self.used)
        return twin

    def forecast(self, budget: str | float = "tot", replications: int = 200, seed: int = 1234, overrides: Overrides = {}, id_column: str | None = None, values: DataFrame | None = None) -> DataFrame:  # noqa: B006
        """row_id, replication and the quantity of each good: optimal allocations under Gumbel errors.

        ``values`` (the id column and others of the table) puts in each row's own values of those columns.

        Each row draws by (seed, row id, replication), so results do not depend on how
        rows are spread.  Without ``id_column`` a row's id is its content's hash.
        Replications are made where the rows are: a row crosses to its task once.
        """
        if values is not None:
            if id_column is None:
                raise ValueError("row values are joined by an id column: name it")
            return self.with_values(values, id_column).forecast(budget, replications, seed, overrides, id_column)
        goods = self.goods
        rows, prepared = self._simulated({"": self._packed(overrides, quantities=False)}, budget, id_column, read_by([overrides]))

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                if len(part):
                    allocated = prepared(part)
                    for r in range(replications):
                        q = allocated("", seed, r)
                        yield pd.DataFrame({"row_id": part["row_id"], "replication": r} | {g: q[:, k] for k, g in enumerate(goods)})

        return rows.mapInPandas(task, "row_id long, replication int, " + ", ".join(f"`{g}` double" for g in goods))

    def allocation(self, budget: str | float = "tot", id_column: str | None = None) -> DataFrame:
        """row_id and the optimal quantity of each good without errors."""
        goods = self.goods
        rows, prepared = self._simulated({"": self._packed(quantities=False)}, budget, id_column)

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                if len(part):
                    q = prepared(part)("", None, 0)
                    yield pd.DataFrame({"row_id": part["row_id"]} | {g: q[:, k] for k, g in enumerate(goods)})

        return rows.mapInPandas(task, "row_id long, " + ", ".join(f"`{g}` double" for g in goods))

    def _rates(self, runs: Mapping[str, list[Column]], budget: str | float = "tot", replications: int = 200, seed: int = 1234, id_column: str | None = None, more: Sequence[str] = ()) -> DataFrame:
        """scenario, good, participation, quantity: all runs and replications in one pass, each task summing its own."""
        goods, names = self.goods, list(runs)
        rows, prepared = self._simulated(runs, budget, id_column, more)

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            used, total, n = np.zeros((len(names), len(goods))), np.zeros((len(names), len(goods))), 0
            for part in batches:
                if len(part):
                    allocated = prepared(part)
                    n += len(part) * replications
                    for i, name in enumerate(names):
                        for r in range(replications):
                            q = allocated(name, seed, r)
                            used[i] += (q > 0).sum(axis=0)
                            total[i] += q.sum(axis=0)
            yield pd.DataFrame({"scenario": np.repeat(names, len(goods)), "good": goods * len(names), "used": used.ravel(), "total": total.ravel(), "n": n})

        sums = rows.mapInPandas(task, "scenario string, good string, used double, total double, n long")
        return sums.groupBy("scenario", "good").agg((F.sum("used") / F.sum("n")).alias("participation"), (F.sum("total") / F.sum("n")).alias("quantity"))

    def participation(self, overrides: Overrides = {}, **kwargs) -> DataFrame:  # noqa: B006
        """Each good's share of forecasts in which it is consumed, and its mean quantity: good, participation, quantity."""
        return self._rates({"": self._packed(overrides, quantities=False)}, more=read_by([overrides]), **kwargs).select("good", "participation", "quantity")

    def predict(self, **kwargs) -> DataFrame:
        """good, rate: participation rates normalised to one, the outside good's taken as one."""
        rates = self.participation(**kwargs).withColumn("rate", F.when(F.col("good") == self.goods[0], 1.0).otherwise(F.col("participation")))
        return rates.select("good", (F.col("rate") / F.sum("rate").over(_whole())).alias("rate"))

    def predict_choice(self, **kwargs) -> DataFrame:
        """The one good of the greatest participation rate; the outside good's is one, so ties go to it."""
        return self.predict(**kwargs).orderBy(F.desc("rate"), F.array_position(F.array(*map(F.lit, self.goods)), F.col("good"))).limit(1)

    def ate(self, scenarios: Scenarios, **kwargs) -> DataFrame:
        """scenario, alternative, share: participation under the table as it is and under each scenario, in one pass."""
        runs = runs_of(scenarios)
        return self._shares({s: self._packed(o, quantities=False) for s, o in runs.items()}, more=read_by(runs.values()), **kwargs)

    def ate_cell(self, good: str, coefficient: str, base: float, treatment: float, **kwargs) -> DataFrame:
        """The same with one cell of the utility's design held at ``base`` and at ``treatment``."""
        return self._shares({s: self._packed(utility=self.x.with_cell(good, coefficient, to), quantities=False) for s, to in (("base", base), ("treatment", treatment))}, **kwargs)

    def _shares(self, runs: Mapping[str, list[Column]], **kwargs) -> DataFrame:
        return self._rates(runs, **kwargs).select("scenario", F.col("good").alias("alternative"), F.col("participation").alias("share"))


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def gumbel(seed: int, row: np.ndarray, replication: np.ndarray, n: int) -> np.ndarray:
    """Standard Gumbel draws keyed by seed, row and replication: a counter-based mix of 64 bits."""
    with np.errstate(over="ignore"):
        x = row.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + replication.astype(np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
        x = x + np.uint64(seed) * np.uint64(0x165667B19E3779F9) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    u = ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
    return -np.log(-np.log(u))
