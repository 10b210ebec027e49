"""Fits on generated data, agreement of closed forms with kernels, and sums that do not depend on partitions."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefero.kernels.mvn import mvn_cdf
from prefero.operators import mdcev, mnp
from prefero.operators.mdcev import MDCEV
from prefero.operators.mnl import MNL, sums
from prefero.operators.mnp import MNP
from prefero.operators.morp import MORP
from prefero.operators.scenario import mean_by_scenario
from prefero.plans.estimates import covariance
from prefero.plans.likelihood import Likelihood
from prefero.plans.optim import minimize, newton


def choices(n=600, seed=42, noise="gumbel"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    u = x * 0.8 + np.array([0.0, 0.4, -0.3])
    e = rng.gumbel(size=(n, 3)) if noise == "gumbel" else np.column_stack([np.zeros(n), rng.multivariate_normal([0, 0], 0.5 * np.eye(2) + 0.5, n)])
    y = (u + e).argmax(axis=1)
    return pd.DataFrame({f"c{k}": (y == k).astype(int) for k in range(3)} | {f"x{k}": x[:, k] for k in range(3)})


ALTS = ["c0", "c1", "c2"]
SPEC = {"asc1": {"c1": "uno"}, "asc2": {"c2": "uno"}, "b": {a: f"x{k}" for k, a in enumerate(ALTS)}}


def test_mnl_fit(spark):
    m = MNL(spark.createDataFrame(choices()), ALTS, SPEC, se="sandwich")
    r = m.fit()
    assert r.converged and abs(r.theta - [0.4, -0.3, 0.8]).max() < 0.3
    assert np.abs(r.gradient).max() < 1e-5 and (r.se > 0).all() and r.loglik > r.extra["null_loglik"]
    assert "asc1" in r.summary() and r.to_dataframe(spark).count() == 3
    again = MNL(spark.createDataFrame(choices()), ALTS, SPEC)
    again.from_estimates(r.theta)
    a, b = (x.ate({"up": {"x1": 1.0}}).toPandas()["share"] for x in (m, again))
    np.testing.assert_allclose(a, b, atol=1e-12)


def test_mnl_derivatives_and_partitions(spark):
    df, beta = spark.createDataFrame(choices(200)), np.array([0.1, -0.2, 0.5])
    m = MNL(df, ALTS, SPEC)
    n, ll, g, h, b = sums(df, m.design, beta, m.y)
    for i in range(3):
        e = np.zeros(3)
        e[i] = 1e-5
        up, down = (sums(df, m.design, beta + s * e, m.y) for s in (1, -1))
        assert g[i] == pytest.approx((up[1] - down[1]) / 2e-5, abs=1e-4)
        np.testing.assert_allclose(h[i], -(up[2] - down[2]) / 2e-5, atol=1e-4)
    for parts in (1, 2, 7):
        again = sums(df.repartition(parts), m.design, beta, m.y)
        np.testing.assert_allclose(again[4], b, rtol=1e-10)
    assert n == 200


def test_likelihood_sums_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": np.linspace(-1, 1, 101)}))
    kernel = lambda theta, data: -((data["x"] - theta[0]) ** 2)
    got = []
    for parts in (1, 2, 7):
        lik = Likelihood(df.repartition(parts), kernel, 1)
        got.append(lik.at(np.array([0.3])))
        np.testing.assert_allclose(lik.hessian(np.array([0.3])), [[202.0]], rtol=1e-4)
        lik.close()
    for n, ll, g, b in got[1:]:
        assert n == 101
        np.testing.assert_allclose([ll, g[0], b[0, 0]], [got[0][1], got[0][2][0], got[0][3][0, 0]], rtol=1e-9)


def rows_of_a_fit(monkeypatch, of, model):
    """How many rows a fit's likelihood reads at each call, and the fit."""
    read, init = [], of.__init__

    def counted(self, *args, **kwargs):
        init(self, *args, **kwargs)
        read.append(self.rows.count())

    monkeypatch.setattr(of, "__init__", counted)
    return read, model.fit(iterations=3)


@pytest.mark.parametrize("random", [[], ["b"]])
def test_probit_fit_reads_each_different_row_once(spark, monkeypatch, random):
    """40 rows, repeated up to 30 times each, are 40 rows to each step; sums are those of all rows."""
    few = choices(40)
    every = few.loc[few.index.repeat(1 + np.arange(40) * 7 % 30)]
    m = MNP(spark.createDataFrame(every), ALTS, SPEC, random=random, se="sandwich")
    theta, one, all_rows = np.full(len(m.names), 0.2), m._likelihood(together=True), m._likelihood()
    for a, b in zip(one.at(theta), all_rows.at(theta), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(one.hessian(theta), all_rows.hessian(theta), rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose(one.values([theta, -theta])[1], all_rows.values([theta, -theta])[1])
    assert m.natural_scores(m.natural(theta)).count() == len(every)
    read, fitted = rows_of_a_fit(monkeypatch, Likelihood, m)
    assert read == [40] and fitted.n == len(every)


def test_mnp_closed_form_equals_kernel(spark):
    df = spark.createDataFrame(choices(100))
    cov = np.array([[1.0, 0.3], [0.3, 1.7]])
    m = MNP(df, ALTS, SPEC, structure="full")
    m.from_estimates([0.4, -0.3, 0.8], cov)
    closed = df.select(*m.closed_shares()).toPandas().to_numpy()
    p = m.predict().toPandas()
    np.testing.assert_allclose(closed, p[[f"p_{a}" for a in ALTS]].to_numpy(), atol=1e-7)
    np.testing.assert_allclose(closed.sum(axis=1), 1, atol=1e-8)
    assert (p["predicted"] == closed.argmax(axis=1)).all()


def test_mnp_fit_and_variants(spark):
    df = spark.createDataFrame(choices(400, noise="normal"))
    r = MNP(df, ALTS, SPEC).fit(30)
    assert abs(r.theta - [0.4, -0.3, 0.8]).max() < 0.35 and r.converged
    frozen = MNP(df, ALTS, SPEC).fit(10, active=np.array([True, False, True]))
    assert frozen.theta[1] == 0.0
    wide = MNP(df, ALTS, SPEC, structure="full", random=["b"], correlated=True, segments=2)
    assert len(wide.names) == 3 + 1 + 1 + 1 + 1 + 4
    wide.from_estimates([0.4, -0.3, 0.8], np.array([[1.0, 0.5], [0.5, 1.2]]), theta_rest=[0.2, -0.5, 0.1, 0.1, 0.3, 0.4])
    shares = wide.ate({"s": {"x0": 0.0}}).groupBy("scenario").sum("share").collect()
    assert all(r[1] == pytest.approx(1, abs=1e-9) for r in shares)
    with pytest.raises(ValueError):
        MNP(df, ALTS, SPEC, random=["nothing"])


def test_mnp_availability_and_four_alternatives():
    v, kernel = np.array([[0.2, 0.1, -0.3, 0.4]]), 0.5 * np.eye(3) + 0.5
    some = np.array([[1.0, 1.0, 0.0, 1.0]])
    p = [mnp.probabilities(v, kernel, np.array([c]), some, "exact")[0] for c in range(4)]
    assert p[2] == 0 and sum(p) == pytest.approx(1, abs=1e-6)
    three = [mnp.probabilities(v[:, [0, 1, 3]], 0.5 * np.eye(2) + 0.5, np.array([c]), np.ones((1, 3)), "exact")[0] for c in range(3)]
    np.testing.assert_allclose([p[0], p[1], p[3]], three, atol=1e-6)
    assert mvn_cdf(np.array([[np.inf, np.inf]]), np.eye(2))[0] == 1


def ordinal(n=300, seed=42, rho=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    e = rng.multivariate_normal([0, 0], [[1, rho], [rho, 1]], n)
    return pd.DataFrame({"x1": x[:, 0], "x2": x[:, 1], "y1": np.digitize(0.5 * x[:, 0] + e[:, 0], [-0.5, 0.5]) + 1, "y2": np.digitize(-0.3 * x[:, 1] + e[:, 1], [-0.3, 0.7])})


ORD = {"a": {"y1": "x1"}, "b": {"y2": "x2"}}


@pytest.mark.parametrize("structure", ["iid", "full"])
def test_morp_fit(spark, structure):
    m = MORP(spark.createDataFrame(ordinal()), ["y1", "y2"], ORD, structure=structure, all_se=True)
    r = m.fit(40)
    truth = [0.5, -0.3, -0.5, 0.5, -0.3, 0.7] + ([0.3] if structure == "full" else [])
    assert abs(r.theta - truth).max() < 0.35 and (r.se > 0).all()
    assert {k: v.shape for k, v in r.extra["cov"].items()} == {k: (len(truth),) * 2 for k in ("bhhh", "hessian", "sandwich")}
    np.testing.assert_allclose(np.sqrt(np.diag(r.extra["cov"]["hessian"])), r.se, rtol=0.5)
    again = MORP(spark.createDataFrame(ordinal()), ["y1", "y2"], ORD, structure=structure)
    again.from_estimates(r.theta[:2], [r.theta[2:4], r.theta[4:6]], None if structure == "iid" else np.array([[1, r.theta[6]], [r.theta[6], 1]]))
    np.testing.assert_allclose(again.results.extra["theta"], r.extra["theta"], atol=1e-9)
    one, two = (x.ate({"s": {"x1": 1.0}}).toPandas()["share"] for x in (m, again))
    np.testing.assert_allclose(one, two, atol=1e-9)
    joint = m.joint().toPandas()
    assert joint["probability"].sum() == pytest.approx(1, abs=1e-6) and len(joint) == 9
    marginal = m.ate().toPandas()
    for c in (1, 2, 3):
        assert joint[joint.y1 == c]["probability"].sum() == pytest.approx(marginal[(marginal.outcome == "y1") & (marginal.category == c)]["share"].iloc[0], abs=1e-6)


def test_morp_keeps_lowest_category_and_refuses(spark):
    m = MORP(spark.createDataFrame(ordinal()), ["y1", "y2"], ORD)
    m.bind()
    assert m.lowest == [1.0, 0.0] and m.categories == [3, 3]
    with pytest.raises(ValueError, match="rise"):
        m.from_estimates([0, 0], [(0.5, 0.1), (0.0, 1.0)])
    with pytest.raises(ValueError):
        MORP(m.df, ["y1"], {"a": {"y1": "x1"}}, structure="odd")


def spending(n=60):
    rng = np.random.default_rng(123)
    return pd.DataFrame({"id": range(n), "x1": rng.normal(size=n), "x2": rng.normal(size=n), "out": rng.uniform(0.1, 2, n), "a": rng.uniform(0, 2, n) * (rng.random(n) < 0.7), "b": rng.uniform(0, 2, n) * (rng.random(n) < 0.5)})


def test_mdcev_fit_forecast(spark):
    df = spark.createDataFrame(spending())
    m = MDCEV(df, ["out", "a", "b"], {"asc_a": {"a": "uno"}, "x": {"a": "x1", "b": "x2"}}, {"ga": {"a": "uno"}, "gb": {"b": "uno"}})
    start = m.from_estimates([0, 0], [0, 0], 1.0)
    before = df.select(m.loglik_column().alias("l")).agg({"l": "avg"}).first()[0]
    r = m.fit(25)
    assert r.loglik > before and r.theta[-1] > 0 and len(start.theta) == 5
    assert df.select(m.loglik_column().alias("l")).agg({"l": "avg"}).first()[0] == pytest.approx(r.loglik, abs=1e-9)
    f = m.forecast(budget=3.0, replications=5, id_column="id").toPandas()
    assert len(f) == 300
    np.testing.assert_allclose(f[["out", "a", "b"]].sum(axis=1), 3.0, atol=1e-9)
    g = MDCEV(df.repartition(5), ["out", "a", "b"], {"asc_a": {"a": "uno"}, "x": {"a": "x1", "b": "x2"}}, {"ga": {"a": "uno"}, "gb": {"b": "uno"}})
    g.results = m.results
    again = g.forecast(budget=3.0, replications=5, id_column="id").toPandas()
    key = ["row_id", "replication"]
    np.testing.assert_allclose(f.sort_values(key).to_numpy(), again.sort_values(key).to_numpy())
    assert m.predict(budget=3.0, replications=5).agg({"rate": "sum"}).first()[0] == pytest.approx(1.0)


def test_mdcev_allocation_is_optimal():
    rng = np.random.default_rng(5)
    v, p, f, money = rng.normal(size=(200, 4)), rng.uniform(0.5, 2, (200, 4)), rng.uniform(0.5, 2, (200, 4)), rng.uniform(1, 5, 200)
    q = mdcev.allocate(v, p, f, money)
    np.testing.assert_allclose((q * p).sum(axis=1), money)
    assert (q >= 0).all() and (q[:, 0] > 0).all()
    level = np.exp(v[:, 0]) / (q[:, 0] * p[:, 0])
    gain = np.exp(v[:, 1:]) / p[:, 1:] / (q[:, 1:] / f[:, 1:] + 1)
    used = q[:, 1:] > 0
    np.testing.assert_allclose(gain[used], np.broadcast_to(level[:, None], used.shape)[used])
    assert (gain[~used] <= np.broadcast_to(level[:, None], used.shape)[~used] + 1e-12).all()


def test_optimizers():
    rosen = lambda x: ((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)]))
    for method in ("bfgs", "lbfgs"):
        np.testing.assert_allclose(minimize(rosen, np.array([-1.2, 1.0]), method=method, tolerance=1e-8).theta, [1, 1], atol=1e-5)
    bound = minimize(rosen, np.array([-1.2, 1.0]), bounds=[(None, 0.5), (None, None)])
    np.testing.assert_allclose(bound.theta, [0.5, 0.25], atol=1e-3)
    square = newton(lambda x: (float(x @ x), 2 * x, 2 * np.eye(2)), np.array([3.0, -4.0]))
    assert square.converged and np.abs(square.theta).max() < 1e-9


def test_covariances_agree_when_information_does():
    h = np.array([[4.0, 1.0], [1.0, 3.0]])
    for kind in ("bhhh", "hessian", "sandwich"):
        np.testing.assert_allclose(covariance(kind, h, h), np.linalg.inv(h))
    with pytest.raises(ValueError):
        covariance("other", h, h)


def test_nulls_are_refused_everywhere(spark):
    """A null in a column of a model stops fits, predictions and effects alike; shares of whole tables add up to one."""
    df = spark.createDataFrame(choices(40).assign(a=1.0, other=2.0))
    hole = lambda c: df.withColumn(c, F.when(F.col("x0") > F.lit(0.0), F.col(c)))
    for column in ("a", "x1"):
        m = MNL(hole(column), ALTS, SPEC, availability=["a", "a", "a"])
        m.from_estimates([0.1, 0.2, 0.3])
        p = MNP(hole(column), ALTS, SPEC, availability=["a", "a", "a"])
        p.from_estimates([0.1, 0.2, 0.3])
        for act in (m.fit, p.fit):
            with pytest.raises(ValueError, match="nulls"):
                act()
        for act in (lambda m=m: m.predict().collect(), lambda m=m: m.ate().collect(), lambda p=p: p.predict().collect(), lambda p=p: p.ate().collect()):
            with pytest.raises(Exception, match="nulls in columns of the model: " + column):
                act()
    with pytest.raises(ValueError, match="nulls"):
        MNL(hole("c1"), ALTS, SPEC).fit()
    m = MNL(hole("other"), ALTS, SPEC)
    m.from_estimates([0.1, 0.2, 0.3])
    assert m.ate({"s": {"x1": 1.0}}).groupBy("scenario").sum("share").collect()[0][1] == pytest.approx(1)
    with pytest.raises(Exception, match="nulls in columns"):
        m.ate({"s": {"x1": "other"}}).collect()
    money = spark.createDataFrame(spending(20).assign(price=1.0, w=1.0, tot=3.0))
    goods = ["out", "a", "b"]
    for column in ("price", "w", "tot", "x1", "a"):
        d = money.withColumn(column, F.when(F.col("id") != 3, F.col(column)))
        c = MDCEV(d, goods, {"x": {"a": "x1"}}, {"ga": {"a": "uno"}}, prices=["price"] * 3, weight="w")
        c.from_estimates([0.1], [0.2], 1.0)
        if column != "tot":
            with pytest.raises(ValueError, match="nulls"):
                c.fit()
        if column != "a":  # forecasts do not read quantities
            with pytest.raises(Exception, match="nulls in columns"):
                c.participation(replications=2).collect()


def by_differences(kernel, theta, data):
    from prefero.plans.likelihood import scores

    return scores(kernel, theta, data, np.ones(len(theta), bool), np.ones(len(data["x"])))


MNP_KINDS = {
    "two": (2, {}), "iid": (3, {}), "hetero": (3, {"structure": "heteronly"}), "full": (3, {"structure": "full"}), "four": (4, {"structure": "full"}), "four_exact": (4, {"structure": "full", "method": "exact"}),
    "five_tvbs": (5, {"structure": "full", "method": "tvbs"}), "five_bme": (5, {"method": "bme"}), "random": (3, {"random": ["b"]}), "random_four": (4, {"structure": "full", "random": ["asc1", "b"], "correlated": True}),
    "mixture": (3, {"segments": 2}), "mixture_random": (4, {"structure": "heteronly", "segments": 3, "random": ["b", "asc1"]}), "mixture_correlated": (3, {"segments": 2, "random": ["b", "asc1"], "correlated": True}),
}


@pytest.mark.parametrize("kind", list(MNP_KINDS))
def test_probit_scores_by_differences(spark, kind):
    """Each row's score is the derivative of the very approximation, with and without all alternatives available."""
    rng = np.random.default_rng(3)
    j, how = MNP_KINDS[kind]
    names = [f"c{k}" for k in range(j)]
    spec = {"asc1": {"c1": "uno"}, "b": {a: f"x{k}" for k, a in enumerate(names)}}
    m = MNP(spark.createDataFrame(pd.DataFrame({c: [1.0] for k in range(j) for c in (f"c{k}", f"x{k}")})), names, spec, **how)
    n, v = 60, 2
    data = {"x": rng.normal(size=(n, j, v)), "y": rng.integers(0, j, n), "a": np.ones((n, j))}
    data["a"][: n // 3, 1] = data["y"][: n // 3] == 1
    theta = rng.normal(0, 0.3, len(m.names))
    kernel = lambda t, d: np.log(m.row_probabilities(t, d["x"], d["y"], d["a"]))
    value, score = m.row_scores(theta, data["x"], data["y"], data["a"])
    np.testing.assert_allclose(value, kernel(theta, data), atol=1e-9)
    np.testing.assert_allclose(score, by_differences(kernel, theta, data), atol=2e-6)


@pytest.mark.parametrize("outcomes", [1, 2, 3, 4])
@pytest.mark.parametrize("fix_scales", [True, False])
def test_ordered_scores_by_differences(spark, outcomes, fix_scales):
    rng = np.random.default_rng(outcomes)
    names = [f"y{i}" for i in range(outcomes)]
    df = spark.createDataFrame(pd.DataFrame({y: [0, 1 + i % 3] for i, y in enumerate(names)} | {"x": [0.0, 1.0], "z": [1.0, 0.0]}))
    m = MORP(df, names, {"a": {y: "x" for y in names}, "b": {names[-1]: "z"}}, structure="full", fix_scales=fix_scales)
    m.bind()
    n, theta = 40, rng.normal(0, 0.3, len(m.names))
    data = {"x": rng.normal(size=(n, outcomes, 2)), "y": np.stack([rng.integers(0, c, n) for c in m.categories], axis=1)}
    kernel = lambda t, d: np.log(np.maximum(m._probabilities(t, d["x"] @ m.unpack(t)[0], d["y"]), 1e-300))
    value, score = m.row_scores(theta, data["x"], data["y"])
    np.testing.assert_allclose(value, kernel(theta, data), atol=1e-9)
    np.testing.assert_allclose(score, by_differences(kernel, theta, data), atol=2e-6, rtol=1e-5)


@pytest.mark.parametrize("structure", ["iid", "heteronly"])
def test_ordered_columns_equal_kernel(spark, structure):
    """Independent outcomes: terms as Columns against the batch kernel and its differences; the Hessian is symmetric in both."""
    from prefero.plans.likelihood import Closed

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"y": rng.integers(1, 5, 50), "z": rng.integers(0, 2, 50), "w": rng.integers(0, 3, 50), "x": rng.normal(size=50), "_m0": rng.normal(size=50)})
    m = MORP(spark.createDataFrame(pdf), ["y", "z", "w"], {"b": {"y": "x", "w": "x"}, "c": {"z": "_m0", "y": 0.5}}, structure=structure)
    m.bind()
    theta = rng.normal(0, 0.3, len(m.names))
    closed = Closed(m._rows(), m.terms, len(theta))
    lik = Likelihood(m.df.select(*m._packed(), m._answers().alias("y")), m._kernel(3, 2), len(theta))
    for a, b, tolerance in zip(closed.at(theta), lik.at(theta), (0, 1e-9, 1e-5, 1e-4), strict=True):
        np.testing.assert_allclose(a, b, atol=tolerance, rtol=1e-6)
    np.testing.assert_allclose(closed.hessian(theta), lik.hessian(theta), atol=2e-2, rtol=1e-3)
    np.testing.assert_allclose(closed.values([theta, theta + 0.1])[1], lik.values([theta, theta + 0.1])[1])


@pytest.mark.parametrize("structure", ["iid", "full"])
def test_ordered_fit_reads_each_different_row_once(spark, monkeypatch, structure):
    """Repeated rows are one row to each step, in Columns and in the kernel; sums are those of all rows."""
    from prefero.plans.likelihood import Closed

    rng = np.random.default_rng(8)
    few = pd.DataFrame({"y": rng.integers(0, 3, 30), "z": rng.integers(0, 2, 30), "x": rng.normal(size=30)})
    every = few.loc[few.index.repeat(1 + np.arange(30) % 9)]
    m = MORP(spark.createDataFrame(every), ["y", "z"], {"b": {"y": "x", "z": "x"}}, structure=structure)
    one = m._likelihood()
    theta = np.full(len(m.names), 0.2)
    all_rows = Closed(m._rows(), m.terms, len(theta)) if structure == "iid" else Likelihood(m.df.select(*m._packed(), m._answers().alias("y")), m._kernel(2, 1), len(theta), scored=m._scored(2, 1))
    for a, b in zip(one.at(theta), all_rows.at(theta), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(one.hessian(theta), all_rows.hessian(theta), rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose(one.values([theta, -theta])[1], all_rows.values([theta, -theta])[1])
    read, fitted = rows_of_a_fit(monkeypatch, Closed if structure == "iid" else Likelihood, m)
    assert read == [30] and fitted.n == len(every)


@pytest.mark.parametrize("traditional", [True, False])
def test_mdcev_scores_by_differences(spark, traditional):
    from prefero.plans.likelihood import Closed

    df = spark.createDataFrame(spending().assign(w=lambda d: 0.5 + d["x1"].abs(), p=lambda d: 1 + d["x2"].abs(), one=1.0))
    m = MDCEV(df, ["out", "a", "b"], {"asc_a": {"a": "uno"}, "x": {"out": "x2", "a": "x1", "b": "x2"}}, {"ga": {"a": "uno", "b": "x1"}, "gb": {"b": "uno"}}, ["one", "p", "p"], traditional, "w")
    lik, theta = Closed(m._rows(), m.terms, 5), np.array([0.2, -0.3, 0.1, -0.2, 0.15])
    rows = lik.frame([theta], True).toPandas()
    m.from_estimates(theta[:2], theta[2:4], float(np.exp(theta[4])))
    np.testing.assert_allclose(sorted(rows["ll"]), sorted(r[0] for r in df.select(m.loglik_column()).collect()), atol=1e-12)
    h = 1e-5
    points = [theta + s * h * e for e in np.eye(5) for s in (1, -1)]
    at = lik.frame(points, False).toPandas()
    key = [c for c in rows.columns if c.startswith("_c")]
    for i in range(5):
        up, down = (at[at["_run"] == 2 * i + k].merge(rows, on=key, suffixes=("", "_0")) for k in (0, 1))
        np.testing.assert_allclose(up["g%d" % i], (up["ll"] - down["ll"]) / (2 * h), atol=1e-6)
    n, ll, g, outer = lik.at(theta)
    np.testing.assert_allclose(g, rows[[f"g{i}" for i in range(5)]].sum())
    np.testing.assert_allclose(outer, rows[[f"g{i}" for i in range(5)]].T @ rows[[f"g{i}" for i in range(5)]])
    np.testing.assert_allclose(lik.values(points)[1][:2], [lik.values([p])[1][0] for p in points[:2]])
    assert n == 60 and ll == pytest.approx(rows["ll"].sum())


def test_search_that_runs_out_has_not_converged():
    rosenbrock = lambda t: (100 * (t[1] - t[0] ** 2) ** 2 + (1 - t[0]) ** 2, np.array([-400 * t[0] * (t[1] - t[0] ** 2) - 2 * (1 - t[0]), 200 * (t[1] - t[0] ** 2)]))
    scaled = lambda t: tuple(x / 1000 for x in rosenbrock(t))
    for n in (3, 5, 10):
        out = minimize(scaled, np.array([-1.2, 1.0]), iterations=n)
        assert not out.converged and out.iterations == n
    for ladder in (None, lambda ts: [rosenbrock(t)[0] for t in ts]):
        out = minimize(rosenbrock, np.array([-1.2, 1.0]), ladder=ladder)
        assert out.converged and np.allclose(out.theta, 1, atol=1e-4)


def test_ladder_saves_jobs():
    """Steps far too long: shorter ones are tried in one call, so a step takes three calls at most."""
    calls = []

    def f(t):
        calls.append("f")
        return float((np.exp(t) - t).sum() + 1e4 * (t**4).sum()), np.exp(t) - 1 + 4e4 * t**3

    plain = minimize(f, np.array([3.0, -2.0]))
    before = len(calls)
    calls.clear()
    out = minimize(f, np.array([3.0, -2.0]), ladder=lambda ts: calls.append("ladder") or [f(t)[0] for t in ts if calls.pop() or True])
    assert out.converged and np.allclose(out.theta, plain.theta, atol=1e-3)
    assert len(calls) <= 3 * out.iterations + 1 and len(calls) <= before


def test_bounds_of_a_fit(spark):
    df = spark.createDataFrame(choices(200, noise="normal"))
    m = MNP(df, ALTS, SPEC)
    r = m.fit(bounds=[(None, None), (0.0, None), (None, 0.25)])
    assert r.theta[1] >= 0 and r.theta[2] <= 0.25 + 1e-12
    with pytest.raises(ValueError, match="bounds"):
        m.fit(bounds=[(None, 1.0)])


def test_names_and_nulls_that_clash(spark):
    """A column named as the operator's own comes through; no scenario stands in for the baseline; null quantities are refused."""
    df = spark.createDataFrame(choices(20, noise="normal").assign(_p=7.0))
    m = MNP(df, ALTS, SPEC)
    m.from_estimates([0.1, 0.2, 0.3])
    out = m.predict().toPandas()
    assert (out["_p"] == 7).all() and "_p_" not in out.columns
    logit = MNL(df, ALTS, SPEC)
    logit.from_estimates([0.1, 0.2, 0.3])
    for model in (m, logit):
        with pytest.raises(ValueError, match="baseline"):
            model.ate({"baseline": {"x1": 1.0}})
    pdf = spending(5)
    pdf.loc[2, "a"] = None
    d = MDCEV(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, x1 double, x2 double, out double, a double, b double"), ["out", "a", "b"], {"asc_a": {"a": "uno"}}, {"ga": {"a": "uno"}})
    d.from_estimates([0.1], [0.2], 1.0)
    with pytest.raises(Exception, match="nulls in columns of the model"):
        d.df.select(d.loglik_column().alias("l")).collect()


def test_reporting_space(spark):
    """Parameters go to the report and back; scores in its units give the standard errors that the delta method gives."""
    df = spark.createDataFrame(choices(150, noise="normal"))
    for how in ({"structure": "full"}, {"random": ["b", "asc1"], "correlated": True}, {"segments": 2, "random": ["b"]}):
        m = MNP(df, ALTS, SPEC, **how)
        theta = np.random.default_rng(1).normal(0.2, 0.2, len(m.names))
        natural = m.natural(theta)
        np.testing.assert_allclose(m.natural(m.theta_of(natural)), natural, atol=1e-8)
    m = MNP(df, ALTS, SPEC, structure="heteronly")
    r = m.fit()
    n, ll, g, outer = m.natural_sums(r.theta)
    assert n == 150 and ll == pytest.approx(r.loglik * 150)
    np.testing.assert_allclose(np.sqrt(np.diag(np.linalg.inv(outer))), r.se, rtol=1e-4)
    np.testing.assert_allclose(g / n, r.extra["natural_gradient"], atol=1e-8)
    rows = m.natural_scores(r.theta, ["x1"]).toPandas()
    s = np.stack(rows["score"].to_numpy())
    np.testing.assert_allclose(s.T @ s, outer, rtol=1e-9)
    h = 1e-5
    for i in range(len(r.theta)):
        e = np.eye(len(r.theta))[i] * h
        up, down = (m.natural_scores(r.theta + k * e, ["x1"]).toPandas().sort_values("x1")["loglik"].to_numpy() for k in (1, -1))
        np.testing.assert_allclose(np.stack(rows.sort_values("x1")["score"].to_numpy())[:, i], (up - down) / (2 * h), atol=1e-5)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"y": rng.integers(0, 3, 80), "z": rng.integers(0, 2, 80), "x": rng.normal(size=80)})
    for how in ({"structure": "heteronly"}, {"structure": "full", "fix_scales": False}):
        o = MORP(spark.createDataFrame(pdf), ["y", "z"], {"b": {"y": "x", "z": "x"}}, **how)
        fit = o.fit(30)
        n, ll, g, outer = o.natural_sums(fit.theta)
        np.testing.assert_allclose(np.sqrt(np.maximum(np.diag(np.linalg.pinv(outer)), 0)), fit.se, rtol=2e-2, atol=1e-3)
        np.testing.assert_allclose(g / n, fit.extra["natural_gradient"], atol=1e-7)


def test_reporting_space_of_spending(spark):
    m = MDCEV(spark.createDataFrame(spending()), ["out", "a", "b"], {"asc_a": {"a": "uno"}, "x": {"a": "x1", "b": "x2"}}, {"ga": {"a": "uno"}, "gb": {"b": "uno"}})
    r = m.fit()
    n, ll, g, outer = m.natural_sums(r.theta)
    assert r.converged and n == 60 and ll == pytest.approx(r.loglik * 60)
    np.testing.assert_allclose(np.sqrt(np.diag(np.linalg.inv(outer))), r.se, rtol=1e-6)


def test_forecast_with_row_values(spark):
    pdf = spending(20)
    df = spark.createDataFrame(pdf)
    m = MDCEV(df, ["out", "a", "b"], {"asc_a": {"a": "uno"}, "x": {"a": "x1", "b": "x2"}}, {"ga": {"a": "uno"}, "gb": {"b": "uno"}})
    m.from_estimates([0.3, 0.5], [0.1, 0.2], 0.9)
    new = pdf[["id"]].assign(x1=np.linspace(-2, 2, 20))
    got = m.forecast(3.0, 3, id_column="id", values=spark.createDataFrame(new)).toPandas()
    other = MDCEV(spark.createDataFrame(pdf.assign(x1=new["x1"])), ["out", "a", "b"], {"asc_a": {"a": "uno"}, "x": {"a": "x1", "b": "x2"}}, {"ga": {"a": "uno"}, "gb": {"b": "uno"}})
    other.results = m.results
    want, key = other.forecast(3.0, 3, id_column="id").toPandas(), ["row_id", "replication"]
    np.testing.assert_allclose(got.sort_values(key).to_numpy(), want.sort_values(key).to_numpy())
    for bad, said in ((pd.concat([new, new[:1]]), "repeat"), (new[1:], "without"), (new.assign(q=1.0), "does not have"), (new[["id"]].assign(id=lambda d: d["id"] + 1), "without")):
        with pytest.raises(ValueError, match=said):
            m.forecast(3.0, 3, id_column="id", values=spark.createDataFrame(bad))
    with pytest.raises(ValueError, match="id column"):
        m.forecast(3.0, 3, values=spark.createDataFrame(new))


def test_joint_of_the_lattice(spark):
    """Differences on the lattice equal one rectangle for each combination, in slabs or not, and add up to one."""
    import itertools

    from prefero.operators import morp

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": rng.normal(size=30), "y": 0, "z": 0, "w": 0})
    corr = np.array([[1.0, -0.3, 0.2], [-0.3, 1.0, 0.5], [0.2, 0.5, 1.0]])
    m = MORP(spark.createDataFrame(pdf), ["y", "z", "w"], {"b": {"y": "x", "w": "x"}}, structure="full", method="exact")
    m.from_estimates((0.4,), [(-1.0, -0.2, 0.3, 0.8), (0.1,), (-0.5, 0.6)], corr, lowest=[0, 0, 0])
    got = m.joint().toPandas().set_index(["y", "z", "w"])["probability"]
    theta = m.results.extra["theta"]
    means = pdf["x"].to_numpy()[:, None] * np.array([0.4, 0.0, 0.4])
    for c in itertools.product(range(5), range(2), range(3)):
        assert got[tuple(x + 1 for x in c)] == pytest.approx(m._probabilities(theta, means, np.tile(c, (30, 1))).mean(), abs=1e-9)
    assert got.sum() == pytest.approx(1, abs=1e-9)
    before, morp.VERTICES = morp.VERTICES, 6
    try:
        again = m.joint().toPandas().set_index(["y", "z", "w"])["probability"]
    finally:
        morp.VERTICES = before
    np.testing.assert_allclose(again.sort_index(), got.sort_index(), atol=1e-12)


def test_frozen_parameters(spark):
    df = spark.createDataFrame(choices(100, noise="normal"))
    r = MNP(df, ALTS, SPEC).fit(30, active=np.array([True, False, True]))
    assert np.isnan(r.se[1]) and (r.se[[0, 2]] > 0).all() and r.theta[1] == 0
    with pytest.raises(ValueError, match="mask"):
        MNP(df, ALTS, SPEC).fit(active=np.array([True, False]))


def test_effects_of_one_cell_and_comparisons(spark):
    """One cell held at two values equals a scenario where the column is that cell alone; comparisons of ordinal outcomes."""
    from prefero.operators.scenario import comparison, summary

    df = spark.createDataFrame(choices(60))
    as_dict = lambda rows, *keys: {tuple(r[k] for k in keys): r["share"] for r in rows.collect()}
    m = MNP(df, ALTS, SPEC)
    m.from_estimates([0.4, -0.3, 0.8])
    cell, whole = as_dict(m.ate_cell("c1", "b", 0.0, 1.0), "scenario", "alternative"), as_dict(m.ate({"s": {"x1": 1.0}}), "scenario", "alternative")
    assert all(cell["treatment", a] == pytest.approx(whole["s", a]) for a in ALTS)
    o = MORP(spark.createDataFrame(ordinal(80)), ["y1", "y2"], ORD)
    o.from_estimates([0.5, -0.3], [(-0.5, 0.5), (-0.3, 0.7)])
    cell, whole = (as_dict(x, "scenario", "outcome", "category") for x in (o.ate_cell("y1", "a", 0.0, 1.0), o.ate({"s": {"x1": 1.0}})))
    assert all(cell["treatment", k, c] == pytest.approx(whole["s", k, c]) for _, k, c in cell)
    table = comparison(o.ate({"s": {"x1": 1.0}}), "baseline", "s").toPandas()
    assert len(table) == 6 and table.groupby("outcome")[["base", "treatment"]].sum().to_numpy() == pytest.approx(np.ones((2, 2)))
    assert "y1" in summary(o.ate())
    with pytest.raises(ValueError, match="no values"):
        MORP(spark.createDataFrame(ordinal(5)).limit(0), ["y1", "y2"], ORD).fit()
    c = MDCEV(spark.createDataFrame(spending(30)), ["out", "a", "b"], {"x": {"a": "x1", "b": "x2"}}, {"ga": {"a": "uno"}})
    c.from_estimates([0.4], [0.2], 1.0)
    kw = {"budget": 3.0, "replications": 3, "id_column": "id"}
    cell, whole = as_dict(c.ate_cell("a", "x", 0.0, 1.0, **kw), "scenario", "alternative"), as_dict(c.ate({"s": {"x1": 1.0}}, **kw), "scenario", "alternative")
    assert all(cell["treatment", g] == pytest.approx(whole["s", g]) for g in ("out", "a", "b"))


def test_tables_of_text(spark, tmp_path):
    from prefero.sources.tables import read_table

    def read(name, text):
        (tmp_path / name).write_text(text)
        return [tuple(r) for r in read_table(spark, str(tmp_path / name)).collect()]

    assert read("a.txt", "id,name,x\n1,bob,2\n2,,3\n3,al,\n\n") == [(1, "bob", 2), (2, None, 3), (3, "al", None)]
    assert read("b.dat", "  id   x\n 1\t0.5\n2   1\n") == [(1, 0.5), (2, 1.0)]
    assert read("c.dat", "\tid x y\n\t1 1.0 2.5\n2\t 3  4\n") == [(1, 1.0, 2.5), (2, 3.0, 4.0)]
    assert read("d.txt", 'id, name\n1,"Smith, J"\n2, "a ""b"" c" \n') == [(1, "Smith, J"), (2, 'a "b" c')]
    assert read("e.dat", 'id name\n1 "two words"\n2 one\n') == [(1, "two words"), (2, "one")]
    assert read("f.txt", "a b\nx y\na b\n") == [("x", "y"), ("a", "b")]
    assert read("g.txt", "zip x\n007 NaN\n010 1\n")[0][0] == "007"
    assert read("h.txt", "\n") == []
    for text in ("id x\n1 2 3\n", "id x\n1\n", "id,x\n1,2,3\n"):
        with pytest.raises(Exception, match="(?i)malformed"):
            read("ragged.txt", text)
    (tmp_path / "many").mkdir()
    for k in range(2):
        (tmp_path / "many" / f"{k}.txt").write_text(f"id x\n{k} 1\n")
    assert sorted(tuple(r) for r in read_table(spark, str(tmp_path / "many"), "spaced").collect()) == [(0, 1), (1, 1)]


def _mean_probabilities(m, x, available):
    return m._ready()._all(np.asarray(x, float).reshape(len(x), -1), np.asarray(available, float)).mean(axis=0)


def test_probit_shares_read_each_column_once(spark):
    """Rows reach the tasks as the columns that the scenarios read, none twice and nothing packed; cells are filled there."""
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"x0": rng.normal(size=40), "x1": rng.integers(-3, 3, 40), "av": rng.integers(0, 2, 40), "on": 1})
    rows = pd.concat([rows, rows.iloc[:5]], ignore_index=True)
    names = ["a", "b", "c", "d"]
    spec = {"asc": {"b": "uno", "c": 0.5}, "beta": {"a": "x0", "b": "x1", "d": "x0"}}
    m = MNP(spark.createDataFrame(rows), names, spec, availability=["on", "av", "on", "on"], structure="full", method="exact")
    m.from_estimates([0.3, -0.6], np.array([[1.0, 0.4, 0.3], [0.4, 1.2, 0.5], [0.3, 0.5, 0.9]]))
    frame = m.ate({"swap": {"x0": "x1", "x1": "x0"}, "held": {"x1": 2}})
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "array(" not in plan and plan.count(" AS c") == 4, plan
    got = frame.toPandas().pivot(index="scenario", columns="alternative", values="share")[names]
    one, x0, x1, av = np.ones(len(rows)), rows["x0"].to_numpy(), rows["x1"].to_numpy(float), rows["av"].to_numpy(float)
    for scenario, (p, q) in {"baseline": (x0, x1), "swap": (x1, x0), "held": (x0, 2 * one)}.items():
        x = np.stack([0 * one, p, one, q, 0.5 * one, 0 * one, 0 * one, p], axis=1)
        np.testing.assert_allclose(got.loc[scenario], _mean_probabilities(m, x, np.stack([one, av, one, one], axis=1)), atol=1e-12)
    cell = m.ate_cell("d", "beta", 0.0, 1.5).toPandas().pivot(index="scenario", columns="alternative", values="share")[names]
    x = np.stack([0 * one, x0, one, x1, 0.5 * one, 0 * one, 0 * one, 1.5 * one], axis=1)
    np.testing.assert_allclose(cell.loc["treatment"], _mean_probabilities(m, x, np.stack([one, av, one, one], axis=1)), atol=1e-12)
    with pytest.raises(ValueError, match="nothing"):
        m.ate({"s": {"nothing": 1.0}})


def test_probit_shares_without_columns_or_rows(spark):
    """A specification of constants reads no column, and still counts every row; no rows have no shares."""
    df = spark.range(30).selectExpr("id AS k")
    m = MNP(df, ["a", "b", "c", "d"], {"asc": {"b": "uno", "d": -0.5}})
    m.from_estimates([0.4])
    got = {r["alternative"]: r["share"] for r in m.ate().collect()}
    np.testing.assert_allclose([got[n] for n in "abcd"], _mean_probabilities(m, [[0.0, 1.0, 0.0, -0.5]], np.ones((1, 4))), atol=1e-12)
    m.df = m.df.limit(0)
    assert all(r["share"] is None for r in m.ate().collect())


def test_normal_columns_keep_their_values_on_odd_rows(spark):
    from prefero.functions.algebra import ARRAYS
    from prefero.functions.distributions import normal_cdf

    xs = [0.0, -0.0, 3.0, -3.0, 7.0, 7.5, -7.5, -36.0, 38.0, -38.0, float("inf"), float("-inf")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x"))).collect()]
    np.testing.assert_allclose(got, normal_cdf(np.clip(xs, -40, 40), ARRAYS), rtol=1e-13, atol=0)
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(normal_cdf(F.col("x"))).collect()
    assert [r[0] for r in odd] == [None, 1.0]  # to Spark, NaN is above every number


@pytest.mark.parametrize("corr", [0.2, 0.5, -0.5, 0.9])
def test_probit_columns_are_short_enough_to_be_compiled(spark, capsys, corr):
    """The JVM leaves generated methods of more than 8,000 bytes to its interpreter."""
    m = MNP(spark.createDataFrame(choices(20)), ALTS, SPEC, structure="full")
    m.from_estimates([0.4, -0.3, 0.8], np.array([[1.0, 1.2 * corr], [1.2 * corr, 1.44]]))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capsys.readouterr()
        mean_by_scenario(m.df, {"baseline": m.closed_shares()}, ALTS).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000, sizes
