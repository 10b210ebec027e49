"""The library's own queries over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefero.functions import distributions as dist
from prefero.functions.algebra import COLUMNS
from prefero.kernels.mvn import METHODS, mvn_cdf
from prefero.operators import mnp, scenario
from prefero.operators.mnl import MNL, sums
from prefero.operators.mnp import MNP
from prefero.operators.morp import MORP, marginal
from prefero.operators.mdcev import MDCEV
from prefero.operators.spec import choice_index, compile_spec, rebased, spec_of_matrix
from prefero.plans.likelihood import Closed

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that checks it."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- integrals for the SQL, apart from the library's formulas ---------------------------------------

#: Nodes and weights on [0, 1] for the SQL's own integrals.
_UNIT = [(float((1 + x) / 2), float(w / 2)) for x, w in zip(*np.polynomial.legendre.leggauss(24), strict=True)]


def _normal_sql(h: str) -> str:
    """Normal distribution as a half plus the integral of the density from zero."""
    return f"(0.5 + ({h}) * 0.3989422804014327 * (" + " + ".join(f"{w!r} * exp(-0.5 * pow(({h}) * {x!r}, 2))" for x, w in _UNIT) + "))"


def _density_sql(h: str) -> str:
    return f"(0.3989422804014327 * exp(-0.5 * pow({h}, 2)))"


def _pair_sql(h: str, k: str, rho: str) -> str:
    """Bivariate normal distribution by the integral over the angle, for columns of limits and a correlation."""
    turn = lambda x: f"sin(asin({rho}) * {x!r})"
    inside = " + ".join(f"{w!r} * exp(({turn(x)} * {h} * {k} - ({h} * {h} + {k} * {k}) / 2.0) / (1.0 - pow({turn(x)}, 2)))" for x, w in _UNIT)
    return f"({_normal_sql(h)} * {_normal_sql(k)} + asin({rho}) * 0.15915494309189535 * ({inside}))"


def _nodes_sql(n: int) -> str:
    """Nodes x and weights w on [0, 1] as a list, for integrals inside integrals."""
    x, w = np.polynomial.legendre.leggauss(n)
    return "[" + ", ".join(f"{{'x': {float((1 + a) / 2)!r}, 'w': {float(b / 2)!r}}}" for a, b in zip(x, w, strict=True)) + "]"


def _listed_normal(u: str) -> str:
    """Normal distribution over the list of nodes ``t``."""
    u = f"greatest(least({u}, 8.0), -8.0)"
    return f"(0.5 + {u} * 0.3989422804014327 * list_sum(list_transform(t, lambda m: m.w * exp(-0.5 * pow({u} * m.x, 2)))))"


def _triple_sql(z: tuple[str, str, str], r12: float, r13: float, r23: float) -> str:
    """Trivariate normal distribution: over the first variable, the bivariate one of the others given it; lists of nodes ``t`` and ``tt``."""
    a, b = float(np.sqrt(1 - r12 * r12)), float(np.sqrt(1 - r13 * r13))
    rho = float((r23 - r12 * r13) / (a * b))
    at = f"(-8.0 + (least({z[0]}, 8.0) + 8.0) * e.x)"
    u, v = f"(({z[1]} - {r12!r} * {at}) / {a!r})", f"(({z[2]} - {r13!r} * {at}) / {b!r})"
    turn = f"sin(asin({rho!r}) * m.x)"
    pair = f"({_listed_normal(u)} * {_listed_normal(v)} + asin({rho!r}) * 0.15915494309189535 * list_sum(list_transform(t, lambda m: m.w * exp(({turn} * {u} * {v} - ({u} * {u} + {v} * {v}) / 2.0) / (1.0 - pow({turn}, 2))))))"
    return f"((least({z[0]}, 8.0) + 8.0) * list_sum(list_transform(tt, lambda e: e.w * {_density_sql(at)} * {pair})))"


def _ordered_sql(rows: str, cases: dict[str, tuple[tuple[str, str, str], np.ndarray]], keep: str) -> str:
    """Columns of the trivariate approximation that truncates one variable and looks at pairs, over ``rows``: name -> limits and correlations.

    Variables go by rising size of their limits.  The first pair is exact; once the first variable lies below its
    limit, the second pair has other means and covariances, and counts given its first variable.
    """
    sql = f"SELECT {keep}, " + ", ".join("list_sort([" + ", ".join(f"{{'size': abs({z}), 'i': {i + 1}, 'z': {z}}}" for i, z in enumerate(zs)) + f"]) AS s_{n}" for n, (zs, _) in cases.items()) + f" FROM ({rows})"
    flat = lambda r: "[" + ", ".join(repr(float(x)) for x in np.ravel(r)) + "]"
    steps = [
        lambda n, r: ", ".join([f"s_{n}[{i + 1}].z AS z{i}_{n}" for i in range(3)] + [f"{flat(r)}[(s_{n}[{i}].i - 1) * 3 + s_{n}[{j}].i] AS r{i}{j}_{n}" for i, j in ((1, 2), (1, 3), (2, 3))]),
        lambda n, r: f"*, -{_density_sql(f'z0_{n}')} / {_normal_sql(f'z0_{n}')} AS l_{n}",
        lambda n, r: f"*, -l_{n} * (z0_{n} - l_{n}) AS g_{n}",
        lambda n, r: f"*, (z1_{n} - r12_{n} * l_{n}) / sqrt(1.0 - g_{n} * r12_{n} * r12_{n}) AS v_{n}, (z2_{n} - r13_{n} * l_{n}) / sqrt(1.0 - g_{n} * r13_{n} * r13_{n}) AS w_{n}, (r23_{n} - g_{n} * r12_{n} * r13_{n}) / sqrt((1.0 - g_{n} * r12_{n} * r12_{n}) * (1.0 - g_{n} * r13_{n} * r13_{n})) AS c_{n}",
        lambda n, r: f"{_pair_sql(f'z0_{n}', f'z1_{n}', f'r12_{n}')} * {_pair_sql(f'v_{n}', f'w_{n}', f'c_{n}')} / {_normal_sql(f'v_{n}')} AS {n}",
    ]
    for k, step in enumerate(steps):
        parts = [step(n, r) for n, (_, r) in cases.items()]
        some = [x.removeprefix("*, ") for x in parts]
        sql = f"SELECT {'*' if k not in (0, len(steps) - 1) else keep}, {', '.join(some)} FROM ({sql})"
    return sql


# --- multinomial logit: the priority of an order --------------------------------------------------

PRIORITIES = ("urgent", "high", "medium", "unspecified", "low")
MNL_SPEC = {f"asc_{p}": {p: "uno"} for p in PRIORITIES[1:]} | {"price": {p: "price" for p in PRIORITIES[1:4]}, "month": {"urgent": "month", "low": "half"}}
MNL_BETA = (0.2, -0.1, 0.3, 0.1, -0.05, 0.04)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    first = F.substring("o_orderpriority", 1, 1).cast("int")
    month = F.month("o_orderdate") / 12.0
    return o.select("o_orderkey", *[(first == k + 1).cast("int").alias(p) for k, p in enumerate(PRIORITIES)], (F.col("o_totalprice") / 1e5).alias("price"), month.alias("month"), (month / 2.0).alias("half"))


def _mnl(spark: SparkSession, sf_dir: str, se: str = "bhhh") -> MNL:
    model = MNL(_orders(spark, sf_dir), PRIORITIES, MNL_SPEC, se=se)
    model.from_estimates(MNL_BETA)
    return model


def _mnl_utilities(price: str = "price", month: str = "month", half: str = "half") -> list[str]:
    return [f"0.04 * {month}", f"0.2 + -0.05 * {price}", f"-0.1 + -0.05 * {price}", f"0.3 + -0.05 * {price}", f"0.1 + 0.04 * {half}"]


_ORDERS_SQL = """o AS (SELECT o_orderkey, substr(o_orderpriority, 1, 1)::INT - 1 AS y, o_totalprice / 1e5 AS price, month(o_orderdate) / 12.0 AS month, month(o_orderdate) / 24.0 AS half FROM orders)"""


def _softmax_sql(utilities: list[str], source: str = "o", keep: str = "y, price, month, half, o_orderkey") -> str:
    e = ", ".join(f"exp({u}) AS e{k}" for k, u in enumerate(utilities))
    s = " + ".join(f"e{k}" for k in range(len(utilities)))
    p = ", ".join(f"e{k} / ({s}) AS p{k}" for k in range(len(utilities)))
    return f"e AS (SELECT {keep}, {e} FROM {source}), p AS (SELECT {keep}, {p} FROM e)"


_MNL_CTE = f"WITH {_ORDERS_SQL}, {_softmax_sql(_mnl_utilities())}"


def _shares_sql(names: tuple[str, ...], label: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {label}'{n}' AS alternative, round(avg(p{k}), 6) AS share FROM p" for k, n in enumerate(names))


@_query(f"{_MNL_CTE} {_shares_sql(PRIORITIES, chr(39) + 'baseline' + chr(39) + ' AS scenario, ')}")
def mnl_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean predicted shares of the priorities."""
    return _rounded(_mnl(spark, sf_dir).ate(), "share")


@_query(f"{_MNL_CTE} SELECT o_orderkey, {', '.join(f'round(p{k}, 6) AS p_{n}' for k, n in enumerate(PRIORITIES))}, (list_position([p0, p1, p2, p3, p4], greatest(p0, p1, p2, p3, p4)) - 1)::INT AS predicted FROM p")
def mnl_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"p_{p}" for p in PRIORITIES]
    return _rounded(_mnl(spark, sf_dir).predict().select("o_orderkey", *names, "predicted"), *names)


def _mnl_sums(spark: SparkSession, sf_dir: str) -> tuple:
    m = _mnl(spark, sf_dir)
    return sums(m.df, m.design, MNL_BETA, m.y)


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@_query(f"{_MNL_CTE} SELECT count(*) AS n, round(sum(ln(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END, 1e-4))), 4) AS loglik FROM p")
def mnl_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, ll, *_ = _mnl_sums(spark, sf_dir)
    return _frame(spark, [(n, round(ll, 4))], "n long, loglik double")


#: Value of each coefficient's column in each alternative, in SQL.
_X = [[None, "1.0", None, None, None], [None, None, "1.0", None, None], [None, None, None, "1.0", None], [None, None, None, None, "1.0"], [None, "price", "price", "price", None], ["month", None, None, None, "half"]]
_MEANS = [" + ".join(f"p{j} * {c}" for j, c in enumerate(row) if c) for row in _X]
_SCORES = [f"(CASE y {' '.join(f'WHEN {j} THEN {c}' for j, c in enumerate(row) if c)} ELSE 0.0 END - ({mean}))" for row, mean in zip(_X, _MEANS, strict=True)]
_PAIRS = [(a, b) for a in range(6) for b in range(a, 6)]


@_query(f"{_MNL_CTE} " + " UNION ALL ".join(f"SELECT '{n}' AS coefficient, round(sum({s}), 4) AS score FROM p" for n, s in zip(MNL_SPEC, _SCORES, strict=True)))
def mnl_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _mnl_sums(spark, sf_dir)[2]
    return _frame(spark, [(n, round(float(x), 4)) for n, x in zip(MNL_SPEC, g, strict=True)], "coefficient string, score double")


def _sums_sql(terms: list[str]) -> str:
    return f"{_MNL_CTE} " + " UNION ALL ".join(f"SELECT {a} AS i, {b} AS j, round(sum({t}), 3) AS value FROM p" for (a, b), t in zip(_PAIRS, terms, strict=True))


def _upper(spark: SparkSession, x: np.ndarray) -> DataFrame:
    return _frame(spark, [(a, b, round(float(x[a, b]), 3)) for a, b in _PAIRS], "i int, j int, value double")


@_query(_sums_sql([f"({' + '.join([f'p{j} * {_X[a][j]} * {_X[b][j]}' for j in range(5) if _X[a][j] and _X[b][j]] or ['0.0'])}) - ({_MEANS[a]}) * ({_MEANS[b]})" for a, b in _PAIRS]))
def mnl_hessian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative Hessian of the log-likelihood, upper triangle."""
    return _upper(spark, _mnl_sums(spark, sf_dir)[3])


@_query(_sums_sql([f"{_SCORES[a]} * {_SCORES[b]}" for a, b in _PAIRS]))
def mnl_bhhh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the scores' outer products, upper triangle."""
    return _upper(spark, _mnl_sums(spark, sf_dir)[4])


@_query()
def mnl_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mnl(spark, sf_dir).fit().to_dataframe(spark)


EVENTS = ("click", "error", "purchase", "signup", "view")
EVENT_BETA = (0.1, -0.2, 0.3, 0.05)
_EVENT_AVAILABLE = ["1.0", "(event_id % 2 = 0)::INT", "(event_id % 3 > 0)::INT", "1.0", "(event_id % 5 > 0)::INT"]


def _events(spark: SparkSession, sf_dir: str) -> MNL:
    e = _table(spark, sf_dir, "events")
    free = [F.lit(1.0), (F.col("event_id") % 2 == 0).cast("double"), (F.col("event_id") % 3 > 0).cast("double"), F.lit(1.0), (F.col("event_id") % 5 > 0).cast("double")]
    wide = e.select("event_id", *[(F.col("event_type") == t).cast("int").alias(t) for t in EVENTS], (F.col("value") / 100.0).alias("amount"), *[a.alias(f"av_{t}") for a, t in zip(free, EVENTS, strict=True)])
    spec = {"asc_error": {"error": "uno"}, "asc_purchase": {"purchase": "UNO"}, "amount": {"purchase": "amount", "view": 0.5}, "asc_view": {"view": 1}}
    model = MNL(wide, EVENTS, spec, [f"av_{t}" for t in EVENTS])
    model.from_estimates(EVENT_BETA)
    return model


@_query(
    "WITH o AS (SELECT value / 100.0 AS amount, " + ", ".join(f"{a} AS a{k}" for k, a in enumerate(_EVENT_AVAILABLE)) + " FROM events), "
    "e AS (SELECT a0 AS e0, a1 * exp(0.1) AS e1, a2 * exp(-0.2 + 0.3 * amount) AS e2, a3 AS e3, a4 * exp(0.3 * 0.5 + 0.05) AS e4 FROM o), "
    "p AS (SELECT " + ", ".join(f"e{k} / (e0 + e1 + e2 + e3 + e4) AS p{k}" for k in range(5)) + " FROM e) " + _shares_sql(EVENTS, "'baseline' AS scenario, ")
)
def mnl_available_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares where not every alternative is available to all."""
    return _rounded(_events(spark, sf_dir).ate(), "share")


SCENARIOS = {"dear": {"price": 3.0}, "swap": {"month": "half", "half": "month"}}


def _scenario_sql() -> str:
    runs = {"baseline": ("price", "month", "half"), "dear": ("3.0", "month", "half"), "swap": ("price", "half", "month")}
    parts = [f"SELECT * FROM (WITH {_softmax_sql(_mnl_utilities(*a))} {_shares_sql(PRIORITIES, f'{chr(39)}{s}{chr(39)} AS scenario, ')})" for s, a in runs.items()]
    return f"WITH {_ORDERS_SQL} " + " UNION ALL ".join(parts)


@_query(_scenario_sql())
def ate_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares under each scenario, one of which swaps two columns, in one pass."""
    return _rounded(_mnl(spark, sf_dir).ate(SCENARIOS), "share")


@_query(
    f"WITH s AS ({_scenario_sql().replace('round(avg', 'round(1 * avg')}), b AS (SELECT * FROM s WHERE scenario = 'baseline'), t AS (SELECT * FROM s WHERE scenario = 'dear') "
    "SELECT alternative, round(100 * (t.share - b.share) / b.share, 3) AS change FROM b JOIN t USING (alternative)"
)
def ate_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of each share in per cent."""
    shares = _rounded(_mnl(spark, sf_dir).ate(SCENARIOS), "share")
    return scenario.comparison(shares, "baseline", "dear").select("alternative", F.round("change", 3).alias("change"))


def _cell_sql() -> str:
    out = []
    for s, value in (("base", "0.5"), ("treatment", "2.0")):
        u = _mnl_utilities()
        u[1] = f"0.2 + -0.05 * {value}"
        out.append(f"SELECT * FROM (WITH {_softmax_sql(u)} {_shares_sql(PRIORITIES, f'{chr(39)}{s}{chr(39)} AS scenario, ')})")
    return f"WITH {_ORDERS_SQL} " + " UNION ALL ".join(out)


@_query(_cell_sql())
def ate_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares with one alternative's value of one coefficient held at two levels."""
    return _rounded(_mnl(spark, sf_dir).ate_cell("high", "price", 0.5, 2.0), "share")


@_query("SELECT o_orderkey, substr(o_orderpriority, 1, 1)::INT - 1 AS choice FROM orders")
def choice_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", choice_index(PRIORITIES).alias("choice"))


@_query(f"WITH {_ORDERS_SQL} SELECT o_orderkey, round(0.2::DOUBLE, 6) AS u_high, round(0.04 * month + 0.333333 * price, 6) AS u_low FROM o")
def spec_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix specification, compiled."""
    df = _orders(spark, sf_dir)
    design = compile_spec(spec_of_matrix([["uno", "sero", 0], ["sero", "month", "price"]], ("high", "low"), ("a", "b", "c")), ("high", "low"), df.columns)
    u = design.utilities((0.2, 0.04, 0.333333))
    return df.select("o_orderkey", F.round(u[0], 6).alias("u_high"), F.round(u[1], 6).alias("u_low"))


@_query("SELECT l_orderkey, l_linenumber, l_linenumber - (SELECT min(l_linenumber) FROM lineitem) AS y FROM lineitem")
def ordinal_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").alias("q"))
    model = MORP(df, ["line"], {"q": {"line": "q"}})
    model.bind()
    return df.select("l_orderkey", "l_linenumber", rebased("line", model.lowest[0]).alias("y"))


# --- discrete-continuous: what customers spend by priority ----------------------------------------

GOODS = ("outside", "urgent", "high", "other")
MDCEV_UTILITY = {"asc_urgent": {"urgent": "uno"}, "asc_high": {"high": "uno"}, "asc_other": {"other": "uno"}, "balance": {"urgent": "wealth"}}
MDCEV_SATIATION = {"urgent": {"urgent": "uno"}, "high": {"high": "uno"}, "other": {"other": "uno"}}
MDCEV_BETA, MDCEV_GAMMA, MDCEV_SIGMA = (-0.5, -0.4, 0.2, 0.3), (0.5, 0.4, 0.6), 0.8


def _spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    spend = F.col("o_totalprice") / 1e5
    kind = F.substring("o_orderpriority", 1, 1)
    per = o.groupBy("o_custkey").agg(*[F.sum(F.when(test, spend).otherwise(0.0)).alias(g) for g, test in (("urgent", kind == "1"), ("high", kind == "2"), ("other", kind > "2"))])
    c = _table(spark, sf_dir, "customer").select("c_custkey", (F.greatest("c_acctbal", F.lit(1.0)) / 1e3).alias("outside"), (F.col("c_acctbal") / 1e4).alias("wealth"))
    return c.join(per, c["c_custkey"] == per["o_custkey"]).select("c_custkey", *GOODS, "wealth")


_SPEND_SQL = """s AS (
  SELECT c_custkey, greatest(c_acctbal, 1.0) / 1e3 AS q0, q1, q2, q3, c_acctbal / 1e4 AS wealth FROM customer JOIN (
    SELECT o_custkey, sum(CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN o_totalprice / 1e5 ELSE 0.0 END) AS q1,
      sum(CASE WHEN substr(o_orderpriority, 1, 1) = '2' THEN o_totalprice / 1e5 ELSE 0.0 END) AS q2,
      sum(CASE WHEN substr(o_orderpriority, 1, 1) > '2' THEN o_totalprice / 1e5 ELSE 0.0 END) AS q3 FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)"""


def _mdcev(spark: SparkSession, sf_dir: str, traditional: bool) -> MDCEV:
    model = MDCEV(_spending(spark, sf_dir), GOODS, MDCEV_UTILITY, MDCEV_SATIATION, traditional=traditional)
    model.from_estimates(MDCEV_BETA, MDCEV_GAMMA, MDCEV_SIGMA)
    return model


def _mdcev_sql(traditional: bool) -> str:
    """The likelihood written out by the number of goods consumed, apart from the library's formula."""
    psi = ["0.0", "(-0.5 + 0.3 * wealth)", "-0.4", "0.2"]
    f = ["0.0", "exp(0.5)", "exp(0.4)", "exp(0.6)"]
    base = "- ln(q0)" if traditional else ""
    gaps = ", ".join(f"exp(-((0.0 {base}) - ({psi[k]} - ln((q{k} + {f[k]}) / {f[k]}))) / 0.8) AS e{k}, (q{k} > 0)::INT AS u{k}" for k in (1, 2, 3))
    if traditional:
        jac = "1.0 / q0 * " + " * ".join(f"(CASE WHEN u{k} = 1 THEN 1.0 / (q{k} + {f[k]}) ELSE 1.0 END)" for k in (1, 2, 3)) + " * (q0 + " + " + ".join(f"u{k} * (q{k} + {f[k]})" for k in (1, 2, 3)) + ")"
    else:
        jac = " * ".join(f"(CASE WHEN u{k} = 1 THEN 1.0 / (q{k} + {f[k]}) ELSE 1.0 END)" for k in (1, 2, 3))
    top = " * ".join(f"(CASE WHEN u{k} = 1 THEN e{k} / 0.8 ELSE 1.0 END)" for k in (1, 2, 3))
    return f"WITH {_SPEND_SQL}, e AS (SELECT *, {gaps} FROM s) SELECT c_custkey, round(ln({jac} * factorial(u1 + u2 + u3) * {top} / pow(1.0 + e1 + e2 + e3, u1 + u2 + u3 + 1)), 6) AS loglik FROM e"


@_query(_mdcev_sql(True))
def mdcev_loglik_traditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mdcev(spark, sf_dir, True)
    return m.df.select("c_custkey", F.round(m.loglik_column(), 6).alias("loglik"))


@_query(_mdcev_sql(False))
def mdcev_loglik_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mdcev(spark, sf_dir, False)
    return m.df.select("c_custkey", F.round(m.loglik_column(), 6).alias("loglik"))


def _mdcev_score_sql(traditional: bool) -> str:
    """Sums of scores: each good's gap moves the likelihood by its share of the total less whether it is consumed."""
    psi, f = ["0.0", "(-0.5 + 0.3 * wealth)", "-0.4", "0.2"], ["0.0", "exp(0.5)", "exp(0.4)", "exp(0.6)"]
    base = "- ln(q0)" if traditional else ""
    gaps = ", ".join(f"((0.0 {base}) - ({psi[k]} - ln((q{k} + {f[k]}) / {f[k]}))) / 0.8 AS d{k}, (q{k} > 0)::INT AS u{k}, {f[k]} / (q{k} + {f[k]}) AS h{k}" for k in (1, 2, 3))
    spent = "q0 + " + " + ".join(f"u{k} * (q{k} + {f[k]})" for k in (1, 2, 3))
    r = ", ".join(f"u{k} - (u1 + u2 + u3 + 1.0) * exp(-d{k}) / (1.0 + exp(-d1) + exp(-d2) + exp(-d3)) AS r{k}" for k in (1, 2, 3))
    own = {k: f"u{k} * ({f[k]} / spent - h{k})" if traditional else f"-u{k} * h{k}" for k in (1, 2, 3)}
    terms = {"asc_urgent": "r1 / 0.8", "asc_high": "r2 / 0.8", "asc_other": "r3 / 0.8", "balance": "r1 / 0.8 * wealth"}
    terms |= {f"g_{n}": f"r{k} * (1.0 - h{k}) / 0.8 + {own[k]}" for k, n in enumerate(GOODS[1:], 1)} | {"sigma": "r1 * d1 + r2 * d2 + r3 * d3 - u1 - u2 - u3"}
    parts = " UNION ALL ".join(f"SELECT '{n}' AS parameter, round(sum({t}), 3) AS score FROM r" for n, t in terms.items())
    return f"WITH {_SPEND_SQL}, d AS (SELECT *, {gaps} FROM s), x AS (SELECT *, {spent} AS spent FROM d), r AS (SELECT *, {r} FROM x) {parts}"


def _score_rows(spark: SparkSession, names: list[str], g: np.ndarray, digits: int = 3) -> DataFrame:
    return _frame(spark, [(n, round(float(x), digits)) for n, x in zip(names, g, strict=True)], "parameter string, score double")


def _mdcev_score(spark: SparkSession, sf_dir: str, traditional: bool) -> DataFrame:
    m = _mdcev(spark, sf_dir, traditional)
    lik = Closed(m._rows(), m.terms, len(m.names), m._active())
    try:
        return _score_rows(spark, m.names, lik.at(m.results.extra["theta"])[2])
    finally:
        lik.close()


@_query(_mdcev_score_sql(True))
def mdcev_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the rows' scores by coefficients, log-satiations and log scale, in one aggregate."""
    return _mdcev_score(spark, sf_dir, True)


@_query(_mdcev_score_sql(False))
def mdcev_score_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mdcev_score(spark, sf_dir, False)


@_query()
def mdcev_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mdcev(spark, sf_dir, True).fit().to_dataframe(spark)


@_query()
def mdcev_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participation and mean quantity of each good over simulated errors."""
    return _rounded(_mdcev(spark, sf_dir, True).participation(budget=3.0, id_column="c_custkey"), "participation", "quantity")


#: The optimal quantities by trying every set of inside goods that a falling marginal utility can bring in.
_ALLOCATION_SQL = f"""WITH {_SPEND_SQL},
g AS (SELECT c_custkey, list_reverse_sort([{{'gain': exp(-0.5 + 0.3 * wealth), 'f': exp(0.5), 'k': -1}}, {{'gain': exp(-0.4), 'f': exp(0.4), 'k': -2}}, {{'gain': exp(0.2), 'f': exp(0.6), 'k': -3}}]) AS o FROM s),
l AS (SELECT *, 1.0 / 3.0 AS l0, (1.0 + o[1].f * o[1].gain) / (3.0 + o[1].f) AS l1,
  (1.0 + o[1].f * o[1].gain + o[2].f * o[2].gain) / (3.0 + o[1].f + o[2].f) AS l2,
  (1.0 + o[1].f * o[1].gain + o[2].f * o[2].gain + o[3].f * o[3].gain) / (3.0 + o[1].f + o[2].f + o[3].f) AS l3 FROM g),
m AS (SELECT *, CASE WHEN o[1].gain <= l0 THEN l0 WHEN o[2].gain <= l1 THEN l1 WHEN o[3].gain <= l2 THEN l2 ELSE l3 END AS level,
  CASE WHEN o[1].gain <= l0 THEN 0 WHEN o[2].gain <= l1 THEN 1 WHEN o[3].gain <= l2 THEN 2 ELSE 3 END AS n FROM l),
q AS (SELECT c_custkey, 1.0 / level AS q0, [{{'k': o[1].k, 'q': CASE WHEN n >= 1 THEN (o[1].gain / level - 1.0) * o[1].f ELSE 0.0 END}},
  {{'k': o[2].k, 'q': CASE WHEN n >= 2 THEN (o[2].gain / level - 1.0) * o[2].f ELSE 0.0 END}}, {{'k': o[3].k, 'q': CASE WHEN n >= 3 THEN (o[3].gain / level - 1.0) * o[3].f ELSE 0.0 END}}] AS q FROM m)
SELECT c_custkey AS row_id, round(q0, 6) AS outside, round(list_filter(q, lambda x: x.k = -1)[1].q, 6) AS urgent,
  round(list_filter(q, lambda x: x.k = -2)[1].q, 6) AS high, round(list_filter(q, lambda x: x.k = -3)[1].q, 6) AS other FROM q"""


@_query(_ALLOCATION_SQL)
def mdcev_allocation_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal quantities of each row without errors."""
    return _rounded(_mdcev(spark, sf_dir, True).allocation(3.0, "c_custkey"), *GOODS)


@_query()
def mdcev_ate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_mdcev(spark, sf_dir, True).ate({"rich": {"wealth": 1.0}}, budget=3.0, id_column="c_custkey"), "share")


# --- ordered probit: a line's number; quality and toxicity of texts --------------------------------

LINE_CUTS = (-1.2, -0.7, -0.2, 0.2, 0.7, 1.3)
_PHI = _normal_sql
_LINES_SQL = "m AS (SELECT l_linenumber - 1 AS y, 0.3 * (l_quantity / 50.0) - 0.2 * l_discount AS mu FROM lineitem)"
_LINE_P = "c AS (SELECT y, " + ", ".join(f"{_PHI(f'({t} - mu)')} AS c{i + 1}" for i, t in enumerate(LINE_CUTS)) + " FROM m), p AS (SELECT y, c1 AS p0, " + ", ".join(f"c{i + 1} - c{i} AS p{i}" for i in range(1, 6)) + ", 1.0 - c6 AS p6 FROM c)"


def _lines(spark: SparkSession, sf_dir: str) -> MORP:
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0).alias("quantity"), "l_discount")
    model = MORP(df, ["l_linenumber"], {"quantity": {"l_linenumber": "quantity"}, "discount": {"l_linenumber": "l_discount"}})
    model.from_estimates((0.3, -0.2), [LINE_CUTS], lowest=[1])
    return model


@_query(f"WITH {_LINES_SQL}, {_LINE_P} " + " UNION ALL ".join(f"SELECT 'baseline' AS scenario, 'l_linenumber' AS outcome, {k + 1} AS category, round(avg(p{k}), 6) AS share FROM p" for k in range(7)))
def morp_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_lines(spark, sf_dir).ate(), "share")


@_query(f"WITH {_LINES_SQL}, {_LINE_P} SELECT count(*) AS n, round(avg(ln(greatest(CASE y {' '.join(f'WHEN {k} THEN p{k}' for k in range(7))} END, 1e-300))), 6) AS loglik FROM p")
def morp_loglik_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _lines(spark, sf_dir)
    ps = model._marginals()[0]
    y = rebased("l_linenumber", 1)
    p = F.element_at(F.array(*ps), y + 1)
    return _rounded(model.df.agg(F.count("*").alias("n"), F.avg(F.log(F.greatest(p, F.lit(1e-300)))).alias("loglik")), "loglik")


@_query(f"WITH {_LINES_SQL}, {_LINE_P} SELECT category, count(*) AS n FROM (SELECT list_position([p0, p1, p2, p3, p4, p5, p6], greatest(p0, p1, p2, p3, p4, p5, p6))::INT AS category FROM p) GROUP BY category")
def morp_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).predict().groupBy(F.col("category_l_linenumber").alias("category")).agg(F.count("*").alias("n"))


def _line_score_sql() -> str:
    """Sums of scores: of a row, the densities at both its thresholds over its probability."""
    edges = [None, *LINE_CUTS, None]
    side = lambda k: "0.0" if edges[k] is None else f"{_density_sql(f'({edges[k]} - mu)')} / p"
    case = lambda of: "CASE y " + " ".join(f"WHEN {k} THEN {of(k)}" for k in range(7)) + " END"
    ab = f"ab AS (SELECT y, q, d, {case(lambda k: side(k + 1))} AS a, {case(side)} AS b FROM o)"
    raw = lambda k: f"sum(CASE WHEN y >= {k} AND y < 6 THEN a ELSE 0.0 END - CASE WHEN y > {k} THEN b ELSE 0.0 END)"
    terms = {"quantity": "sum((b - a) * q)", "discount": "sum((b - a) * d)", "tau_l_linenumber_1": raw(0)}
    terms |= {f"tau_l_linenumber_{k + 1}": f"{LINE_CUTS[k] - LINE_CUTS[k - 1]!r} * {raw(k)}" for k in range(1, 6)}
    rows = f"o AS (SELECT m.*, {case(lambda k: f'p{k}')} AS p FROM (SELECT y, mu, q, d, " + ", ".join(f"{_PHI(f'({t} - mu)')} AS c{i + 1}" for i, t in enumerate(LINE_CUTS)) + " FROM l) m, LATERAL (SELECT c1 AS p0, " + ", ".join(f"c{i + 1} - c{i} AS p{i}" for i in range(1, 6)) + ", 1.0 - c6 AS p6))"
    lines = "l AS (SELECT l_linenumber - 1 AS y, l_quantity / 50.0 AS q, l_discount AS d, 0.3 * (l_quantity / 50.0) - 0.2 * l_discount AS mu FROM lineitem)"
    return f"WITH {lines}, {rows}, {ab} " + " UNION ALL ".join(f"SELECT '{n}' AS parameter, round({t}, 3) AS score FROM ab" for n, t in terms.items())


@_query(_line_score_sql())
def morp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the rows' scores by coefficients and threshold parameters (the first threshold, logs of steps), in one aggregate."""
    model = _lines(spark, sf_dir)
    lik = Closed(model._rows(), model.terms, len(model.names))
    try:
        return _score_rows(spark, model.names, lik.at(model.results.extra["theta"])[2])
    finally:
        lik.close()


@_query()
def morp_lines_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit of one outcome of seven categories: an aggregate a step."""
    return _lines(spark, sf_dir).fit().to_dataframe(spark)


RHO = -0.35


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.log(1.0 + F.col("n_chars")) / 10.0).alias("length"))
    return labels.join(docs, "doc_id")


_PAIR_P = {
    (1, 1): _pair_sql("h", "k", repr(RHO)),
    (1, 2): f"({_PHI('h')} - {_pair_sql('h', 'k', repr(RHO))})",
    (2, 1): f"({_PHI('k')} - {_pair_sql('h', 'k', repr(RHO))})",
}
_PAIR_P[(2, 2)] = f"(1.0 - {_PHI('h')} - {_PHI('k')} + {_pair_sql('h', 'k', repr(RHO))})"


@_query("WITH m AS (SELECT -1.0 - 0.2 * ln(1.0 + n_chars) / 10.0 AS h, 1.1 - 0.4 * ln(1.0 + n_chars) / 10.0 AS k FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL) " + " UNION ALL ".join(f"SELECT {a} AS quality, {b} AS toxic, round(avg({p}), 6) AS probability FROM m" for (a, b), p in _PAIR_P.items()))
def morp_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability of each combination of two correlated answers."""
    return _rounded(_pair_model(spark, sf_dir).joint(), "probability")


def _pair_score_sql() -> str:
    """Sums of scores in reporting units: an answer below its threshold keeps the limit's sign, one above turns it."""
    root = float(np.sqrt(1 - RHO * RHO))
    signs = "CASE WHEN quality = 0 THEN 1.0 ELSE -1.0 END AS s, CASE WHEN toxic = 0 THEN 1.0 ELSE -1.0 END AS t"
    rows = "m AS (SELECT ln(1.0 + n_chars) / 10.0 AS x, quality, toxic FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL)"
    at = f"a AS (SELECT x, -1.0 - 0.2 * x AS h, 1.1 - 0.4 * x AS k, {signs} FROM m), b AS (SELECT *, s * h AS sh, t * k AS tk, s * t * {RHO!r} AS r FROM a)"
    p = f"p AS (SELECT *, {_pair_sql('sh', 'tk', 'r')} AS p FROM b)"
    by_h = f"s * {_density_sql('h')} * {_normal_sql(f'((tk - r * sh) / {root!r})')} / p"
    by_k = f"t * {_density_sql('k')} * {_normal_sql(f'((sh - r * tk) / {root!r})')} / p"
    by_r = f"s * t * exp(-(h * h - 2.0 * {RHO!r} * h * k + k * k) / {2 * root * root!r}) / {2 * np.pi * root!r} / p"
    terms = {"quality": "sum(-g * x)", "toxic": "sum(-f * x)", "tau_quality_1": "sum(g)", "tau_toxic_1": "sum(f)", "corr_quality_toxic": "sum(e)"}
    return f"WITH {rows}, {at}, {p}, g AS (SELECT x, {by_h} AS g, {by_k} AS f, {by_r} AS e FROM p) " + " UNION ALL ".join(f"SELECT '{n}' AS parameter, round({t}, 3) AS score FROM g" for n, t in terms.items())


def _pair_model(spark: SparkSession, sf_dir: str) -> MORP:
    model = MORP(_labels(spark, sf_dir), ["quality", "toxic"], {"quality": {"quality": "length"}, "toxic": {"toxic": "length"}}, structure="full")
    model.from_estimates((0.2, 0.4), [(-1.0,), (1.1,)], np.array([[1.0, RHO], [RHO, 1.0]]), lowest=[0, 0])
    return model


@_query(_pair_score_sql())
def morp_score_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the rows' scores by coefficients, thresholds and the correlation itself."""
    model = _pair_model(spark, sf_dir)
    return _score_rows(spark, model.names, model.natural_sums(model.results.theta)[2])


@_query()
def morp_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = MORP(_labels(spark, sf_dir), ["quality", "toxic"], {"quality": {"quality": "length"}, "toxic": {"toxic": "length"}}, structure="full")
    return model.fit().to_dataframe(spark)


# --- multinomial probit: the flag of a line --------------------------------------------------------

FLAGS = ("A", "N", "R")
MNP_SPEC = {"asc_n": {"N": "uno"}, "asc_r": {"R": "uno"}, "quantity": {"A": "quantity", "R": "discount"}}
MNP_BETA = (0.3, -0.2, 0.4)
MNP_KERNEL = np.array([[1.0, 0.5], [0.5, 1.44]])


def _flags(spark: SparkSession, sf_dir: str, **kind) -> MNP:
    li = _table(spark, sf_dir, "lineitem")
    df = li.select(*[(F.col("l_returnflag") == f).cast("int").alias(f) for f in FLAGS], (F.col("l_quantity") / 50.0).alias("quantity"), F.col("l_discount").alias("discount"))
    return MNP(df, FLAGS, MNP_SPEC, **kind)


def _mnp_sql(kernel: np.ndarray, tail: str, beta: tuple = MNP_BETA) -> str:
    """Probabilities p0, p1, p2 by columns of limits, then of bivariate distributions."""
    v = [f"{beta[2]} * q", f"{beta[0]}", f"{beta[1]} + {beta[2]} * d"]
    limits, ps = [], []
    for c in range(3):
        cov = mnp.differences(kernel, c)
        rivals = [k for k in range(3) if k != c]
        limits += [f"(({v[c]}) - ({v[k]})) / {float(np.sqrt(cov[i, i]))!r} AS z{c}{i}" for i, k in enumerate(rivals)]
        rho = float(cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1]))
        ps.append(f"{_pair_sql(f'z{c}0', f'z{c}1', repr(rho))} AS p{c}")
    return f"WITH o AS (SELECT l_quantity / 50.0 AS q, l_discount AS d FROM lineitem), z AS (SELECT {', '.join(limits)} FROM o), p AS (SELECT {', '.join(ps)} FROM z) {tail}"


@_query(_mnp_sql(MNP_KERNEL, _shares_sql(FLAGS, "'baseline' AS scenario, ")))
def mnp_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of three alternatives with correlated errors, as Columns."""
    model = _flags(spark, sf_dir, structure="full")
    model.from_estimates(MNP_BETA, MNP_KERNEL)
    return _rounded(scenario.mean_by_scenario(model.df, {"baseline": model.closed_shares()}, FLAGS), "share")


@_query(_mnp_sql(0.5 * np.eye(2) + 0.5, _shares_sql(FLAGS, "'baseline' AS scenario, ")))
def mnp_shares_iid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with independent errors, through the batch kernel."""
    model = _flags(spark, sf_dir)
    model.from_estimates(MNP_BETA)
    return _rounded(model.ate(), "share")


def _probit_sql(rows: str, utilities: tuple, spread: tuple | None) -> str:
    """p0, p1, p2 of ``rows`` (SQL with the columns of the utilities): independent unit errors, plus a coefficient of variance spread[0] on values spread[1]."""
    zs, ps = [], []
    for c in range(3):
        i, k = (x for x in range(3) if x != c)
        cov = {(a, b): f"({1.0 if a == b else 0.5}" + (f" + {spread[0]!r} * (({spread[1][a]}) - ({spread[1][c]})) * (({spread[1][b]}) - ({spread[1][c]})))" if spread else ")") for a in (i, k) for b in (i, k)}
        zs += [f"(({utilities[c]}) - ({utilities[x]})) / sqrt({cov[x, x]}) AS z{c}{n}" for n, x in enumerate((i, k))]
        zs.append(f"{cov[i, k]} / sqrt({cov[i, i]} * {cov[k, k]}) AS r{c}")
        ps.append(f"{_pair_sql(f'z{c}0', f'z{c}1', f'r{c}')} AS p{c}")
    return f"SELECT p0 / (p0 + p1 + p2) AS p0, p1 / (p0 + p1 + p2) AS p1, p2 / (p0 + p1 + p2) AS p2 FROM (SELECT {', '.join(ps)} FROM (SELECT {', '.join(zs)} FROM ({rows})))"


def _random_sql() -> str:
    run = lambda d: _probit_sql(f"SELECT l_quantity / 50.0 AS q, {d} AS d FROM lineitem", ("0.4 * q", "0.3", "-0.2 + 0.4 * d"), (float(np.exp(-1.4)), ("q", "0.0", "d")))
    return " UNION ALL ".join(_shares_sql(FLAGS, f"'{s}' AS scenario, ").replace(" FROM p", f" FROM ({run(d)})") for s, d in (("baseline", "l_discount"), ("no_discount", "0.0")))


def _mixture_sql() -> str:
    share = float(1 / (1 + np.exp(0.4)))
    rows = "SELECT row_number() OVER () AS r, l_quantity / 50.0 AS q, l_discount AS d FROM lineitem"
    of = lambda b: _probit_sql("SELECT * FROM o", (f"{b[2]} * q", f"{b[0]}", f"{b[1]} + {b[2]} * d"), None)
    means = [f"(SELECT avg(p{k}) FROM ({of(b)})) * {s!r}" for k in range(3) for b, s in (((0.3, -0.2, 0.4), share), ((-0.1, 0.2, 0.5), 1 - share))]
    return f"WITH o AS ({rows}) " + " UNION ALL ".join(f"SELECT 'baseline' AS scenario, '{n}' AS alternative, round({means[2 * k]} + {means[2 * k + 1]}, 6) AS share" for k, n in enumerate(FLAGS))


@_query(_random_sql())
def mnp_random_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _flags(spark, sf_dir, random=["quantity"])
    model.from_estimates(MNP_BETA, theta_rest=[-0.7])
    return _rounded(model.ate({"no_discount": {"discount": 0.0}}), "share")


@_query(_mixture_sql())
def mnp_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _flags(spark, sf_dir, segments=2)
    model.from_estimates(MNP_BETA, theta_rest=[0.4, -0.1, 0.2, 0.5])
    return _rounded(model.ate(), "share")


def _flag_score_sql() -> str:
    """Sums of scores of three alternatives with independent unit errors: the rivals' differences have variance 1 and correlation 0.5."""
    v, parts = ["0.4 * q", "0.3", "-0.2 + 0.4 * d"], []
    x = [("0.0", "1.0", "0.0"), ("0.0", "0.0", "1.0"), ("q", "0.0", "d")]
    for c in range(3):
        i, k = (j for j in range(3) if j != c)
        a, b = f"({v[c]} - ({v[i]}))", f"({v[c]} - ({v[k]}))"
        root = repr(float(np.sqrt(0.75)))
        by = f"{_density_sql('a')} * {_normal_sql(f'((b - 0.5 * a) / {root})')} / p AS by_a, {_density_sql('b')} * {_normal_sql(f'((a - 0.5 * b) / {root})')} / p AS by_b"
        slopes = ", ".join(f"by_a * ({of[c]} - {of[i]}) + by_b * ({of[c]} - {of[k]}) AS g{n}" for n, of in enumerate(x))
        parts.append(f"SELECT {slopes} FROM (SELECT *, {by} FROM (SELECT *, {_pair_sql('a', 'b', '0.5')} AS p FROM (SELECT q, d, {a} AS a, {b} AS b FROM o WHERE y = {c})))")
    rows = "o AS (SELECT l_quantity / 50.0 AS q, l_discount AS d, list_position(['A', 'N', 'R'], l_returnflag) - 1 AS y FROM lineitem)"
    return f"WITH {rows}, g AS ({' UNION ALL '.join(parts)}) " + " UNION ALL ".join(f"SELECT '{n}' AS parameter, round(sum(g{k}), 3) AS score FROM g" for k, n in enumerate(MNP_SPEC))


@_query(_flag_score_sql())
def mnp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the rows' scores by coefficients, one reverse sweep a batch."""
    model = _flags(spark, sf_dir)
    lik = model._likelihood()
    try:
        return _score_rows(spark, model.names, lik.at(np.array(MNP_BETA))[2])
    finally:
        lik.close()


@_query()
def mnp_random_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coefficient with normal variation, fitted with its scores in closed form."""
    return _flags(spark, sf_dir, random=["quantity"]).fit().to_dataframe(spark)


@_query()
def mnp_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).fit().to_dataframe(spark)


STATES = ("AF", "NF", "NO", "RF")


STATE_BETA, STATE_KERNEL = (-0.4, 0.3, 0.5), np.array([[1.0, 0.4, 0.3], [0.4, 1.2, 0.5], [0.3, 0.5, 0.9]])


def _states(spark: SparkSession, sf_dir: str, **how) -> MNP:
    li = _table(spark, sf_dir, "lineitem")
    state = F.concat("l_returnflag", "l_linestatus")
    df = li.select(*[(state == s).cast("int").alias(s) for s in STATES], (F.col("l_quantity") / 50.0).alias("quantity"), F.col("l_discount").alias("discount"))
    model = MNP(df, STATES, {"asc_nf": {"NF": "uno"}, "asc_no": {"NO": "uno"}, "quantity": {"AF": "quantity", "RF": "discount"}}, structure="full", **how)
    model.from_estimates(STATE_BETA, STATE_KERNEL)
    return model


def _states_sql(exact: bool) -> str:
    """Shares over the different pairs of quantity and discount, each as often as it occurs."""
    v, ps, cases = [f"{STATE_BETA[2]} * q", f"{STATE_BETA[0]}", f"{STATE_BETA[1]}", f"{STATE_BETA[2]} * d"], [], {}
    for c in range(4):
        cov = mnp.differences(STATE_KERNEL, c)
        sd = np.sqrt(np.diag(cov))
        r = cov / np.outer(sd, sd)
        z = tuple(f"((({v[c]}) - ({v[k]})) / {float(sd[i])!r})" for i, k in enumerate(k for k in range(4) if k != c))
        ps.append(f"{_triple_sql(z, float(r[0, 1]), float(r[0, 2]), float(r[1, 2]))} AS p{c}")
        cases[f"p{c}"] = z, r
    rows = f"nodes AS (SELECT {_nodes_sql(24)} AS t, {_nodes_sql(48)} AS tt)"
    runs = []
    for name, d in (("baseline", "l_discount"), ("no_discount", "0.0")):
        pairs = f"SELECT l_quantity / 50.0 AS q, {d} AS d, count(*) AS times FROM lineitem GROUP BY ALL"
        per = f"SELECT times, {', '.join(ps)} FROM ({pairs}), nodes" if exact else _ordered_sql(pairs, cases, "times")
        runs += [f"SELECT '{name}' AS scenario, '{a}' AS alternative, round(sum(times * p{k} / (p0 + p1 + p2 + p3)) / sum(times), 6) AS share FROM ({per})" for k, a in enumerate(STATES)]
    return f"WITH {rows} " + " UNION ALL ".join(runs)


@_query(_states_sql(exact=False))
def mnp_four_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four alternatives with free covariance: trivariate probabilities by the batch kernel."""
    return _rounded(_states(spark, sf_dir).ate({"no_discount": {"discount": 0.0}}), "share")


@_query(_states_sql(exact=True))
def mnp_four_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by exact trivariate probabilities."""
    return _rounded(_states(spark, sf_dir, method="exact").ate({"no_discount": {"discount": 0.0}}), "share")


THREE_CORR = np.array([[1.0, -0.3, 0.2], [-0.3, 1.0, 0.1], [0.2, 0.1, 1.0]])


def _three(spark: SparkSession, sf_dir: str, **how) -> MORP:
    df = _labels(spark, sf_dir).withColumn("long", (F.col("length") > 0.75).cast("int"))
    model = MORP(df, ["quality", "toxic", "long"], {"b": {"quality": "length", "toxic": "length"}}, structure="full", **how)
    model.from_estimates((0.3,), [(-1.0,), (1.1,), (0.2,)], THREE_CORR, lowest=[0, 0, 0])
    return model


def _three_sql(exact: bool = True) -> str:
    """Both answers of each outcome from the distribution below all thresholds and those of pairs and single outcomes."""
    z = ("h", "k", "0.2")
    of = {(0, 1, 2): _triple_sql(z, -0.3, 0.2, 0.1) if exact else "b012", (): "1.0"} | {(i,): _normal_sql(z[i]) for i in range(3)} | {(i, j): _pair_sql(z[i], z[j], repr(float(THREE_CORR[i, j]))) for i in range(3) for j in range(i + 1, 3)}
    name = lambda some: "b" + "".join(map(str, some))
    out = []
    for combo in range(8):
        answers = [combo >> 2 & 1, combo >> 1 & 1, combo & 1]
        below, above = [i for i in range(3) if not answers[i]], [i for i in range(3) if answers[i]]
        terms = []
        for mask in range(1 << len(above)):  # above a threshold: everything less what is below
            more = [above[i] for i in range(len(above)) if mask >> i & 1]
            terms.append(f"{'-' if len(more) % 2 else '+'} {name(sorted(below + more))}")
        out.append(f"SELECT {answers[0] + 1} AS quality, {answers[1] + 1} AS toxic, {answers[2] + 1} AS long, round(avg({' '.join(terms)}), 6) AS probability FROM b")
    rows = "m AS (SELECT -1.0 - 0.3 * ln(1.0 + n_chars) / 10.0 AS h, 1.1 - 0.3 * ln(1.0 + n_chars) / 10.0 AS k FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL)"
    values = ", ".join(f"{sql} AS {name(some)}" for some, sql in of.items())
    source = "m, nodes" if exact else f"({_ordered_sql('SELECT * FROM m', {'b012': (z, THREE_CORR)}, 'h, k')})"
    return f"WITH {rows}, nodes AS (SELECT {_nodes_sql(24)} AS t, {_nodes_sql(48)} AS tt), b AS (SELECT {values} FROM {source}) " + " UNION ALL ".join(out)


@_query(_three_sql(exact=False))
def morp_three_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint probabilities of three correlated answers."""
    return _rounded(_three(spark, sf_dir).joint(), "probability")


@_query(_three_sql())
def morp_three_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by exact trivariate probabilities, differences on the lattice of thresholds."""
    return _rounded(_three(spark, sf_dir, method="exact").joint(), "probability")


@_query(f"WITH j AS ({_three_sql().replace(', 6) AS probability', ', 15) AS probability')}) SELECT quality AS category, round(sum(probability), 5) AS probability FROM j GROUP BY quality")
def morp_joint_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer's probabilities from the joint table of three."""
    return marginal(_three(spark, sf_dir, method="exact").joint(), "quality").withColumn("probability", F.round("probability", 5))


# --- functions of rows ----------------------------------------------------------------------------

_ROW = "l_orderkey, l_linenumber"


def _function_query(name: str, formulas: dict[str, tuple[Callable, str]]) -> None:
    """A query of scalar functions of x (from quantity) and y (from discount); each with SQL of its own."""
    sql = f"WITH o AS (SELECT {_ROW}, l_quantity / 10.0 - 2.5 AS x, l_discount * 20.0 - 1.0 AS y FROM lineitem) SELECT {_ROW}, " + ", ".join(f"round({text}, 6) AS {n}" for n, (_, text) in formulas.items()) + " FROM o"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10.0 - 2.5).alias("x"), (F.col("l_discount") * 20.0 - 1.0).alias("y"))
        return o.select("l_orderkey", "l_linenumber", *[F.round(f(F.col("x"), F.col("y"), COLUMNS), 6).alias(n) for n, (f, _) in formulas.items()])

    run.__name__ = name
    _query(sql)(run)


_function_query(
    "dist_normal",
    {
        "pdf": (lambda x, y, m: dist.normal_pdf(x, m), _density_sql("x")),
        "logpdf": (lambda x, y, m: dist.normal_logpdf(x, m), "-0.5 * x * x - 0.5 * ln(2.0 * pi())"),
        "cdf": (lambda x, y, m: dist.normal_cdf(x, m), _normal_sql("x")),
    },
)
_function_query("dist_bivariate_normal", {"cdf": (lambda x, y, m: dist.bivariate_normal_cdf(x, y, 0.6, m), _pair_sql("x", "y", "0.6"))})
_function_query(
    "dist_extreme",
    {
        "gumbel": (lambda x, y, m: dist.gumbel_cdf(x, m), "exp(-exp(-x))"),
        "gumbel_pdf": (lambda x, y, m: dist.gumbel_pdf(x, m), "exp(-x) * exp(-exp(-x))"),
        "reverse": (lambda x, y, m: dist.reverse_gumbel_cdf(x, m), "1.0 - exp(-exp(x))"),
        "reverse_pdf": (lambda x, y, m: dist.reverse_gumbel_pdf(x, m), "exp(x) * exp(-exp(x))"),
        "logistic": (lambda x, y, m: dist.logistic_cdf(x, m), "1.0 / (1.0 + exp(-x))"),
        "logistic_pdf": (lambda x, y, m: dist.logistic_pdf(x, m), "exp(-x) / pow(1.0 + exp(-x), 2)"),
    },
)
_BETWEEN = f"({_normal_sql('(1.8 / 1.3)')} - {_normal_sql('(-1.2 / 1.3)')})"
_BELOW_MEAN = f"(-{_density_sql('x')} / {_normal_sql('x')})"
_function_query(
    "dist_truncated_normal",
    {
        "pdf": (lambda x, y, m: dist.truncated_normal_pdf(x, -1.0, 2.0, 0.2, 1.3, m), f"CASE WHEN x BETWEEN -1.0 AND 2.0 THEN {_density_sql('((x - 0.2) / 1.3)')} / 1.3 / {_BETWEEN} ELSE 0.0 END"),
        "cdf": (lambda x, y, m: dist.truncated_normal_cdf(x, -1.0, 2.0, 0.2, 1.3, m), f"CASE WHEN x <= -1.0 THEN 0.0 WHEN x >= 2.0 THEN 1.0 ELSE ({_normal_sql('((x - 0.2) / 1.3)')} - {_normal_sql('(-1.2 / 1.3)')}) / {_BETWEEN} END"),
        "mean": (lambda x, y, m: dist.truncated_normal_mean(x, m), _BELOW_MEAN),
        "variance": (lambda x, y, m: dist.truncated_normal_variance(x, m), f"1.0 + {_BELOW_MEAN} * x - pow({_BELOW_MEAN}, 2)"),
    },
)
#: Owen's T of x and 1.5 by its own integral.
_OWEN = "(1.5 * 0.15915494309189535 * (" + " + ".join(f"{w!r} * exp(-0.5 * x * x * {1 + (1.5 * t) ** 2!r}) / {1 + (1.5 * t) ** 2!r}" for t, w in _UNIT) + "))"
_function_query("dist_skew_normal", {"pdf": (lambda x, y, m: dist.skew_normal_pdf(x, 1.5, m), f"2.0 * {_density_sql('x')} * {_normal_sql('(1.5 * x)')}"), "cdf": (lambda x, y, m: dist.skew_normal_cdf(x, 1.5, m), f"{_normal_sql('x')} - 2.0 * {_OWEN}")})
_LOGISTIC = lambda x, y: f"(1.0 / (1.0 + exp(-({x})) + exp(-({y}))))"
_function_query(
    "mv_logistic",
    {
        "cdf": (lambda x, y, m: dist.mv_logistic_cdf([x, y], m), _LOGISTIC("x", "y")),
        "pdf": (lambda x, y, m: dist.mv_logistic_pdf([x, y], m), "2.0 * exp(-x - y) / pow(1.0 + exp(-x) + exp(-y), 3)"),
        "partial": (lambda x, y, m: dist.mv_logistic_partial([x], [y], m), "exp(-x) / pow(1.0 + exp(-x) + exp(-y), 2)"),
        "survival": (lambda x, y, m: dist.mv_logistic_survival([x, y], m), f"1.0 - 1.0 / (1.0 + exp(-x)) - 1.0 / (1.0 + exp(-y)) + {_LOGISTIC('x', 'y')}"),
        "rectangle": (lambda x, y, m: dist.mv_logistic_rectangle([x - 1.0, y - 1.0], [x, y], m), f"{_LOGISTIC('x', 'y')} - {_LOGISTIC('x - 1.0', 'y')} - {_LOGISTIC('x', 'y - 1.0')} + {_LOGISTIC('x - 1.0', 'y - 1.0')}"),
        "mixed": (lambda x, y, m: dist.mv_logistic_mixed([x], [0.5 * x], [y], m), "exp(-x) / pow(1.0 + exp(-x) + exp(-0.5 * x), 2) - exp(-x) / pow(1.0 + exp(-x) + exp(-0.5 * x) + exp(-y), 2)"),
        "slope": (lambda x, y, m: dist.mv_logistic_gradient([x], [0.5 * x], [y], m)[2], "-2.0 * exp(-x - y) / pow(1.0 + exp(-x) + exp(-0.5 * x) + exp(-y), 3)"),
        "located": (lambda x, y, m: dist.mv_logistic_pdf(dist.located([x, y], [0.1, -0.2], [1.5, 0.8]), m) / (1.5 * 0.8), "2.0 * exp(-(x - 0.1) / 1.5 - (y + 0.2) / 0.8) / pow(1.0 + exp(-(x - 0.1) / 1.5) + exp(-(y + 0.2) / 0.8), 3) / 1.2"),
    },
)


@_query()
def mvn_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean trivariate normal probability of all lines by each method."""
    names = [*METHODS, "exact"]
    cov = np.array([[1.0, 0.3, 0.1], [0.3, 1.0, 0.4], [0.1, 0.4, 1.0]])
    o = _table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity") / 25.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0).alias("a"))

    def task(batches):
        import pandas as pd

        total, n = np.zeros(len(names)), 0
        for rows in batches:
            if len(rows):
                a = np.array(rows["a"].tolist(), float)
                total += [mvn_cdf(a, cov, m).sum() for m in names]
                n += len(rows)
        yield pd.DataFrame({"method": names, "s": total, "n": n})

    return o.mapInPandas(task, "method string, s double, n long").groupBy("method").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("probability"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
