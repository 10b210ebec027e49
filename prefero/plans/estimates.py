"""Standard errors and the table of estimates."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from prefero.functions.algebra import ARRAYS
from prefero.functions.distributions import normal_cdf


KINDS = ("bhhh", "hessian", "sandwich")


def covariance(kind: str, outer: np.ndarray | None, hessian: np.ndarray | None) -> np.ndarray:
    """``bhhh``: inverse of the scores' outer product; ``hessian``: of the negative Hessian of the log-likelihood; ``sandwich``: both."""
    inverse = lambda x: np.linalg.pinv(np.asarray(x, float))
    if kind == "bhhh":
        return inverse(outer)
    if kind == "hessian":
        return inverse(hessian)
    if kind == "sandwich":
        return inverse(hessian) @ outer @ inverse(hessian)
    raise ValueError(f"no such standard errors: {kind!r}")


@dataclass
class Estimates:
    """What a fit or given numbers say of the parameters; ``loglik`` is the mean per row."""

    names: list[str]
    theta: np.ndarray
    cov: np.ndarray | None = None
    loglik: float = float("nan")
    n: int = 0
    gradient: np.ndarray | None = None
    iterations: int = 0
    converged: bool = True
    extra: dict = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        return np.full(len(self.theta), np.nan) if self.cov is None else np.sqrt(np.maximum(np.diag(self.cov), 0.0))

    @property
    def loglik_total(self) -> float:
        return self.loglik * self.n

    @property
    def t(self) -> np.ndarray:
        return np.divide(self.theta, self.se, out=np.zeros(len(self.theta)), where=self.se > 0)

    @property
    def p(self) -> np.ndarray:
        return 2 * (1 - normal_cdf(np.abs(self.t), ARRAYS))

    @property
    def corr(self) -> np.ndarray | None:
        if self.cov is None:
            return None
        scale = np.where(self.se > 0, self.se, 1.0)
        return self.cov / np.outer(scale, scale)

    def to_pandas(self) -> pd.DataFrame:
        return pd.DataFrame({"parameter": self.names, "estimate": self.theta, "se": self.se, "t": self.t, "p": self.p})

    def frozen(self, held: np.ndarray) -> Estimates:
        """The same, with no standard errors for the parameters that a fit held."""
        if self.cov is not None:
            for cov in (self.cov, *self.extra.get("cov", {}).values()):
                cov[held, :] = cov[:, held] = np.nan
        return self

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        """The estimates, with the fit's iterations and whether it converged on each row."""
        return spark.createDataFrame(self.to_pandas().assign(iterations=self.iterations, converged=bool(self.converged)))

    def summary(self) -> str:
        head = f"rows {self.n}   mean log-likelihood {self.loglik:.6f}   iterations {self.iterations}   converged {self.converged}"
        return head + "\n" + self.to_pandas().to_string(index=False, float_format=lambda x: f"{x:.5f}")
