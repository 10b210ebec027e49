"""Optimizers for the driver: a few parameters, each call of the objective one Spark job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Optimum:
    theta: np.ndarray
    value: float
    gradient: np.ndarray
    iterations: int
    converged: bool


Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]
#: A search that stalls counts as converged if no gradient is above this share of its parameter's scale.
SOFT = 0.1
#: Halvings of a step at most, and step lengths that one call of the ladder tries.
HALVINGS, RUNGS = 30, 10
Bounds = list[tuple[float | None, float | None]]


def minimize(
    f: Objective, start: np.ndarray, bounds: Bounds | None = None, active: np.ndarray | None = None, method: str = "bfgs", iterations: int = 200, tolerance: float = 1e-5, memory: int = 10,
    ladder: Callable[[list[np.ndarray]], Sequence[float]] | None = None,
) -> Optimum:
    """Quasi-Newton descent (``bfgs``, or ``lbfgs`` with limited memory) on the active parameters, kept within bounds.

    ``ladder`` gives the values at several points at once, without gradients: where a full step is too
    long, all shorter ones are tried in one call, and the gradient is taken at the one chosen alone.
    A search that runs out of iterations has not converged, however small its steps.
    """
    theta = np.array(start, float)
    free = np.ones(len(theta), bool) if active is None else np.asarray(active, bool)
    low = np.array([-np.inf if bounds is None or b[0] is None else b[0] for b in bounds or [(None, None)] * len(theta)])
    high = np.array([np.inf if bounds is None or b[1] is None else b[1] for b in bounds or [(None, None)] * len(theta)])
    theta = np.clip(theta, low, high)
    value, grad = f(theta)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    inverse = np.eye(len(theta))

    def projected(t: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.where(free & ~((t <= low) & (g > 0)) & ~((t >= high) & (g < 0)), g, 0.0)

    def direction(g: np.ndarray) -> np.ndarray:
        if method == "bfgs":
            return -inverse @ g
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            q -= a * y
            kept.append(a)
        if pairs:
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        return -q

    for n in range(1, iterations + 1):
        g = projected(theta, grad)
        if np.abs(g).max(initial=0.0) < tolerance:
            return Optimum(theta, value, grad, n - 1, True)
        step = np.where(g != 0, direction(g), 0.0)
        if step @ g >= 0:
            step, inverse, pairs = -g, np.eye(len(theta)), []
        length = min(1.0, 1.0 / max(np.abs(step).sum(), 1e-12)) if n == 1 else 1.0
        found = _searched(f, lambda x: np.clip(theta + x * step, low, high), lambda t, v: bool(np.isfinite(v) and v <= value + 1e-4 * (g @ (t - theta))), length, ladder)  # noqa: B023
        if found is None:
            return Optimum(theta, value, grad, n, _soft(theta, g))
        new, new_value, new_grad = found
        s, y = new - theta, projected(new, new_grad) - g
        if s @ y > 1e-12:
            if method == "bfgs":
                if n == 1:
                    inverse *= (s @ y) / (y @ y)
                r = 1 / (y @ s)
                left = np.eye(len(theta)) - r * np.outer(s, y)
                inverse = left @ inverse @ left.T + r * np.outer(s, s)
            else:
                pairs = [*pairs, (s, y)][-memory:]
        done = abs(value - new_value) < 1e-14 * (1 + abs(value))
        theta, value, grad = new, new_value, new_grad
        if done:  # stalled
            return Optimum(theta, value, grad, n, _soft(theta, projected(theta, grad)))
    return Optimum(theta, value, grad, iterations, bool(np.abs(projected(theta, grad)).max(initial=0.0) < tolerance))


def _soft(theta: np.ndarray, g: np.ndarray) -> bool:
    return bool((np.abs(g) / (1 + np.abs(theta))).max(initial=0.0) < SOFT)


def _searched(f: Objective, at: Callable[[float], np.ndarray], good: Callable[[np.ndarray, float], bool], length: float, ladder: Callable | None) -> tuple[np.ndarray, float, np.ndarray] | None:
    """The first point of a line, its length halved again and again, whose value is good."""
    value, grad = f(at(length))
    if good(at(length), value):
        return at(length), value, grad
    lengths = [length / 2**i for i in range(1, HALVINGS)]
    for i in range(0, len(lengths), RUNGS if ladder else 1):
        points = [at(x) for x in lengths[i : i + (RUNGS if ladder else 1)]]
        values = ladder(points) if ladder else [None]
        for point, v in zip(points, values, strict=True):
            if v is None or good(point, v):
                value, grad = f(point)
                if good(point, value):
                    return point, value, grad
    return None


def newton(f: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], start: np.ndarray, iterations: int = 100, tolerance: float = 1e-5) -> Optimum:
    """Damped Newton steps; ``f`` gives value, gradient and Hessian at once."""
    theta = np.array(start, float)
    value, grad, hessian = f(theta)
    for n in range(1, iterations + 1):
        if np.linalg.norm(grad) < tolerance:
            return Optimum(theta, value, grad, n - 1, True)
        step = -np.linalg.pinv(hessian) @ grad
        if step @ grad >= 0:
            step = -grad
        length = 1.0
        while length > 1e-10:
            new_value, new_grad, new_hessian = f(theta + length * step)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * length * (step @ grad):
                break
            length /= 2
        else:
            return Optimum(theta, value, grad, n, bool(np.linalg.norm(grad) < SOFT))
        theta, value, grad, hessian = theta + length * step, new_value, new_grad, new_hessian
    return Optimum(theta, value, grad, iterations, bool(np.linalg.norm(grad) < tolerance))
