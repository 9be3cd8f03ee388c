"""Maximum likelihood by a damped Newton method, every evaluation one Spark aggregate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FitError(RuntimeError):
    """The likelihood rises without end, or the steps did not settle."""


@dataclass(frozen=True)
class Derivatives:
    """One case's log-likelihood as columns: value, first derivatives and second ones by name pair.

    Absent pairs are zero; of (a, b) and (b, a) one is enough.
    """

    value: Column
    first: Mapping[str, Column]
    second: Mapping[tuple[str, str], Column]


def totals(data: DataFrame, weight: str, names: Sequence[str], model: Callable[[dict[str, Column]], Derivatives],
           params: Mapping[str, float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted mean log-likelihood of ``data`` at ``params``, its gradient and Hessian, in one aggregate."""
    # the parameters come as a column, so that Spark compiles the expressions once for all steps
    at = F.struct(*[F.lit(float(params[n])).alias(n) for n in names])
    d = model({n: F.col(f"_p.{n}") for n in names})
    w = F.col(weight)
    sums = {"value": d.value, **{f"g_{n}": c for n, c in d.first.items()},
            **{f"h_{a}_{b}": c for (a, b), c in d.second.items()}}
    rows = data.select("*", F.explode(F.array(at)).alias("_p"))
    row = rows.agg(F.sum(w).alias("weight"), *[F.sum(w * c).alias(n) for n, c in sums.items()]).first()
    grad = np.array([row[f"g_{n}"] if n in d.first else 0.0 for n in names])
    hess = np.zeros((len(names), len(names)))
    for a, b in d.second:
        i, j = names.index(a), names.index(b)
        hess[i, j] = hess[j, i] = row[f"h_{a}_{b}"]
    return row["value"] / row["weight"], grad / row["weight"], hess / row["weight"]


def maximize(data: DataFrame, weight: str, names: Sequence[str], start: Mapping[str, float],
             model: Callable[[dict[str, Column]], Derivatives], steps: int = 100,
             settled: float = 1e-8, farthest: float = 1e9) -> dict[str, float]:
    """Positive parameters that maximize the weighted log-likelihood of ``data`` (distinct cases with counts).

    Works on the logarithms. A step solves the Newton system with its diagonal loaded until the quadratic
    model falls in all directions; the load shrinks when a step gains about what the model promised and grows when it
    does not. Settled means that a Newton step would gain less than ``settled`` squared.
    """
    names = list(names)

    def look(theta: np.ndarray):
        p = np.exp(theta)
        value, grad, hess = totals(data, weight, names, model, dict(zip(names, p, strict=True)))
        grad = grad * p
        return value, grad, hess * np.outer(p, p) + np.diag(grad)

    theta = np.log([float(start[n]) for n in names])
    value, grad, hess = look(theta)
    load, idle = 1e-3, 0
    for _ in range(steps):
        bend = -np.linalg.eigvalsh(hess)
        size = max(float(np.abs(bend).max()), 1e-12)
        safe = max(load * size, 1e-9 * size - float(bend.min()))
        step = np.linalg.solve(safe * np.eye(len(names)) - hess, grad)
        promise = float(grad @ step + 0.5 * step @ hess @ step)
        if bend.min() > 0 and grad @ np.linalg.solve(-hess, grad) < settled**2:
            return {n: float(np.exp(t)) for n, t in zip(names, theta, strict=True)}
        step *= min(1.0, 3.0 / float(np.abs(step).max()))
        new = look(theta + step)
        gain = new[0] - value
        if not (np.isfinite(new[0]) and np.isfinite(new[1]).all() and np.isfinite(new[2]).all()) or gain < -1e-13 * max(1.0, abs(value)):
            load *= 8
            if load > 1e12:
                break
            continue
        load = max(load / 6, 1e-14) if gain > 0.5 * promise else load * 2 if gain < 0.1 * promise and promise > 1e-12 else load
        idle = idle + 1 if gain < 1e-10 * max(1.0, abs(value)) else 0
        theta, (value, grad, hess) = theta + step, new
        if idle == 6:
            raise FitError(f"the likelihood hardly changes any more around {_shown(names, theta)}")
        if np.exp(np.abs(theta).max()) > farthest:
            raise FitError(f"the likelihood still rises at {_shown(names, theta)}: no finite maximum")
    raise FitError(f"not settled after the last step, at {_shown(names, theta)}")


def _shown(names: Sequence[str], theta: np.ndarray) -> str:
    return ", ".join(f"{n}={np.exp(t):.3g}" for n, t in zip(names, theta, strict=True))


def parameter_table(like: DataFrame, params: dict[str, float], **tags: str) -> DataFrame:
    """Fitted parameters as rows (parameter, value) plus constant tag columns."""
    rows = [(k, float(v)) for k, v in params.items()]
    out = like.sparkSession.createDataFrame(rows, "parameter string, value double")
    for name, tag in tags.items():
        out = out.withColumn(name, F.lit(tag))
    return out
