"""Moment matching of scenario sets of any size: X and p stay partitioned.

The objective G(x, p) = F(x, p) + entropy * KL(p, uniform) sees a set through its
weighted power sums and cross products only, so a value is one aggregate; given the
sums, gradients are formulas of a row. The set is a table of blocks of scenarios.

p steps are exponentiated gradients: all trial steps are summed in one pass, their
normalisers with them. x steps are limited-memory quasi-Newton steps without vectors
on the driver: blocks hold the last changes of x and of the gradient, one aggregate
gives all their products with one another and the gradient, the two-loop recursion
runs on these numbers, and every block adds up its own direction. Trial steps are
summed in one pass, too. What the driver holds grows with the assets and the memory,
never with the scenarios.

Defined cases: a step that lowers nothing in 24 halvings is not taken; a set without
scenarios is an error; inputs may not hold nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, ship
from .dynamics import MomentTarget

#: Scenarios of a block, changes that are remembered, trial steps of a pass and passes of a search.
ROWS, MEMORY, TRIALS, PASSES = 4096, 5, 8, 3
STATE = "block long, rows int, p binary, x binary, past binary"


@dataclass(frozen=True)
class Point:
    """What the sums of a set say: values, and the coefficients of its gradients."""

    f: float
    g: float
    mean: np.ndarray
    slopes: np.ndarray  # of the four moments
    cross: np.ndarray
    drift: np.ndarray
    scenarios: int
    entropy: float

    def gradients(self, p: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of G by x and by p, for some of the rows."""
        d, (_, b, c, e) = x - self.mean, self.slopes
        gx = p[:, None] * (self.drift + 2 * b * d + 3 * c * d**2 + 4 * e * d**3 + 2 * d @ self.cross)
        gp = x @ self.drift + d**2 @ b + d**3 @ c + d**4 @ e + np.einsum("ni,ij,nj->n", d, self.cross, d)
        return gx, gp + self.entropy * (np.log(np.maximum(p, 1e-300) * self.scenarios) + 1)


def _power_sums(p: np.ndarray, x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Mass, four power sums and cross products about a shift, and the sum of p log p."""
    d = x - shift
    return np.concatenate([[p.sum()], *(p @ d**k for k in (1, 2, 3, 4)), ((d * p[:, None]).T @ d).ravel(), [p @ np.log(np.maximum(p, 1e-300))]])


def _point(sums: np.ndarray, target: MomentTarget, scenarios: int, entropy: float) -> Point:
    n = target.moments.shape[1]
    mass, s, cross, logs = sums[0], sums[1 : 1 + 4 * n].reshape(4, n) / sums[0], sums[1 + 4 * n : -1].reshape(n, n) / sums[0], sums[-1]
    d = s[0]
    m2 = s[1] - d * d
    m3 = s[2] - 3 * d * s[1] + 2 * d**3
    m4 = s[3] - 4 * d * s[2] + 6 * d * d * s[1] - 3 * d**4
    mean = target.moments[0] + d
    gap, cgap = np.vstack([mean, m2, m3, m4]) - target.moments, cross - np.outer(d, d) - target.cov
    f = float((target.weight * gap**2).sum() + (target.pair * cgap**2).sum())
    g, c = 2 * target.weight * gap, 2 * target.pair * cgap
    kl = float(logs / mass - np.log(mass) + np.log(scenarios))
    return Point(f, f + entropy * kl, mean, g, c, g[0] - 3 * g[2] * m2 - 4 * g[3] * m3, scenarios, entropy)


def _opened(pdf: pd.DataFrame, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, p, x, past) of each block; past has the changes of x and of the gradient by age."""
    for i, (rows, p, x, past) in enumerate(zip(pdf["rows"], pdf["p"], pdf["x"], pdf["past"])):
        yield i, np.frombuffer(p), np.frombuffer(x).reshape(rows, n), np.frombuffer(past).reshape(-1, 2, rows, n)


class Set:
    """A partitioned scenario set, its target, and what its sums say."""

    def __init__(self, state: DataFrame, target: MomentTarget, entropy: float = 1e-5):
        self.target, self.entropy, self.assets = target, entropy, target.moments.shape[1]
        ship(state.sparkSession)
        self.state = cut(state)
        self.scenarios = self.state.agg(F.sum("rows")).first()[0]
        if not self.scenarios:
            raise ValueError("a set without scenarios")
        shift = target.moments[0]
        self.point = self._points(lambda p, x, past: [_power_sums(p, x, shift)])[0]

    def _sums(self, of: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
        """Sums over all blocks of some vectors of each block: tasks add up their own, and an aggregate the tasks'."""
        n = self.assets

        def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: list[np.ndarray] = []
            for pdf in batches:
                for _, p, x, past in _opened(pdf, n):
                    own = of(p, x, past)
                    total = [a + b for a, b in zip(total, own)] if total else own
            for k, v in enumerate(total):
                yield pd.DataFrame({"vector": k, "at": np.arange(len(v)), "v": v})

        rows = self.state.mapInPandas(fn, "vector int, at int, v double").groupBy("vector", "at").agg(F.sum("v").alias("v")).orderBy("vector", "at").collect()
        out: dict[int, list[float]] = {}
        for r in rows:
            out.setdefault(r["vector"], []).append(r["v"])
        return [np.array(out[k]) for k in sorted(out)]

    def _points(self, of) -> list[Point]:
        return [_point(s, self.target, self.scenarios, self.entropy) for s in self._sums(of)]

    def _changed(self, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], point: Point) -> None:
        """Give every block its new p, x and past."""
        n = self.assets

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                new = [fn(p, x, past) for _, p, x, past in _opened(pdf, n)]
                yield pdf[["block", "rows"]].assign(**{c: [np.ascontiguousarray(v[k]).tobytes() for v in new] for k, c in enumerate(("p", "x", "past"))})

        self.state, self.point = cut(self.state.mapInPandas(run, STATE)), point

    def _spread(self) -> tuple[float, float, float, float, float]:
        """Of dG/dp: its mean, its mean under p, the least and the greatest; and the greatest of dG/dx."""
        n, at = self.assets, self.point

        def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, p, x, _ in _opened(pdf, n):
                    gx, gp = at.gradients(p, x)
                    yield pd.DataFrame([(gp.sum(), p @ gp, gp.min(), gp.max(), np.abs(gx).max())], columns=list("abcde"))

        rows = self.state.mapInPandas(fn, "a double, b double, c double, d double, e double")
        a, b, c, d, e = rows.agg(F.sum("a"), F.sum("b"), F.min("c"), F.max("d"), F.max("e")).first()
        return a / self.scenarios, b, c, d, e

    def residuals(self) -> tuple[float, float]:
        """Largest gradient in x, and in p along the simplex."""
        mean, _, low, high, gx = self._spread()
        return gx, max(abs(low - mean), abs(high - mean))

    def step_p(self, rounds: int = 5) -> None:
        """Exponentiated gradients in p, each no higher than before."""
        shift = self.target.moments[0]
        for _ in range(rounds):
            at, (_, centre, low, high, _) = self.point, self._spread()
            first = 1 / max(abs(low - centre), abs(high - centre), 1e-12)
            for k in range(PASSES):
                steps = [first / 2**t for t in range(TRIALS * k, TRIALS * (k + 1))]

                def tried(p, x, past, at=at, centre=centre, steps=steps):
                    flat = at.gradients(p, x)[1] - centre
                    return [_power_sums(p * np.exp(-s * flat), x, shift) for s in steps]

                sums = self._sums(tried)
                points = [_point(s, self.target, self.scenarios, self.entropy) for s in sums]
                best = next((t for t, q in enumerate(points) if q.g <= at.g), None)
                if best is not None:
                    break
            else:
                return
            step, mass, calm = steps[best], sums[best][0], at.g - points[best].g <= 1e-8 * max(abs(at.g), 1e-12)

            def moved(p, x, past, at=at, centre=centre, step=step, mass=mass):
                # other weights have other gradients: what was remembered of them is dropped
                return p * np.exp(-step * (at.gradients(p, x)[1] - centre)) / mass, x, past[:0]

            self._changed(moved, points[best])
            if calm:
                return

    def step_x(self, rounds: int = 10) -> int:
        """Quasi-Newton steps in x, each lower by a share of its slope. Steps that were taken."""
        shift = self.target.moments[0]
        for done in range(rounds):
            at = self.point

            def products(p, x, past, at=at):
                basis = np.concatenate([past.reshape(2 * len(past), x.size), at.gradients(p, x)[0].reshape(1, -1)])
                return [(basis @ basis.T).ravel()]

            gram = self._sums(products)[0]
            size = round(len(gram) ** 0.5)
            weights = _two_loop(gram.reshape(size, size))
            if size == 1:  # nothing is remembered: a step of a hundredth of the greatest value
                top = self._tops(at)
                weights = weights * 1e-2 * max(top[0], 1e-12) / max(top[1], 1e-300)
            slope = float(gram.reshape(size, size)[-1] @ weights)

            def direction(p, x, past, at=at, weights=weights):
                return np.tensordot(weights[:-1], past.reshape(2 * len(past), *x.shape), 1) + weights[-1] * at.gradients(p, x)[0]

            for k in range(PASSES):
                steps = [0.5**t for t in range(TRIALS * k, TRIALS * (k + 1))]

                def tried(p, x, past, steps=steps, direction=direction):
                    d = direction(p, x, past)
                    return [_power_sums(p, x - s * d, shift) for s in steps]

                points = self._points(tried)
                best = next((t for t, q in enumerate(points) if q.g <= at.g - 1e-4 * steps[t] * slope), None)
                if best is not None:
                    break
            else:
                return done
            step, new = steps[best], points[best]

            def moved(p, x, past, at=at, step=step, new=new, direction=direction):
                y = x - step * direction(p, x, past)
                change = np.stack([y - x, new.gradients(p, y)[0] - at.gradients(p, x)[0]])
                return p, y, np.concatenate([past, change[None]])[-MEMORY:]

            self._changed(moved, new)
        return rounds

    def _tops(self, at: Point) -> tuple[float, float]:
        n = self.assets

        def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, p, x, _ in _opened(pdf, n):
                    yield pd.DataFrame([(np.abs(x).max(), np.abs(at.gradients(p, x)[0]).max())], columns=["x", "g"])

        return tuple(self.state.mapInPandas(fn, "x double, g double").agg(F.max("x"), F.max("g")).first())

    def run(self, rounds: int, x_rounds: int = 10, p_rounds: int = 5, tol: float = 1e-6) -> list[float]:
        """p, then x, until G is calm; G after every round."""
        path = [self.point.g]
        for _ in range(rounds):
            self.step_p(p_rounds)
            self.step_x(x_rounds)
            path.append(self.point.g)
            if abs(path[-2] - path[-1]) / (abs(path[-2]) + 1e-10) < tol:
                break
        return path

    def scenarios_table(self, names: list[str]) -> DataFrame:
        """(scenario, asset, p, x)."""
        n = self.assets

        def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i, p, x, _ in _opened(pdf, n):
                    first = int(pdf["block"].iloc[i]) * ROWS
                    yield pd.DataFrame({"scenario": np.repeat(first + np.arange(len(p)), n), "asset": names * len(p), "p": np.repeat(p, n), "x": x.ravel()})

        return self.state.mapInPandas(fn, "scenario long, asset string, p double, x double")


def _two_loop(gram: np.ndarray) -> np.ndarray:
    """Weights of the direction among (s_1, y_1, ..., s_m, y_m, gradient), from all their products."""
    m = len(gram) // 2
    weights, stack = np.zeros(len(gram)), []
    weights[-1] = 1.0
    live = [k for k in range(m) if gram[2 * k, 2 * k + 1] > 1e-300]
    for k in reversed(live):
        w = gram[2 * k] @ weights / gram[2 * k, 2 * k + 1]
        stack.append(w)
        weights[2 * k + 1] -= w
    if live:
        k = live[-1]
        weights *= gram[2 * k, 2 * k + 1] / gram[2 * k + 1, 2 * k + 1]
    for k, w in zip(live, reversed(stack)):
        weights[2 * k] += w - gram[2 * k + 1] @ weights / gram[2 * k, 2 * k + 1]
    return weights


def started(spark, target: MomentTarget, scenarios: int, seed: int) -> DataFrame:
    """Blocks of a set with the target's means and covariances and exponential weights; every block draws from a seed of its own."""
    mean, chol = target.moments[0], np.linalg.cholesky(target.cov)

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for block in pdf["id"]:
                rows = min(ROWS, scenarios - block * ROWS)
                rng = np.random.default_rng([seed, block])
                x = mean + rng.standard_normal((rows, len(mean))) @ chol.T
                out.append((block, rows, rng.exponential(1.0, rows).tobytes(), x.tobytes(), b""))
            yield pd.DataFrame(out, columns=["block", "rows", "p", "x", "past"])

    ship(spark)
    blocks = spark.range(-(-scenarios // ROWS)).mapInPandas(fn, STATE)
    total = blocks.mapInPandas(lambda b: (pd.DataFrame({"s": [np.frombuffer(p).sum() for p in pdf["p"]]}) for pdf in b), "s double").agg(F.sum("s")).first()[0]

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(p=[(np.frombuffer(p) / total).tobytes() for p in pdf["p"]])

    return blocks.mapInPandas(scaled, STATE)


def blocks_of(spark, p: np.ndarray, x: np.ndarray, rows: int = ROWS) -> DataFrame:
    """The state table of a small set that the driver has."""
    return spark.createDataFrame([(k // rows, len(p[k : k + rows]), p[k : k + rows].tobytes(), np.ascontiguousarray(x[k : k + rows]).tobytes(), b"") for k in range(0, len(p), rows)], STATE)
