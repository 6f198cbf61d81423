"""Correlation dynamics, moment matching, constrained portfolios and elimination as NumPy kernels.

Defined cases: a target without variance is scaled by a floor; a solver that does
not converge says so in its result; inputs may not hold nulls.
"""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np

from .kernels import capped_simplex, fit_df, fit_garch, garch_variance, linear_programme, nearest_psd


def pattern_search(loss, starts, low: float = 1e-4, high: float = 0.999, step: float = 0.1, tol: float = 1e-4):
    """Best point of a box by halving steps along the axes, from the best of the starts."""
    best = min(starts, key=loss)
    value = loss(best)
    while step > tol:
        tries = [(*best[:k], min(max(best[k] + s * step, low), high), *best[k + 1 :]) for k in range(len(best)) for s in (1, -1)]
        now, new = min((loss(t), t) for t in tries)
        if now < value - 1e-10:
            best, value = new, now
        else:
            step /= 2
    return best, value


def correlation_path(z: np.ndarray, a: float, b: float, base: np.ndarray) -> np.ndarray:
    """Q of times 0..T, the first at its long-run level."""
    out = np.empty((len(z) + 1, *base.shape))
    out[0] = base
    for t, row in enumerate(z):
        out[t + 1] = (1 - a - b) * base + a * np.outer(row, row) + b * out[t]
    return out


def _to_correlation(q: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.einsum("...ii->...i", q))
    return q / (sd[..., :, None] * sd[..., None, :])


def fit_correlation(z: np.ndarray) -> dict:
    """(a, b) of the correlations of standardised residuals by Gaussian likelihood, the state after them, and the tails' degrees of freedom."""
    base = nearest_psd(z.T @ z / len(z))

    def loss(point):
        total, share = point
        chol = np.linalg.cholesky(_to_correlation(correlation_path(z, total * share, total * (1 - share), base)[:-1]))
        u = np.linalg.solve(chol, z[:, :, None])[:, :, 0]
        return float(np.sum(2 * np.log(np.einsum("tii->ti", chol)).sum(1) + (u * u).sum(1) - (z * z).sum(1)))

    (total, share), value = pattern_search(loss, [(0.5, 0.1), (0.9, 0.05), (0.97, 0.03)], tol=1e-3)
    a, b = total * share, total * (1 - share)
    # the residuals have mean 0 and the long-run covariance
    tails = fit_df(z, np.ones(len(z)), mean=np.zeros(z.shape[1]), cov=base)
    return {"a": a, "b": b, "loss": value, "df": tails["df"], "base": base, "next_q": correlation_path(z, a, b, base)[-1]}


def fit_dcc(e: np.ndarray) -> dict:
    """Two-step fit of centred returns: one variance recursion per column, then the correlations."""
    single = [fit_garch(col) for col in e.T]
    var = np.array([garch_variance(col, g[0], g[1])[:-1] for col, g in zip(e.T, single, strict=True)]).T
    own = dict(zip(("alpha", "beta", "next_variance"), np.array(single).T, strict=True))
    return fit_correlation(e / np.sqrt(var)) | own | {"target": (e * e).mean(0)}


def simulate_dcc(fit: dict, mean: np.ndarray, df: float, paths: int, horizon: int, seed: int) -> np.ndarray:
    """Compounded simple returns of the horizon: (paths, columns), with unit-variance t innovations."""
    if df <= 2:
        raise ValueError("innovations need over 2 degrees of freedom")
    rng = np.random.default_rng(seed)
    n = len(mean)
    var, q = np.tile(fit["next_variance"], (paths, 1)), np.tile(fit["next_q"], (paths, 1, 1))
    wealth = np.ones((paths, n))
    for _ in range(horizon):
        draw = rng.standard_normal((paths, n)) * np.sqrt((df - 2) / rng.chisquare(df, paths))[:, None]
        z = np.einsum("pij,pj->pi", np.linalg.cholesky(_to_correlation(q) + 1e-10 * np.eye(n)), draw)
        e = np.sqrt(var) * z
        wealth *= 1 + mean + e
        var = (1 - fit["alpha"] - fit["beta"]) * fit["target"] + fit["alpha"] * e * e + fit["beta"] * var
        q = (1 - fit["a"] - fit["b"]) * fit["base"] + fit["a"] * z[:, :, None] * z[:, None, :] + fit["b"] * q
    return wealth - 1


#: Weights of the four moments and of the covariances, and the floors of their scales.
MOMENT_WEIGHTS, COV_WEIGHT, MOMENT_FLOOR, COV_FLOOR = (2.0, 1.5, 0.5, 0.3), 0.05, 1e-6, 1e-3


class Objective(Protocol):
    """What block-coordinate descent can lower: a value of (x, p) with its gradients in both."""

    def value_and_gradients(self, x: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]: ...


class MomentTarget:
    """Scaled distance of (x, p) from four central moments and the covariances of each pair, with its gradients."""

    def __init__(self, moments: np.ndarray, cov: np.ndarray, weights=MOMENT_WEIGHTS, cov_weight: float = COV_WEIGHT):
        sd = np.sqrt(np.maximum(moments[1], MOMENT_FLOOR**2))
        scale = np.maximum(np.vstack([sd, sd**2, sd**3, sd**4]), MOMENT_FLOOR)
        self.moments, self.cov = moments, cov
        self.weight = np.array(weights)[:, None] / scale**2
        own = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        self.pair = 0.5 * cov_weight / np.maximum(np.outer(own, own), COV_FLOOR) ** 2
        np.fill_diagonal(self.pair, 0)

    def value_and_gradients(self, x: np.ndarray, p: np.ndarray):
        mean = p @ x
        d = x - mean
        m = np.vstack([mean, *(p @ d**k for k in (2, 3, 4))])
        gap, cgap = m - self.moments, (d * p[:, None]).T @ d - self.cov
        f = float((self.weight * gap**2).sum() + (self.pair * cgap**2).sum())
        g, c = 2 * self.weight * gap, 2 * self.pair * cgap
        # a shift of the mean moves the higher moments by -k times the next lower one
        drift = g[0] - 2 * g[1] * (p @ d) - 3 * g[2] * m[1] - 4 * g[3] * m[2]
        gx = p[:, None] * (drift + 2 * g[1] * d + 3 * g[2] * d**2 + 4 * g[3] * d**3 + 2 * d @ c)
        gp = x @ drift + d**2 @ g[1] + d**3 @ g[2] + d**4 @ g[3] + np.einsum("ni,ij,nj->n", d, c, d)
        return f, gx, gp


def descend(f, x: np.ndarray, rounds: int = 40):
    """Limited-memory quasi-Newton descent of f (value, gradient, extra); only steps that lower the value are taken."""
    value, grad, *_ = f(x)
    pairs = []
    for _ in range(rounds):
        direction, stack = grad.ravel().copy(), []
        for s, y, r in reversed(pairs):
            w = r * (s @ direction)
            stack.append(w)
            direction -= w * y
        if pairs:
            s, y, _ = pairs[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction *= 1e-2 * max(np.abs(x).max(), 1e-12) / max(np.abs(direction).max(), 1e-300)
        for (s, y, r), w in zip(pairs, reversed(stack), strict=True):
            direction += s * (w - r * (y @ direction))
        slope, step = grad.ravel() @ direction, 1.0
        for _ in range(25):
            moved = x - step * direction.reshape(x.shape)
            now, new_grad, *_ = f(moved)
            if now <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = (moved - x).ravel(), (new_grad - grad).ravel()
        if s @ y > 1e-300:
            pairs = [*pairs[-9:], (s, y, 1 / (s @ y))]
        x, value, grad = moved, now, new_grad
    return x


class Matching:
    """Block-coordinate descent of G(x, p) = F(x, p) + entropy * KL(p, uniform), F any objective: p, then x, never upwards.

    p steps: ``mirror`` (exponentiated gradient) or ``projected`` (gradient on the simplex). x steps: ``joint``,
    ``sequential`` (a column at a time) or ``jacobi`` (all columns from one snapshot; sequential where G would rise).
    """

    def __init__(self, target: Objective, entropy: float = 1e-5, p_step: str = "mirror", x_step: str = "joint"):
        if p_step not in ("mirror", "projected") or x_step not in ("joint", "sequential", "jacobi"):
            raise ValueError("unknown step")
        self.target, self.entropy, self.p_step, self.x_step = target, entropy, p_step, x_step

    def g(self, x, p):
        """(F, G, dG/dx, dG/dp)."""
        f, gx, gp = self.target.value_and_gradients(x, p)
        live = np.log(np.maximum(p, 1e-300) * len(p))
        return f, f + self.entropy * float(p @ live), gx, gp + self.entropy * (live + 1)

    def step_p(self, x, p, rounds: int = 5):
        _, g, _, gp = self.g(x, p)
        for _ in range(rounds):
            flat = gp - p @ gp
            step = 1 / max(np.abs(flat).max(), 1e-12)
            if self.p_step == "projected":
                step *= p.max()
            for _ in range(25):
                if self.p_step == "mirror":
                    new = p * np.exp(-step * flat)
                    new /= new.sum()
                else:
                    new = capped_simplex(p - step * flat)
                _, now, _, new_gp = self.g(x, new)
                if now <= g:
                    break
                step /= 2
            else:
                break
            calm = g - now <= 1e-8 * max(abs(g), 1e-12)
            p, g, gp = new, now, new_gp
            if calm:
                break
        return p

    def step_x(self, x, p):
        def whole(y):
            _, g, gx, _ = self.g(y, p)
            return g, gx

        if self.x_step == "joint":
            return descend(whole, x)

        def column(base, i):
            def part(col):
                y = base.copy()
                y[:, i] = col
                g, gx = whole(y)
                return g, gx[:, i]

            return descend(part, base[:, i].copy())

        if self.x_step == "jacobi":
            new = np.column_stack([column(x, i) for i in range(x.shape[1])])
            if whole(new)[0] <= whole(x)[0]:
                return new
        x = x.copy()
        for i in range(x.shape[1]):
            x[:, i] = column(x, i)
        return x

    def residuals(self, x, p) -> tuple[float, float]:
        """Largest gradient in x, and in p along the simplex."""
        _, _, gx, gp = self.g(x, p)
        return float(np.abs(gx).max()), float(np.abs(gp - gp.mean()).max())

    def run(self, x, p, rounds: int = 150, least: int = 5, patience: int = 3, tol: float = 1e-6, limits: tuple[float, float] = (1e-4, 1e-4)) -> dict:
        """x, p, f, g, rounds, converged, the residuals, stationary, and G after every round."""
        _, g, _, _ = self.g(x, p)
        path, calm, done = [g], 0, 0
        for done in range(1, rounds + 1):
            p = self.step_p(x, p)
            x = self.step_x(x, p)
            f, now, _, _ = self.g(x, p)
            if now > g + 1e-9:
                raise ArithmeticError(f"G rose from {g} to {now}")
            calm = calm + 1 if abs(g - now) / (abs(g) + 1e-10) < tol else 0
            g = now
            path.append(g)
            if done >= least and calm >= patience:
                break
        rx, rp = self.residuals(x, p)
        return {"x": x, "p": p, "f": f, "g": g, "rounds": done, "converged": calm >= patience, "x_residual": rx, "p_residual": rp, "stationary": rx <= limits[0] and rp <= limits[1], "path": path}


def max_sharpe(mean: np.ndarray, cov: np.ndarray, start: np.ndarray, ridge: float = 0.01, cap: float = 1.0, risk_free: float = 0.0) -> tuple[np.ndarray, float]:
    """(weights, loss) of -Sharpe + ridge * |w - 1/n|^2 over the capped simplex by projected gradient from one start."""
    n = len(mean)
    mean = mean - risk_free  # the weights sum to 1

    def loss(w):
        sd = math.sqrt(max(w @ cov @ w, 1e-18))
        return -(w @ mean) / sd + ridge * float(((w - 1 / n) ** 2).sum()), sd

    w, step = capped_simplex(start, cap), 1.0
    value, sd = loss(w)
    for _ in range(2000):
        grad = -mean / sd + (w @ mean) * (cov @ w) / sd**3 + 2 * ridge * (w - 1 / n)
        new = capped_simplex(w - step * grad, cap)
        now, new_sd = loss(new)
        if now < value:
            if np.abs(new - w).max() < 1e-12:
                break
            w, value, sd, step = new, now, new_sd, step * 1.5
        else:
            step /= 2
            if step < 1e-14:
                break
    return w, value


def tail_loss(w: np.ndarray, x: np.ndarray, p: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Mean loss of the worst alpha of the mass (with a fraction of the last scenario) and its subgradient."""
    loss = -x @ w
    order = np.argsort(-loss, kind="stable")
    before = np.cumsum(p[order]) - p[order]
    mass = np.zeros(len(p))
    mass[order] = np.clip(alpha - before, 0, p[order]) / alpha
    return float(mass @ loss), -mass @ x


def min_cvar(x: np.ndarray, p: np.ndarray, alpha: float = 0.05, cap: float = 1.0, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """(weights, tail loss), exact: the tail loss is the largest of finitely many linear functions of w.

    Each round adds the one that is largest at the point at hand, and a small linear programme finds the next point; it
    ends where the programme's bound meets the tail loss there.
    """
    n = x.shape[1]
    if cap * n < 1 - 1e-12:
        raise ValueError("the cap is infeasible")
    w = capped_simplex(np.full(n, 1 / n), cap)
    best, value, cuts = w, np.inf, []
    for _ in range(10_000):
        now, grad = tail_loss(w, x, p, alpha)
        if now < value:
            best, value = w, now
        cuts.append(grad)
        k = len(cuts)
        # w, slack to the cap, level up and down, slack of every cut
        a = np.zeros((1 + n + k, 2 * n + 2 + k))
        b = np.r_[1.0, np.full(n, cap), np.zeros(k)]
        a[0, :n] = 1
        a[1 : n + 1, :n] = a[1 : n + 1, n : 2 * n] = np.eye(n)
        a[n + 1 :, :n] = np.array(cuts)
        a[n + 1 :, 2 * n], a[n + 1 :, 2 * n + 1] = -1, 1
        a[n + 1 :, 2 * n + 2 :] = np.eye(k)
        cost = np.zeros(a.shape[1])
        cost[2 * n], cost[2 * n + 1] = 1, -1
        point = linear_programme(cost, a, b)
        w, bound = point[:n], point[2 * n] - point[2 * n + 1]
        if value - bound <= tol * max(1.0, abs(value)):
            return best, value
    raise ArithmeticError("the cuts did not meet")


#: A spread of bootstrap means up to this share of the losses' size is rounding of their sums.
ROUNDING = 1e-12


def eliminate(mean: np.ndarray, drawn: np.ndarray, size: np.ndarray | None = None) -> list[tuple[int, int, float, float]]:
    """(column, step at which it left, p, statistic) of mean losses and their bootstrap means (samples, columns).

    The range statistic's elimination: p never falls, the survivor has 1. ``size`` has the mean absolute losses, if
    losses are signed. Two models whose bootstrap differences only differ by rounding (one block takes the whole
    series, or the difference is constant) have statistic 0; where all do, the first column leaves, at p = 1.
    """
    left, out, top = list(range(len(mean))), [], 0.0
    size = np.abs(mean) if size is None else size
    while len(left) > 1:
        gap = mean[left][:, None] - mean[left]
        noise = drawn[:, left][:, :, None] - drawn[:, left][:, None, :] - gap
        sd = np.sqrt((noise**2).mean(0))
        real = sd > ROUNDING * np.maximum(size[left][:, None], size[left])
        safe = np.where(real, sd, 1)
        t = np.where(real, gap / safe, 0)
        far = np.where(real, np.abs(noise) / safe, 0).max((1, 2))
        top = max(top, float((1 + (far >= np.abs(t).max()).sum()) / (len(drawn) + 1)))
        worst = int(t.max(1).argmax())
        out.append((left.pop(worst), len(out) + 1, top, float(np.abs(t).max())))
    return [*out, (left[0], len(out) + 1, 1.0, 0.0)]


def kolmogorov_tail(d: float, n: int) -> float:
    """P(D_n >= d) of the two-sided statistic, exact, by powers of Marsaglia, Tsang and Wang's matrix."""
    if d <= 0.5 / n:
        return 1.0
    if d >= 1:
        return 0.0
    k = math.ceil(n * d)
    m, h = 2 * k - 1, k - n * d
    a = np.tri(m, m, 1)
    powers = h ** np.arange(1, m + 1)
    a[:, 0] -= powers
    a[-1] -= powers[::-1]
    a[-1, 0] += max(2 * h - 1, 0) ** m
    i, j = np.indices((m, m))
    a *= np.vectorize(lambda q: 1 / math.gamma(q + 2) if q < 169 else 0.0)(np.maximum(i - j, -1))
    value, shift = np.eye(m), 0
    base, base_shift, left = a, 0, n
    while left:
        if left & 1:
            value, shift = value @ base, shift + base_shift
            if value[k - 1, k - 1] > 1e140:
                value, shift = value * 1e-140, shift + 140
        base, base_shift, left = base @ base, 2 * base_shift, left >> 1
        if base[k - 1, k - 1] > 1e140:
            base, base_shift = base * 1e-140, base_shift + 140
    log10 = math.log10(value[k - 1, k - 1]) + shift + math.lgamma(n + 1) / math.log(10) - n * math.log10(n) if value[k - 1, k - 1] > 0 else -math.inf
    return min(1.0, max(0.0, 1 - 10**log10))
