"""Small dense linear algebra: covariance repair, weights, and corrections of one series at a time."""

from __future__ import annotations

import math

import numpy as np


def nearest_psd(matrix: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """The symmetric part with its eigenvalues raised to ``floor``."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.maximum(values, floor)) @ vectors.T


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """Shrinkage of the uncentred second-moment matrix towards a multiple of the identity."""
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = np.sum((s - mu * np.eye(p)) ** 2) / p
    noise = (np.mean(np.sum(x * x, axis=1) ** 2) - np.sum(s * s)) / (n * p)
    share = min(max(noise, 0.0), delta) / delta if delta > 0 else 0.0
    return share * mu * np.eye(p) + (1 - share) * s


def residual_covariance(x: np.ndarray, method: str = "ledoit_wolf") -> np.ndarray:
    """Covariance of residuals (rows: dates, NaN where missing), made positive definite.

    Complete rows are used; where there are too few, every entry is a pairwise-complete moment.
    """
    clean = x[np.isfinite(x).all(axis=1)]
    m = x.shape[1]
    if len(clean) < max(5, m + 1):
        out = np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
                if both.sum() >= 2:
                    out[i, j] = out[j, i] = np.cov(x[both, i], x[both, j], ddof=1)[0, 1]
        return np.diag(np.maximum(np.diag(out), 1e-10)) if method == "diagonal" else nearest_psd(out)
    if method == "diagonal":
        return np.diag(np.maximum(np.var(clean, axis=0, ddof=1), 1e-10))
    if method == "empirical":
        return nearest_psd(np.atleast_2d(np.cov(clean, rowvar=False, ddof=1)))
    return nearest_psd(ledoit_wolf(clean))


def minimum_variance_weights(sigma: np.ndarray, nonnegative: bool = True, cap: float | None = 0.5) -> np.ndarray:
    """Weights of sum 1 and least variance, within ``0`` (if nonnegative) and ``cap``.

    An active-set method on a positive definite matrix: solve on the free weights, move to the first
    bound in the way, and release the bound whose multiplier has the wrong sign until none has.
    """
    m = len(sigma)
    if not nonnegative and cap is None:
        inverse = np.linalg.pinv(sigma)
        total = float(inverse.sum())
        if total <= 0:
            raise ValueError("the covariance matrix gives no weights")
        return inverse.sum(axis=1) / total
    upper = 1.0 if cap is None else float(cap)
    lower = 0.0 if nonnegative else -np.inf
    if m * upper < 1 - 1e-12:
        raise ValueError(f"a weight cap of {upper} is infeasible for {m} pulls")
    w, state = np.full(m, 1 / m), np.zeros(m, int)  # -1 at the lower, 1 at the upper bound
    for _ in range(100 * m + 100):
        free = np.flatnonzero(state == 0)
        target = w.copy()
        if len(free):
            rest = np.flatnonzero(state != 0)
            k = len(free)
            kkt = np.zeros((k + 1, k + 1))
            kkt[:k, :k], kkt[:k, k], kkt[k, :k] = sigma[np.ix_(free, free)], -1, 1
            answer = np.linalg.solve(kkt, np.append(-sigma[np.ix_(free, rest)] @ w[rest], 1 - w[rest].sum()))
            target[free], price = answer[:k], answer[k]
        else:
            price = None
        step, hit = 1.0, None
        for i in free:
            d = target[i] - w[i]
            bound = upper if d > 0 else lower
            if abs(d) > 1e-15 and np.isfinite(bound) and (target[i] > upper + 1e-13 or target[i] < lower - 1e-13):
                t = (bound - w[i]) / d
                if t < step:
                    step, hit = max(t, 0.0), (i, 1 if d > 0 else -1)
        w = w + step * (target - w)
        if hit is not None:
            state[hit[0]], w[hit[0]] = hit[1], upper if hit[1] > 0 else lower
            continue
        gradient = sigma @ w
        if price is None:  # all at bounds: prices that keep every bound, if there are any
            high = gradient[state == 1].max(initial=-np.inf)
            low = gradient[state == -1].min(initial=np.inf)
            if high <= low + 1e-12:
                break
            state[int(np.argmax(np.where(state == 1, gradient, -np.inf)))] = 0
            state[int(np.argmin(np.where(state == -1, gradient, np.inf)))] = 0
            continue
        wrong = np.where(state == -1, price - gradient, np.where(state == 1, gradient - price, -np.inf))
        worst = int(np.argmax(wrong))
        if wrong[worst] <= 1e-12 * max(1.0, abs(price)):
            break
        state[worst] = 0
    w[np.abs(w) < 1e-12] = 0.0
    return w / w.sum()


def spectral_count(x: np.ndarray) -> float:
    """Squared trace over trace of the square of the correlation matrix of complete rows; NaN under three."""
    clean = x[np.isfinite(x).all(axis=1)]
    if len(clean) < 3:
        return float("nan")
    spread = clean.std(axis=0)
    z = np.divide(clean - clean.mean(axis=0), spread, out=np.zeros_like(clean), where=spread > 0)
    r = z.T @ z / len(clean)
    np.fill_diagonal(r, 1.0)
    return float(len(r) ** 2 / np.sum(r * r))


def tridiagonal_solve(diagonal: np.ndarray, side: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve a symmetric positive definite tridiagonal system for several right sides."""
    n = len(diagonal)
    c, d = np.zeros(n), np.array(right, float)
    pivot = diagonal[0]
    d[0] = d[0] / pivot
    for i in range(1, n):
        c[i - 1] = side[i - 1] / pivot
        pivot = diagonal[i] - side[i - 1] * c[i - 1]
        d[i] = (d[i] - side[i - 1] * d[i - 1]) / pivot
    for i in range(n - 2, -1, -1):
        d[i] = d[i] - c[i] * d[i + 1]
    return d


def benchmark_correction(z: np.ndarray, a: np.ndarray, b: np.ndarray, variance: np.ndarray, fidelity: float, smoothness: float, ridge: float) -> np.ndarray:
    """The smooth correction of a daily series towards period means.

    Minimises fidelity and first-difference smoothness of the correction with the periods' squared
    misses over their variances; variance 0 asks for exact means. Only a system of as many unknowns as
    periods is dense.
    """
    n = len(z)
    diagonal = np.full(n, fidelity + ridge + 2 * smoothness)
    diagonal[[0, -1]] -= smoothness
    if n == 1:
        diagonal[0] = fidelity + ridge
    back = tridiagonal_solve(diagonal, np.full(max(n - 1, 0), -smoothness), a.T)
    inner = a @ back + np.diag(variance)
    miss = b - a @ z
    try:
        price = np.linalg.solve(inner, miss)
    except np.linalg.LinAlgError:
        price = np.linalg.lstsq(inner, miss, rcond=None)[0]
    return back @ price


def principal(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest on, and their vectors with a sum that is not negative."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    return values, vectors * np.where(vectors.sum(axis=0) < 0, -1.0, 1.0)


def kaiser_count(values: np.ndarray, trace: float) -> int:
    """Eigenvalues above the average variance, at least one."""
    return max(1, int((values > trace / len(values)).sum())) if len(values) else 1


def broken_stick_count(values: np.ndarray, trace: float) -> int:
    """Leading eigenvalues that each exceed the expected piece of a stick broken at random."""
    k = len(values)
    pieces = np.cumsum((1 / np.arange(1, k + 1))[::-1])[::-1] * trace / k if k else np.zeros(0)
    fails = np.flatnonzero(values <= pieces)
    return int(fails[0]) if len(fails) else k


def normal_p(t: float) -> float:
    return math.erfc(abs(t) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def student_p(t: float, df: float) -> float:
    """Two-sided p value of Student's t."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def signed_rank_p(differences: np.ndarray) -> float:
    """Two-sided exact p value of the Wilcoxon signed-rank test without zeros; normal with ties or over 50 pairs."""
    d = differences[differences != 0]
    n = len(d)
    if not n:
        return float("nan")
    size = np.abs(d)
    order = np.argsort(size, kind="stable")
    ranks = np.empty(n)
    ranks[order] = np.arange(1, n + 1)
    unique, at, count = np.unique(size, return_inverse=True, return_counts=True)
    ranks = (np.bincount(at, ranks) / count)[at]
    plus = ranks[d > 0].sum()
    low = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and len(unique) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[: len(ways) - k].copy()
        return min(1.0, 2 * float(ways[: int(low) + 1].sum()) / 2.0**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - float(np.sum(count**3 - count)) / 48
    return normal_p((low - mean) / math.sqrt(var)) if var > 0 else float("nan")
