"""Portfolio weights.  Spark sums moments of the return columns; matrices are assets squared."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(wide: DataFrame, assets: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mean, population covariance) of return columns."""
    pairs = [(i, j) for i in range(len(assets)) for j in range(i, len(assets))]
    row = wide.agg(*(F.avg(a).alias(f"m{i}") for i, a in enumerate(assets)), *(F.covar_pop(assets[i], assets[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.zeros((len(assets),) * 2)
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return np.array([row[f"m{i}"] or 0.0 for i in range(len(assets))]), cov


def shrunk(cov: np.ndarray, share: float = 0.1) -> np.ndarray:
    """Towards the mean variance; then the nearest matrix without negative eigenvalues."""
    mixed = (1 - share) * cov + share * np.eye(len(cov)) * (np.trace(cov) / max(len(cov), 1))
    values, vectors = np.linalg.eigh(mixed)
    return vectors @ np.diag(np.maximum(values, 1e-10)) @ vectors.T


def onto_bounds(v: np.ndarray, low: float, high: float, total: float = 1.0) -> np.ndarray:
    """Nearest weights within [low, high] that sum to ``total`` (as near as the bounds allow)."""
    a, b = float((v - high).min()) - 1, float((v - low).max()) + 1
    for _ in range(100):
        shift = (a + b) / 2
        a, b = (shift, b) if np.clip(v - shift, low, high).sum() > total else (a, shift)
    return np.clip(v - (a + b) / 2, low, high)


def climb(value, slope, n: int, low: float, high: float, rounds: int = 5000) -> np.ndarray:
    """Weights that maximise a concave (or pseudo-concave) function within bounds, by projected steps with backtracking."""
    w, step = onto_bounds(np.full(n, 1 / n), low, high), 1.0
    now = value(w)
    for _ in range(rounds):
        g, step = slope(w), step * 4
        while True:
            new = onto_bounds(w + step * g, low, high)
            then, move = value(new), new - w
            if then >= now + 0.25 * float(g @ move) or step < 1e-18:
                break
            step /= 2
        if np.abs(move).max() < 1e-13:
            break
        w, now = new, then
    return w


def mean_variance(mu: np.ndarray, cov: np.ndarray, aversion: float = 1.0, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """Weights that maximise mu'w - aversion / 2 w'Cw within bounds; they sum to 1."""
    return climb(lambda w: mu @ w - aversion / 2 * (w @ cov @ w), lambda w: mu - aversion * (cov @ w), len(mu), low, high)


def risk_parity(cov: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Equal risk contributions, by the usual multiplicative iteration from inverse variances."""
    w = 1 / np.maximum(np.diag(cov), 1e-12)
    w /= w.sum()
    for _ in range(rounds):
        share = w * (cov @ w)
        if share.min() <= 0:
            break
        w = w * (share.mean() / share) ** 0.25
        w /= w.sum()
    return w


def hierarchical(cov: np.ndarray) -> np.ndarray:
    """Halves of the assets in order, and their halves, joined from single assets up: each side weighs as the other's variance."""

    def joined(a: int, b: int) -> np.ndarray:
        if b - a == 1:
            return np.ones(1)
        mid = a + (b - a) // 2
        sides = [(joined(a, mid), cov[a:mid, a:mid]), (joined(mid, b), cov[mid:b, mid:b])]
        left, right = (float(w @ c @ w) for w, c in sides)
        share = 1 - left / (left + right + 1e-10)
        return np.concatenate([share * sides[0][0], (1 - share) * sides[1][0]])

    return joined(0, len(cov))


def max_diversification(cov: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """Weights within bounds with the largest ratio of mean deviation to the portfolio's deviation."""
    sd = np.sqrt(np.diag(cov))
    scale = float(np.mean(np.diag(cov))) or 1.0
    unit, unit_sd = cov / scale, sd / scale**0.5

    def slope(w):
        risk = np.sqrt(max(float(w @ unit @ w), 1e-10))
        return unit_sd / risk - (w @ unit_sd) * (unit @ w) / risk**3

    return climb(lambda w: (w @ unit_sd) / np.sqrt(max(float(w @ unit @ w), 1e-10)), slope, len(cov), low, high)


def black_litterman(cov: np.ndarray, market: np.ndarray, views: dict[int, float], aversion: float = 1.0, tau: float = 0.05, confidence: float = 0.5, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """Mean-variance weights of the posterior: returns implied by ``market``, and views held with ``confidence`` (0 to 1)."""
    mean, spread = aversion * cov @ market, cov
    if views:
        pick = np.eye(len(cov))[list(views)]
        doubt = (1 - confidence) / max(confidence, 1e-6) * np.eye(len(views))
        gain = tau * cov @ pick.T @ np.linalg.inv(pick @ (tau * cov) @ pick.T + doubt)
        mean = mean + gain @ (np.array(list(views.values())) - pick @ mean)
        spread = cov + tau * cov - gain @ pick @ (tau * cov)
    return mean_variance(mean, spread, aversion, low, high)


def capped(weights: np.ndarray, cap: float, groups: list | None = None, group_cap: float = 1.0) -> np.ndarray:
    """Weights of at most ``cap`` (and ``group_cap`` a group) that sum to 1 if the caps allow; excess flows to the rest."""
    w = np.maximum(weights, 0)
    w = w / w.sum() if w.sum() else np.full(len(w), 1 / max(len(w), 1))
    for _ in range(100):
        limit = np.full(len(w), cap)
        for g in set(groups or ()):
            own = np.array([x == g for x in groups])
            if w[own].sum() > group_cap:
                w[own] *= group_cap / w[own].sum()
                limit[own] = np.minimum(limit[own], w[own])
        w = np.minimum(w, limit)
        room = (w < limit - 1e-12)
        if w.sum() >= 1 - 1e-12 or not room.any():
            break
        base = np.where(room, np.maximum(w, 1e-12), 0)
        w = w + base / base.sum() * (1 - w.sum())
    return w


def optimize(wide: DataFrame, assets: list[str], method: str = "risk_parity", cap: float = 1.0, **options) -> dict[str, float]:
    """Weights by mvo, risk_parity, black_litterman, hrp or max_div, none above ``cap``; {} without assets.

    options: aversion, views ({number: return}), confidence.  The bounded
    problems hold the cap themselves; the others' excess flows to the rest.
    """
    if not assets:
        return {}
    mu, cov = moments(wide, assets)
    cov = shrunk(cov)
    if len(assets) == 1:
        return {assets[0]: 1.0}
    high = max(cap, 1 / len(assets))
    made = {
        "mvo": lambda: mean_variance(mu, cov, options.get("aversion", 1.0), high=high), "risk_parity": lambda: risk_parity(cov), "hrp": lambda: hierarchical(cov), "max_div": lambda: max_diversification(cov, high=high),
        "black_litterman": lambda: black_litterman(cov, np.full(len(assets), 1 / len(assets)), options.get("views", {}), options.get("aversion", 1.0), confidence=options.get("confidence", 0.5), high=high),
    }[method]()
    return dict(zip(assets, capped(made, cap).tolist()))


def portfolio_risk(wide: DataFrame, weights: dict[str, float]) -> dict:
    """Volatility, marginal and percentage contributions, diversification ratio."""
    assets = list(weights)
    _, cov = moments(wide, assets)
    w = np.array([weights[a] for a in assets])
    total = float(np.sqrt(max(w @ cov @ w, 0)))
    marginal = cov @ w / total if total else np.zeros(len(w))
    return {"volatility": total, "marginal": dict(zip(assets, marginal.tolist())), "contribution": dict(zip(assets, (w * marginal / total).tolist() if total else [0.0] * len(w))), "diversification": float(w @ np.sqrt(np.diag(cov)) / total) if total else 1.0}
