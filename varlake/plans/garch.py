"""Conditional variance kernels: many parameter vectors at once over one return series, for use inside grouped tasks.

A batch of vectors shares one pass over time, so that a numerical gradient, a line search and a Hessian each cost one pass.
"""

from __future__ import annotations

from math import lgamma, pi

import numpy as np

SPECS = ("GARCH", "GJR-GARCH", "EGARCH", "APARCH", "FIGARCH")
DISTS = ("normal", "t", "ged")
SCALE = 100.0  # returns are fitted in percent
TRUNCATION, BACKCAST, DECAY = 1000, 75, 0.94  # fixed values of the long-memory sum and of the start value
NAMES = {
    "GARCH": ("omega", "alpha[1]", "beta[1]"), "GJR-GARCH": ("omega", "alpha[1]", "gamma[1]", "beta[1]"), "EGARCH": ("omega", "alpha[1]", "gamma[1]", "beta[1]"),
    "APARCH": ("omega", "alpha[1]", "gamma[1]", "beta[1]", "delta"), "FIGARCH": ("omega", "phi", "d", "beta"),
}


ORDERED = ("EGARCH", "APARCH")  # the specifications whose asymmetric term may be left out


def names(spec: str, dist: str) -> tuple[str, ...]:
    return ("mu", *NAMES[spec], *(() if dist == "normal" else ("nu",)))


def estimated(spec: str, dist: str, order: int | None = None) -> np.ndarray:
    """The places of the parameters that are estimated: all, or all but the asymmetric one at order 0, where it stays 0. None is the specification's own order."""
    if spec not in SPECS or dist not in DISTS:
        raise ValueError(f"unknown model {spec}-{dist}")
    if order is not None and (spec not in ORDERED or order not in (0, 1)):
        raise ValueError(f"{spec} can't be of asymmetric order {order}")
    return np.array([i for i, name in enumerate(names(spec, dist)) if order != 0 or name != "gamma[1]"])


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def constrained(spec: str, dist: str, u: np.ndarray) -> np.ndarray:
    """Parameters that satisfy the specification's constraints, from free ones; rows are vectors."""
    out = u.copy()
    o, rest = u[:, 1], u[:, 2:]
    out[:, 1] = o if spec == "EGARCH" else np.exp(np.clip(o, -30, 30))
    if spec == "GARCH":
        p, s = _sig(rest[:, 0]), _sig(rest[:, 1])
        out[:, 2], out[:, 3] = p * s, p * (1 - s)
    elif spec == "GJR-GARCH":
        p, w = _sig(rest[:, 0]), np.exp(np.clip(np.stack([rest[:, 1], rest[:, 2], 0 * rest[:, 0]], 1), -30, 30))
        w /= w.sum(axis=1, keepdims=True)
        out[:, 2], out[:, 3], out[:, 4] = 2 * p * w[:, 0], 2 * p * (w[:, 1] - w[:, 0]), p * w[:, 2]
    elif spec == "EGARCH":
        out[:, 4] = np.tanh(rest[:, 2])
    elif spec == "APARCH":
        out[:, 2], out[:, 3], out[:, 4], out[:, 5] = _sig(rest[:, 0]), np.tanh(rest[:, 1]), _sig(rest[:, 2]), 0.3 + 3.7 * _sig(rest[:, 3])
    else:
        d = _sig(rest[:, 1])
        phi = _sig(rest[:, 0]) * (1 - d) / 2
        out[:, 2], out[:, 3], out[:, 4] = phi, d, _sig(rest[:, 2]) * (phi + d)
    if dist != "normal":
        out[:, -1] = (2.05 if dist == "t" else 1.01) + np.exp(np.clip(u[:, -1], -20, 5))
    return out


def start_point(spec: str, dist: str, r: np.ndarray) -> np.ndarray:
    v = r.var()
    free = {
        "GARCH": (np.log(v * 0.05), 3.0, -2.2), "GJR-GARCH": (np.log(v * 0.05), 3.0, -3.0, -2.2), "EGARCH": (0.05 * np.log(v), 0.15, -0.03, 1.8),
        "APARCH": (np.log(v * 0.05), -2.5, 0.1, 2.2, -0.2), "FIGARCH": (np.log(v * 0.1), -0.5, -0.4, 0.0),
    }[spec]
    return np.array([r.mean(), *free, *(() if dist == "normal" else (np.log(6.0),) if dist == "t" else (-0.5,))])


def backcast(e: np.ndarray) -> np.ndarray:
    n = min(BACKCAST, e.shape[1])
    w = DECAY ** np.arange(n)
    return (e[:, :n] ** 2) @ (w / w.sum())


def long_memory(phi: np.ndarray, d: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The weights of the past squares for each vector, without a loop over them: powers of beta, convolved with what enters at each lag."""
    k = np.arange(1, TRUNCATION)
    delta = d[:, None] * np.concatenate([np.ones((len(d), 1)), np.cumprod((k - d[:, None]) / (k + 1), axis=1)], axis=1)
    enters = delta - np.concatenate([beta[:, None] - phi[:, None], phi[:, None] * delta[:, :-1]], axis=1)
    powers = np.cumprod(np.concatenate([np.ones((len(d), 1)), np.repeat(beta[:, None], TRUNCATION - 1, axis=1)], axis=1), axis=1)
    size = 2 * TRUNCATION
    return np.fft.irfft(np.fft.rfft(enters, size) * np.fft.rfft(powers, size), size)[:, :TRUNCATION]


def state_of(spec: str, p: np.ndarray, h: float) -> float:
    """What the recursion carries for a variance (of returns in percent): EGARCH its logarithm, APARCH the power delta of the deviation, the others itself."""
    return float(np.log(h) if spec == "EGARCH" else h ** (p[5] / 2) if spec == "APARCH" else h)


def variance_of(spec: str, p: np.ndarray, state: float) -> float:
    return float(np.exp(state) if spec == "EGARCH" else max(state, 1e-12) ** (2 / p[5]) if spec == "APARCH" else state)


def advance(spec: str, p: np.ndarray, state: float, r: float) -> float:
    """The state after a return in percent. FIGARCH has none of one number, as its variance needs the whole past."""
    e = r - p[0]
    if spec == "GARCH":
        return float(p[1] + p[2] * e * e + p[3] * state)
    if spec == "GJR-GARCH":
        return float(p[1] + (p[2] + p[3] * (e < 0)) * e * e + p[4] * state)
    if spec == "EGARCH":
        z = e * np.exp(-0.5 * state)
        return float(np.clip(p[1] + p[2] * (abs(z) - np.sqrt(2 / pi)) + p[3] * z + p[4] * state, -30, 30))
    if spec == "APARCH":
        return float(min(p[1] + p[2] * max(abs(e) - p[3] * e, 1e-12) ** p[5] + p[4] * state, 1e12))
    raise ValueError(f"{spec} can't be advanced by one return")


def remembered(p: np.ndarray, past: np.ndarray, weights: np.ndarray) -> float:
    """FIGARCH's variance after the squares `past`, oldest first, with the weights of long_memory()."""
    return float(np.clip(p[1] / (1 - p[4]) + past[::-1] @ weights[: len(past)], 1e-12, 1e12))


def variances(spec: str, p: np.ndarray, r: np.ndarray, fitted: int) -> np.ndarray:
    """Variances of r's rows and of the row after, for each vector of p; the start value comes from the first `fitted` rows."""
    e = r[None, :] - p[:, :1]
    n, b0 = e.shape[1], backcast(e[:, :fitted])
    out = np.empty((n + 1, len(p)))
    omega = p[:, 1]
    if spec == "FIGARCH":
        phi, d, beta = p[:, 2], p[:, 3], p[:, 4]
        lam = long_memory(phi, d, beta)
        ext = np.concatenate([np.repeat(b0[:, None], TRUNCATION, axis=1), e**2], axis=1)
        size = 1 << (ext.shape[1] + TRUNCATION).bit_length()
        conv = np.fft.irfft(np.fft.rfft(ext, size) * np.fft.rfft(lam, size), size)[:, TRUNCATION - 1 : TRUNCATION + n]
        return np.clip(omega[:, None] / (1 - beta[:, None]) + conv, 1e-12, 1e12)
    ea = np.ascontiguousarray(e.T)
    alpha, beta = p[:, 2], p[:, -1] if spec == "GARCH" and p.shape[1] == 4 else p[:, 3 if spec == "GARCH" else 4]
    if spec in ("GARCH", "GJR-GARCH"):
        shock = alpha * ea**2 if spec == "GARCH" else (alpha + p[:, 3] * (ea < 0)) * ea**2
        h = omega + (alpha + (0.5 * p[:, 3] if spec == "GJR-GARCH" else 0) + beta) * b0
        out[0] = h
        for t in range(n):
            h = omega + shock[t] + beta * h
            out[t + 1] = h
        return np.clip(out.T, 1e-12, 1e12)
    if spec == "EGARCH":
        gamma, mean_abs = p[:, 3], np.sqrt(2 / pi)
        h = omega + beta * np.log(b0)
        out[0] = h
        for t in range(n):
            z = ea[t] * np.exp(-0.5 * h)
            h = np.clip(omega + alpha * (np.abs(z) - mean_abs) + gamma * z + beta * h, -30, 30)
            out[t + 1] = h
        return np.exp(out.T)
    gamma, delta = p[:, 3], p[:, 5]
    shock = alpha * np.maximum(np.abs(ea) - gamma * ea, 1e-12) ** delta
    h = omega + (alpha + beta) * b0 ** (delta / 2)
    out[0] = h
    for t in range(n):
        h = np.minimum(omega + shock[t] + beta * h, 1e12)
        out[t + 1] = h
    return np.clip(np.maximum(out.T, 1e-12) ** (2 / delta[:, None]), 1e-12, 1e12)


def log_densities(spec: str, dist: str, p: np.ndarray, r: np.ndarray) -> np.ndarray:
    h = variances(spec, p, r, len(r))[:, :-1]
    z2 = (r[None, :] - p[:, :1]) ** 2 / h
    if dist == "normal":
        return -0.5 * (np.log(2 * pi) + np.log(h) + z2)
    nu = p[:, -1]
    if dist == "t":
        c = np.array([lgamma((v + 1) / 2) - lgamma(v / 2) for v in nu]) - 0.5 * np.log(pi * (nu - 2))
        return c[:, None] - 0.5 * np.log(h) - 0.5 * (nu[:, None] + 1) * np.log1p(z2 / (nu[:, None] - 2))
    log_lam = 0.5 * (-2 / nu * np.log(2) + np.array([lgamma(1 / v) - lgamma(3 / v) for v in nu]))
    c = np.log(nu) - log_lam - (1 + 1 / nu) * np.log(2) - np.array([lgamma(1 / v) for v in nu])
    return c[:, None] - 0.5 * np.log(h) - 0.5 * (np.sqrt(z2) / np.exp(log_lam)[:, None]) ** nu[:, None]


def fit(spec: str, dist: str, returns: np.ndarray, rounds: int = 80, order: int | None = None) -> tuple[np.ndarray, float]:
    """Parameters (of returns in percent) and log-likelihood, by BFGS on free parameters with batched differences and line search."""
    own = estimated(spec, dist, order)
    r = np.asarray(returns, float) * SCALE
    cost = lambda u: -np.nan_to_num(log_densities(spec, dist, constrained(spec, dist, u), r).mean(axis=1), nan=-1e6, posinf=-1e6, neginf=-1e6)
    u = start_point(spec, dist, r)
    k = len(u)
    moves = np.isin(np.arange(k), own)
    u = np.where(moves, u, 0.0)

    def slope(u):
        h = 1e-5 * np.maximum(1, np.abs(u))
        both = cost(np.concatenate([u + np.diag(h), u - np.diag(h)]))
        return np.where(moves, (both[:k] - both[k:]) / (2 * h), 0.0)

    inverse, g, best = np.eye(k), slope(u), cost(u[None])[0]
    steps = 2.0 ** -np.arange(-1, 16)
    for _ in range(rounds):
        way = -inverse @ g
        if way @ g >= 0:
            inverse, way = np.eye(k), -g
        tried = cost(u + steps[:, None] * way)
        i = int(tried.argmin())
        if not tried[i] < best - 1e-10:
            if np.allclose(inverse, np.eye(k)):
                break
            inverse = np.eye(k)
            continue
        s, best = steps[i] * way, float(tried[i])
        u = u + s
        new = slope(u)
        y, g = new - g, new
        if (sy := s @ y) > 1e-12:
            left = np.eye(k) - np.outer(s, y) / sy
            inverse = left @ inverse @ left.T + np.outer(s, s) / sy
        if np.abs(g).max() < 1e-6:
            break
    return constrained(spec, dist, u[None])[0], -best * len(r)


def standard_errors(spec: str, dist: str, p: np.ndarray, returns: np.ndarray, order: int | None = None) -> np.ndarray:
    """Robust (sandwich) errors of the estimated parameters from batched differences; NaN where the Hessian can't be inverted."""
    own = estimated(spec, dist, order)
    r, k = np.asarray(returns, float) * SCALE, len(own)
    size = 1e-4 * np.maximum(1e-2, np.abs(p))
    h = np.diag(size)[own]
    ends = log_densities(spec, dist, np.concatenate([p + h, p - h]), r)
    size = size[own]
    scores = (ends[:k] - ends[k:]) / (2 * size[:, None])
    corners = np.array([p + a * h[i] + b * h[j] for i in range(k) for j in range(k) for a in (1, -1) for b in (1, -1)])
    v = log_densities(spec, dist, corners, r).sum(axis=1).reshape(k, k, 4)
    hess = (v[..., 0] - v[..., 1] - v[..., 2] + v[..., 3]) / (4 * np.outer(size, size))
    try:
        bread = np.linalg.inv(hess)
    except np.linalg.LinAlgError:
        return np.full(k, np.nan)
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.diag(bread @ (scores @ scores.T) @ bread))


def one_step(spec: str, p: np.ndarray, returns: np.ndarray, fitted: int) -> np.ndarray:
    """Variances of the rows from `fitted` on and of the row after the last, each from what comes before it, on the returns' own scale."""
    return variances(spec, p[None], np.asarray(returns, float) * SCALE, fitted)[0, fitted:] / SCALE**2
