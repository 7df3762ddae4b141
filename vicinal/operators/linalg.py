"""Small dense and sparse kernels on pattern spaces: exponential actions, Gamma times, pruning, optimisation.

They work on arrays of K^L states, a size that a model's window fixes and the data do not.
"""

from __future__ import annotations

import math

import numpy as np


class Sparse:
    """A generator without diagonal in coordinates, acting on blocks of columns."""

    def __init__(self, i, j, x, n: int):
        order = np.argsort(np.asarray(i), kind="stable")
        self.i, self.j, self.x, self.n = np.asarray(i)[order], np.asarray(j)[order], np.asarray(x, float)[order], n
        self.starts = np.flatnonzero(np.r_[True, self.i[1:] != self.i[:-1]]) if len(self.i) else np.zeros(0, int)
        self.out = np.bincount(self.i, self.x, n) if len(self.i) else np.zeros(n)

    def dot(self, v: np.ndarray) -> np.ndarray:
        """(G - diag(row sums)) v"""
        y = -self.out[:, None] * v
        if len(self.i):
            y[self.i[self.starts]] += np.add.reduceat(self.x[:, None] * v[self.j], self.starts, axis=0)
        return y

    def transposed(self) -> "Sparse":
        t = Sparse(self.j, self.i, self.x, self.n)
        t.out = self.out
        return t


def exp_action(g: Sparse, v: np.ndarray, t: float = 1.0, tol: float = 1e-17) -> np.ndarray:
    """exp(t (G - diag)) v by uniformization; long times are split. What the series leaves out weighs twice tol at most."""
    top = float(g.out.max(initial=0.0)) * t
    if top == 0:
        return v.copy()
    steps = max(1, math.ceil(top / 50))
    rate, lam = g.out.max(), top / steps
    for _ in range(steps):
        term, weight, total, acc, k = v, math.exp(-lam), math.exp(-lam), math.exp(-lam) * v, 0
        while k < 2 * lam or weight > tol:
            k += 1
            term = term + g.dot(term) / rate
            weight *= lam / k
            total += weight
            acc = acc + weight * term
        v = acc / total
    return v


def gamma_action(g: Sparse, v: np.ndarray, shape: float, scale: float = 1.0) -> np.ndarray:
    """E exp(T (G - diag)) v for a Gamma-distributed time T: uniformization with negative-binomial weights, taken in logarithms. A series without end is an error."""
    from .series import negative_binomial

    rate = float(g.out.max(initial=0.0))
    term, acc = v, 0.0
    for k, weight in enumerate(negative_binomial(shape, rate * scale)):
        term = term + g.dot(term) / rate if k else v
        acc = acc + weight * term
    return acc


def extended_action(g: Sparse, moved: np.ndarray, mean: float, longer: float, tol: float = 1e-12) -> np.ndarray:
    """What an exponential time of mean `longer` does, from what one of mean `mean` has done: moved = gamma_action(g, v, 1, mean).

    With R = (1 - mean Q) ** -1, the longer time is the series (mean / longer) * sum of (1 - mean / longer) ** k * R ** k on moved. The terms that are left out
    have a weight of tol at most, and so change no entry by more than tol times the greatest of moved.
    """
    if not 0 < mean <= longer:
        raise ValueError("a time can only be extended to a longer one")
    rest = 1 - mean / longer
    term, acc, weight, left = moved, (1 - rest) * moved, 1 - rest, rest
    while left > tol:
        term, weight, left = gamma_action(g, term, 1.0, mean), weight * rest, left * rest
        acc = acc + weight * term
    return acc / (1 - left)


def projection(longs: list[str], shorts: list[str], left: int) -> np.ndarray:
    """0/1 matrix from long patterns to the short ones inside."""
    at = {s: k for k, s in enumerate(shorts)}
    w = len(shorts[0])
    u = np.zeros((len(longs), len(shorts)))
    u[np.arange(len(longs)), [at[p[left : left + w]] for p in longs]] = 1
    return u


def root_distribution(patterns: list[str], freqs: dict[str, float]) -> np.ndarray:
    return np.array([math.prod(freqs[c] for c in p) for p in patterns])


def up_down(g_up: Sparse, g_down: Sparse, u: np.ndarray, pi: np.ndarray, t_up: float, t_down: float) -> np.ndarray:
    """P(short pattern at the one tip, given the long one at the other)."""
    joint = exp_action(g_down.transposed(), pi[:, None] * exp_action(g_up, u, t_up), t_down)
    at = exp_action(g_down.transposed(), pi[:, None], t_down)
    return joint / at


def minimise(f, x0: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 100, tol: float = 1e-9) -> tuple[np.ndarray, float, bool]:
    """Box-constrained quasi-Newton (projected BFGS, central differences, backtracking)."""
    x, n = np.clip(np.asarray(x0, float), low, high), len(x0)
    grad = lambda x: np.array([(f(np.clip(x + h, low, high)) - f(np.clip(x - h, low, high))) / max(1e-300, (np.clip(x + h, low, high) - np.clip(x - h, low, high)).sum()) for h in np.eye(n) * 1e-6 * np.maximum(1, np.abs(x))])
    fx, g, b = f(x), grad(x), np.eye(n)
    for _ in range(rounds):
        free = ~((x <= low) & (g > 0) | (x >= high) & (g < 0))
        if not free.any() or np.abs(g[free]).max() < tol * max(1, abs(fx)):
            return x, fx, True
        step = np.zeros(n)
        step[free] = -np.linalg.solve(b[np.ix_(free, free)], g[free])
        if step @ g >= 0:
            b, step = np.eye(n), np.where(free, -g, 0)
        a, good = 1.0, False
        for _ in range(40):
            y = np.clip(x + a * step, low, high)
            fy = f(y)
            if np.isfinite(fy) and fy <= fx + 1e-4 * g @ (y - x):
                good = True
                break
            a /= 2
        if not good:
            if np.allclose(b, np.eye(n)):
                return x, fx, True
            b = np.eye(n)
            continue
        h = grad(y)
        s, d = y - x, h - g
        if s @ d > 1e-12:
            bs = b @ s
            b = b + np.outer(d, d) / (s @ d) - np.outer(bs, bs) / (s @ bs)
        done = abs(fx - fy) < tol * max(1, abs(fx))
        x, fx, g = y, fy, h
        if done:
            return x, fx, True
    return x, fx, False


def gradient(f, x: np.ndarray, step: float = 1e-5) -> np.ndarray:
    return np.array([(f(x + h) - f(x - h)) / (2 * step) for h in np.eye(len(x)) * step])


def hessian(f, x: np.ndarray, step: float = 1e-4) -> np.ndarray:
    e = np.eye(len(x)) * step
    return np.array([[(f(x + a + b) - f(x + a - b) - f(x - a + b) + f(x - a - b)) / (4 * step**2) for b in e] for a in e])


def correlations(h: np.ndarray) -> np.ndarray:
    """Of the estimates, from the pseudo-inverse of the Hessian."""
    c = np.linalg.pinv(h)
    s = np.sqrt(np.clip(np.diag(c), 1e-300, None))
    return c / np.outer(s, s)


def complete_linkage(d: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers, from 0 in order of first members, of complete linkage cut into k clusters."""
    groups = [[i] for i in range(len(d))]
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive = list(range(len(d)))
    while len(alive) > max(1, k):
        sub = d[np.ix_(alive, alive)]
        a, b = divmod(int(sub.argmin()), len(alive))
        i, j = sorted((alive[a], alive[b]))
        groups[i] += groups[j]
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        alive.remove(j)
    out = np.zeros(len(d), int)
    for n, i in enumerate(sorted(alive, key=lambda i: min(groups[i]))):
        out[groups[i]] = n
    return out
