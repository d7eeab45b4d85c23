"""Change points of short series, in numpy: penalised exact search, binary segmentation and a sliding window.

Written from the public descriptions of these methods. A result lists segment ends; the last is the length. Break points
lie at multiples of ``jump`` and segments have at least ``min_size`` values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def segment_cost(y: np.ndarray, model: str) -> Callable[[int, int], float]:
    """The cost of a segment [a, b): l2 (variance), l1 (distance to the median), normal (log variance), linear (residual of
    a line), rbf (spread in a Gaussian kernel's space; its width is 1 over the median squared distance)."""
    y = np.asarray(y, float)
    if model == "l2":
        s, q = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y * y)])
        return lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    if model == "l1":
        return lambda a, b: float(np.abs(y[a:b] - np.median(y[a:b])).sum())
    if model == "normal":
        return lambda a, b: (b - a) * float(np.log(max(y[a:b].var(), 1e-12)))
    if model == "linear":

        def line(a: int, b: int) -> float:
            x = np.arange(a, b, dtype=float)
            x -= x.mean()
            d = y[a:b] - y[a:b].mean()
            return float(d @ d - (x @ d) ** 2 / max(x @ x, 1e-300))

        return line
    if model == "rbf":
        d = (y[:, None] - y[None]) ** 2
        between = d[np.triu_indices(len(y), 1)]
        mid = np.median(between) if len(between) else 0.0
        k = np.exp(-np.clip(d / mid if mid > 0 else d, 1e-2, 1e2))
        np.fill_diagonal(k, 1.0)
        total = np.zeros((len(y) + 1, len(y) + 1))
        total[1:, 1:] = k.cumsum(0).cumsum(1)
        return lambda a, b: (b - a) - (total[b, b] - total[a, b] - total[b, a] + total[a, a]) / (b - a)
    raise ValueError(f"model is {model}; known are l1, l2, normal, linear and rbf")


def pelt(y: np.ndarray, model: str = "l2", penalty: float = 10.0, min_size: int = 2, jump: int = 5) -> list[int]:
    """The segments with the least sum of costs and a penalty for each; candidates that can't win any more are dropped."""
    n = len(y)
    if n < 2 * min_size:
        return [n]
    cost = segment_cost(y, model)
    ends = [k for k in range(jump, n, jump) if k >= min_size] + [n]
    best, back, alive = {0: -penalty}, {0: None}, [0]
    for e in ends:
        found = [(best[a] + cost(a, e) + penalty, a) for a in alive if e - a >= min_size]
        if not found:
            continue
        best[e], back[e] = min(found)
        low = dict((a, c) for c, a in found)
        alive = [a for a in alive if a not in low or low[a] <= best[e] + penalty] + [e]
    out, at = [], n
    while at:
        out.append(at)
        at = back[at]
    return out[::-1]


def binary_segmentation(y: np.ndarray, model: str = "l2", penalty: float = 10.0, min_size: int = 2, jump: int = 5, breaks: int | None = None) -> list[int]:
    """Splits where the cost falls most: ``breaks`` times if given, else as long as it falls by more than the penalty. Among
    equal falls the last place wins."""
    n, cost = len(y), segment_cost(y, model)
    ends = [n]
    while breaks is None or len(ends) <= breaks:
        best = (penalty if breaks is None else -np.inf, -1)
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            whole = cost(a, b) if b > a else 0.0
            for k in range(-(-(a + min_size) // jump) * jump, b - min_size + 1, jump):
                best = max(best, (whole - cost(a, k) - cost(k, b), k))
        if best[1] < 0:
            return ends
        ends = sorted([*ends, best[1]])
    return ends


def sliding_window(y: np.ndarray, model: str = "l2", penalty: float = 10.0, width: int = 10, min_size: int = 2, jump: int = 5, breaks: int | None = None) -> list[int]:
    """Peaks of the gain from splitting a window in its middle, the highest first: ``breaks`` of them if given, else as long as
    the whole cost falls by more than the penalty. A peak lies above its neighbours, the first place following the last."""
    n, cost, half = len(y), segment_cost(y, model), width // 2
    at = [k for k in range(0, n, jump) if half <= k < n - half]
    gain = [cost(k - half, k + half) - cost(k - half, k) - cost(k, k + half) for k in at]
    near = max(max(2 * half, 2 * min_size) // (2 * jump), 1)
    peaks = [i for i in range(len(at)) if all(gain[i] > gain[(i + d) % len(at)] for j in range(1, near + 1) for d in (-j, j))]
    ends = [n]
    whole = lambda e: sum(cost(a, b) for a, b in zip([0, *e[:-1]], e, strict=True))
    for i in sorted(peaks, key=lambda i: (gain[i], at[i]), reverse=True):
        more = sorted({*ends, at[i]})
        if len(more) - 1 > breaks if breaks is not None else whole(ends) - whole(more) <= penalty:
            break
        ends = more
    return ends


METHODS = {"pelt": pelt, "binseg": binary_segmentation, "window": sliding_window}


def savgol(y: np.ndarray, window: int = 15, poly: int = 2) -> np.ndarray:
    """Each value of the polynomial fitted to the window around it; the ends use the first and the last window's fit."""
    n, half = len(y), window // 2
    x = np.arange(window) - half
    fit = np.vander(x, poly + 1, increasing=True)
    projector = fit @ np.linalg.pinv(fit)
    out = np.empty(n)
    out[half : n - half] = np.convolve(y, projector[half][::-1], "valid")
    out[:half] = (projector @ y[:window])[:half]
    out[n - half :] = (projector @ y[-window:])[half + 1 :]
    return out


def median_filter(y: np.ndarray, size: int = 3) -> np.ndarray:
    """Running medians; the ends are padded with zeros."""
    padded = np.pad(np.asarray(y, float), size // 2)
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, size), axis=1)


def knee(x: np.ndarray, y: np.ndarray, window: int = 15, poly: int = 2, running: bool = False) -> float:
    """Where the smoothed curve bends most: the place x of the largest second difference over the values' numbers. The window
    shrinks to len // 2 * 2 + 1 (three at least); a curve of fewer values is not smoothed. ``running``: a running median first."""
    window = max(3, min(window, len(y) // 2 * 2 + 1))
    if running:
        y = median_filter(y, window)
    if len(y) >= window:
        y = savgol(y, window, min(poly, window - 1))
    return float(x[int(np.argmax(np.gradient(np.gradient(y))))])


def t_two_sided(r: float, n: int) -> float:
    """The two-sided p-value of a correlation r of n points: the regularised incomplete beta function of n - 2 degrees."""
    from math import exp, lgamma, log

    if n < 3 or r is None or np.isnan(r):
        return float("nan")
    df = n - 2
    x = max(0.0, min(1.0, 1.0 - r * r))  # df / (df + t^2)
    a, b = df / 2, 0.5
    if x in (0.0, 1.0):
        return x

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1.0 + num * d or tiny)
                c = 1.0 + num / c or tiny
                h *= c * d
            if abs(c * d - 1.0) < 1e-14:
                break
        return h

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * fraction(b, a, 1 - x) / b
