"""Numeric kernels on small vectors, for Arrow UDFs: one event, one burst or one word at a time."""

from __future__ import annotations

import math

import numpy as np


def periodogram(y: np.ndarray) -> np.ndarray:
    """One-sided power of each row about its mean, in density scaling at one sample a day; columns are k = 0..T//2."""
    t = y.shape[-1]
    f = np.fft.rfft(y - y.mean(-1, keepdims=True), axis=-1)
    p = (f.real**2 + f.imag**2) * 2 / t
    p[..., 0] /= 2
    if t % 2 == 0:
        p[..., -1] /= 2
    return p


def dominant(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(power, period) of each row's strongest frequency, the lowest of equals; period 0 for a flat row."""
    p = np.round(periodogram(y), 10)
    k = p.argmax(-1)
    best = p.max(-1)
    return best, np.where((k > 0) & (best > 0), y.shape[-1] // np.maximum(k, 1), 0)


def moving_average(y: np.ndarray, window: int) -> np.ndarray:
    return np.convolve(y, np.ones(window) / window, "valid")


def cutoff(y: np.ndarray, window: int = 7) -> float:
    ma = moving_average(y, window)
    return float((ma.mean() + ma.std()) * (1 + 1e-12))  # rounding must not lift a flat row above its own mean


def normal_pdf(x: np.ndarray, loc: float, scale: float) -> np.ndarray:
    if scale <= 0:
        return np.zeros(len(x))
    return np.exp(-0.5 * ((x - loc) / scale) ** 2) / (scale * math.sqrt(2 * math.pi))


def cauchy_pdf(x: np.ndarray, loc: float, hwhm: float) -> np.ndarray:
    return 1 / (math.pi * hwhm * (1 + ((x - loc) / hwhm) ** 2))


def fit_normal(x: np.ndarray, y: np.ndarray, start: tuple[float, float], high: float) -> tuple[float, float]:
    """Least squares of a normal density through (x, y), both parameters within [0, high]: damped Gauss-Newton steps, cut
    back to the box, that are taken only where they improve."""
    low = 1e-6
    loc, scale = (min(max(v, low), high) for v in start)
    damp = 1e-3
    error = float(((normal_pdf(x, loc, scale) - y) ** 2).sum())
    for _ in range(500):
        p = normal_pdf(x, loc, scale)
        z = (x - loc) / scale
        j = np.stack([p * z / scale, p * (z * z - 1) / scale], 1)
        g, h = j.T @ (y - p), j.T @ j
        step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), g, rcond=None)[0]
        new = (min(max(loc + step[0], 0.0), high), min(max(scale + step[1], low), high))
        e = float(((normal_pdf(x, *new) - y) ** 2).sum())
        if e < error:
            moved = abs(new[0] - loc) + abs(new[1] - scale)
            loc, scale, error, damp = *new, e, max(damp / 3, 1e-9)
            if moved < 1e-10:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return loc, scale


def aperiodic_fit(y: np.ndarray, window: int = 7) -> tuple[float, float] | None:
    """(mean, deviation) of a trajectory's days above its cutoff, scaled to sum 1; None where none is."""
    days = np.flatnonzero(y > cutoff(y, window))
    if not len(days):
        return None
    peaks = y[days] / y[days].sum()
    return fit_normal(days.astype(float), peaks, (float(days[len(days) // 2]), len(days) / 4), float(len(y)))


def mixture(points: np.ndarray, k: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, variances) of a mixture of k axis-aligned normals by expectation-maximisation, started from k runs
    of points in order of their first column, refined by k-means, so that it never depends on chance."""
    points = points[np.argsort(points[:, 0], kind="stable")]
    label = np.minimum(np.arange(len(points)) * k // len(points), k - 1)
    for _ in range(50):
        centre = np.stack([points[label == i].mean(0) if (label == i).any() else points[i] for i in range(k)])
        new = ((points[:, None] - centre) ** 2).sum(2).argmin(1)
        if (new == label).all():
            break
        label = new
    r = np.eye(k)[label]
    floor, last = 1e-6, -np.inf
    for _ in range(rounds):
        n = r.sum(0) + 1e-10
        w, m = n / n.sum(), r.T @ points / n[:, None]
        v = np.maximum(r.T @ points**2 / n[:, None] - m**2, 0) + floor
        log = np.log(w) - 0.5 * (np.log(2 * np.pi * v).sum(1) + ((points[:, None] - m) ** 2 / v).sum(2))
        top = log.max(1, keepdims=True)
        each = top[:, 0] + np.log(np.exp(log - top).sum(1))
        r = np.exp(log - each[:, None])
        if abs(each.mean() - last) < 1e-6:
            break
        last = each.mean()
    return w, m, v


def periodic_fit(y: np.ndarray, period: int, window: int = 7) -> list[tuple[float, float, float]]:
    """(weight, mean day, deviation in days) of each bump above the cutoff, in order of the day."""
    days = np.flatnonzero(y > cutoff(y, window))
    k = min(len(y) // max(period, 1), len(days))
    if k < 1:
        return []
    w, m, v = mixture(np.stack([days.astype(float), y[days]], 1), k)
    return sorted(zip(w.tolist(), m[:, 0].tolist(), np.sqrt(v[:, 0]).tolist(), strict=True), key=lambda x: x[1])


HALF_WIDTH = math.sqrt(2 * math.log(2))


def smooth_aperiodic(y: np.ndarray, window: int = 7) -> np.ndarray:
    """The fitted normal curve, zero outside one deviation of its mean."""
    fit = aperiodic_fit(y, window)
    t = len(y)
    if fit is None:
        return np.zeros(t)
    loc, scale = fit
    curve = normal_pdf(np.arange(t, dtype=float), loc, scale)
    curve[: math.ceil(max(0.0, loc - scale))] = 0
    curve[math.floor(min(t, loc + scale)) :] = 0
    return curve


def smooth_periodic(y: np.ndarray, period: int, window: int = 7) -> np.ndarray:
    x = np.arange(len(y), dtype=float)
    return sum((w * normal_pdf(x, m, max(s, 1e-3)) for w, m, s in periodic_fit(y, period, window)), np.zeros(len(y)))


def kl_bits(p: np.ndarray, q: np.ndarray) -> float:
    sp, sq = p.sum(), q.sum()
    if sp <= 0 or sq <= 0:
        return math.nan
    p, q = p / sp, q / sq
    on = p > 0
    if (q[on] == 0).any():
        return math.inf
    return float((p[on] * np.log2(p[on] / q[on])).sum())


def max_kl(curves: np.ndarray) -> np.ndarray:
    """The larger of both KL divergences of each pair of rows."""
    sums = curves.sum(1, keepdims=True)
    p = np.where(sums > 0, curves / np.where(sums > 0, sums, 1.0), np.nan)
    out = np.zeros((len(p), len(p)))
    for i in range(len(p)):  # one row at a time: the cube of all pairs and days would not fit
        on = p[i] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            out[i] = (p[i, on] * np.log2(p[i, on] / p[:, on])).sum(1)
    flat = ~(sums[:, 0] > 0)
    out[flat], out[:, flat] = np.nan, np.nan
    np.fill_diagonal(out, 0.0)
    return np.maximum(out, out.T)  # a NaN on either side stays


class KlRows:
    """rows[i]: the row i of max_kl(curves), but for rounding, worked out when it is asked for; no table of all pairs."""

    def __init__(self, curves: np.ndarray) -> None:
        sums = curves.sum(1, keepdims=True)
        self.flat = ~(sums[:, 0] > 0)
        self.p = curves / np.where(self.flat[:, None], 1.0, sums)
        self.on = self.p > 0
        self.log = np.log2(np.where(self.on, self.p, 1.0))

    def __len__(self) -> int:
        return len(self.p)

    def __getitem__(self, i: int) -> np.ndarray:
        on = self.on[i]
        p, apart = self.p[:, on], self.log[:, on] - self.log[i, on]
        there = np.where(self.on[:, on].all(1), -np.einsum("ij,j->i", apart, p[i]), np.inf)
        back = np.where(self.on[:, ~on].any(1), np.inf, np.einsum("ij,ij->i", apart, p))
        out = np.where(self.flat | self.flat[i], np.nan, np.maximum(there, back))
        out[i] = 0.0
        return out


def savgol(y: np.ndarray, window: int = 15, order: int = 3) -> np.ndarray:
    """Savitzky-Golay smoothing; the ends take the polynomial of the first and last full window."""
    half = window // 2
    x = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True))
    out = np.convolve(y, fit[0][::-1], "same")
    edge = np.vander(x, order + 1, increasing=True)
    out[:half] = (edge @ (fit @ y[:window]))[:half]
    out[-half:] = (edge @ (fit @ y[-window:]))[-half:]
    return out


def window_smooth(y: np.ndarray, window: int = 7, shape: str = "hann") -> np.ndarray:
    x = np.arange(window)
    w = {"hann": np.hanning, "hamming": np.hamming, "bartlett": np.bartlett, "blackman": np.blackman, "gaussian": lambda n: np.exp(-0.5 * ((x - (n - 1) / 2) / (n / 6)) ** 2)}[shape](window)
    return np.convolve(y, w / w.sum(), "same")


def legacy_period(y: np.ndarray) -> tuple[float, float]:
    """The older rule: the largest of the first half of the transform without its mean (complex numbers compare by their
    real part) and len / (index + 1)."""
    n = len(y) // 2
    f = np.fft.fft(y)[1 : n + 1]
    k = int(np.lexsort((f.imag, f.real))[-1])
    return float(abs(f[k])), len(y) / (k + 1)


def log_binomial(n: int, k: np.ndarray, p: float) -> np.ndarray:
    """Log probability of k of n at p, by running sums of logarithms."""
    top = int(k.max(initial=0))
    i = np.arange(top)
    choose = np.r_[0.0, np.cumsum(np.log(n - i) - np.log(i + 1))]
    with np.errstate(divide="ignore", invalid="ignore"):
        return choose[k] + np.where(k > 0, k * np.log(p), 0.0) + np.where(k < n, (n - k) * np.log1p(-p), 0.0)


def binomial_quantile(n: int, p: float, q: float) -> int:
    """The least k whose cumulated probability reaches q."""
    if p <= 0:
        return 0
    if p >= 1:
        return n
    c = np.cumsum(np.exp(log_binomial(n, np.arange(n + 1), p)))
    return int(min(np.searchsorted(c, q * (1 - 1e-12)), n))


def transport(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> float:
    """Least cost of moving masses a to b (equal sums), by successive shortest paths; for the few words of a headline."""
    a, b = a.astype(float).copy(), b.astype(float).copy()
    n, m = cost.shape
    flow = np.zeros((n, m))
    total = 0.0
    while a.max(initial=0) > 1e-12:
        dist = np.r_[np.where(a > 1e-12, 0.0, np.inf), np.full(m, np.inf)]
        back = np.full(n + m, -1)
        for _ in range(n + m):
            via = dist[:n, None] + cost
            j = via.argmin(0)
            better = via[j, np.arange(m)] < dist[n:] - 1e-12
            dist[n:][better] = via[j, np.arange(m)][better]
            back[n:][better] = j[better]
            rev = np.where(flow > 1e-12, dist[None, n:] - cost, np.inf)
            i = rev.argmin(1)
            closer = rev[np.arange(n), i] < dist[:n] - 1e-12
            dist[:n][closer] = rev[np.arange(n), i][closer]
            back[:n][closer] = n + i[closer]
            if not better.any() and not closer.any():
                break
        open_ = np.where(b > 1e-12, dist[n:], np.inf)
        end = int(open_.argmin())
        if not np.isfinite(open_[end]):
            break
        path, at = [], n + end
        while back[at] >= 0:
            path.append((int(back[at]), at))
            at = int(back[at])
        amount = min(a[at], b[end], *(flow[v, u - n] for u, v in path if u >= n))
        for u, v in path:
            if u < n:
                flow[u, v - n] += amount
                total += amount * cost[u, v - n]
            else:
                flow[v, u - n] -= amount
                total -= amount * cost[v, u - n]
        a[at] -= amount
        b[end] -= amount
    return total


def word_movers(x: np.ndarray, y: np.ndarray) -> float:
    """Distance of two bags of word vectors with equal weights."""
    if not len(x) or not len(y):
        return math.inf
    cost = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    return transport(np.full(len(x), 1 / len(x)), np.full(len(y), 1 / len(y)), cost)


def relaxed_movers(x: np.ndarray, y: np.ndarray) -> float:
    """A lower bound of word_movers: each word goes to its nearest, in the dearer direction."""
    if not len(x) or not len(y):
        return math.inf
    cost = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    return float(max(cost.min(1).mean(), cost.min(0).mean()))


def movers_bounds(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Lower bounds of relaxed_movers(x, group) for groups of rows of y that begin at `first`; below it by rounding alone."""
    a, b = (x * x).sum(1)[:, None], (y * y).sum(1)[None]
    cost = np.sqrt(np.maximum(a + b - 2 * (x @ y.T) - 1e-12 * (a + b), 0.0))
    size = np.diff(np.r_[first, len(y)])
    out = np.minimum.reduceat(cost, first, axis=1).mean(0)
    return np.maximum(out, np.add.reduceat(cost.min(0), first) / size)


def many_movers(cost: np.ndarray) -> np.ndarray:
    """word_movers of many pairs of bags at once, exactly: cost has a pair in each row, x its words, y its words. A word of the
    longer side is m units and one of the shorter side takes n; all units begin at their nearest, and what is too much moves on
    along the cheapest path over the shorter side's words, which keeps the plan the cheapest for its loads."""
    if cost.shape[1] < cost.shape[2]:
        cost = cost.transpose(0, 2, 1)
    cost = np.ascontiguousarray(cost)
    pairs, n, m = cost.shape
    out = np.zeros(pairs)
    flow = (cost.argmin(2)[:, :, None] == np.arange(m)) * m
    at, own = np.arange(pairs), cost
    while True:
        load = flow.sum(1)
        busy = (load > n).any(1)
        if not busy.all():
            out[at[~busy]] = (flow[~busy] * own[~busy]).sum((1, 2)) / (n * m)
            at, own, flow, load = at[busy], own[busy], flow[busy], load[busy]
        if not len(at):
            return out
        e = np.arange(len(at))
        step = np.where(flow[:, :, :, None] > 0, own[:, :, None, :] - own[:, :, :, None], np.inf)
        by = step.argmin(1)
        d = np.take_along_axis(step, by[:, None], 1)[:, 0]
        d[:, np.arange(m), np.arange(m)] = 0.0
        via = np.broadcast_to(np.arange(m), d.shape).copy()
        for k in range(m):
            new = d[:, :, k, None] + d[:, None, k, :]
            less = new < d - 1e-12
            d, via = np.where(less, new, d), np.where(less, via[:, :, k, None], via)
        open_ = np.where((load > n)[:, :, None] & (load < n)[:, None, :], d, np.inf).reshape(len(at), -1)
        best = open_.argmin(1)
        start, end = best // m, best % m
        amount = np.minimum(load[e, start] - n, n - load[e, end])
        path, now = [], start
        for _ in range(m):
            on = now != end
            nxt = np.where(on, via[e, now, end], now)
            word = by[e, now, nxt]
            amount = np.where(on, np.minimum(amount, flow[e, word, now]), amount)
            path.append((on, now, nxt, word))
            now = nxt
        for on, a, b, word in path:
            np.subtract.at(flow, (e[on], word[on], a[on]), amount[on])
            np.add.at(flow, (e[on], word[on], b[on]), amount[on])


def longest_run(active: np.ndarray, closed: bool = True) -> list[tuple[int, int]]:
    """(first, last) of each run of true values; closed: only runs between two false ones."""
    edge = np.flatnonzero(np.diff(np.r_[0, active.astype(int), 0]))
    runs = list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))
    return [(a, b) for a, b in runs if not closed or (a > 0 and b < len(active) - 1)]
