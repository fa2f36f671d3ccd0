"""Numeric kernels against closed forms and brute force."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.functions import kernels as k


def test_periodogram_is_the_transform_and_keeps_energy():
    y = np.random.default_rng(1).random((4, 30))
    z = y - y.mean(1, keepdims=True)
    t = np.arange(30)
    for f in range(16):
        s = np.abs((z * np.exp(-2j * np.pi * f * t / 30)).sum(1)) ** 2 / 30 * (1 if f in (0, 15) else 2)
        assert np.allclose(k.periodogram(y)[:, f], s)
    assert np.allclose(k.periodogram(y).sum(1), (z**2).sum(1))


def test_weekly_cycle_and_ties():
    t = np.arange(56)
    power, period = k.dominant(1 + np.cos(2 * np.pi * t / 7)[None])
    assert power[0] == pytest.approx(28) and period[0] == 7
    power, period = k.dominant((t % 7 == 0).astype(float)[None])
    assert period[0] == 7  # equal power at three frequencies: the lowest
    assert k.dominant(np.full((1, 30), 3.0)) == (0, 0)


def test_normal_fit_of_a_planted_burst():
    x = np.arange(60.0)
    loc, scale = k.aperiodic_fit(k.normal_pdf(x, 30, 4) + 0.001)
    assert loc == pytest.approx(30, abs=0.05) and scale == pytest.approx(3.0, abs=0.15)
    assert k.aperiodic_fit(np.ones(30)) is None


def test_fit_finds_no_worse_than_a_grid():
    r = np.random.default_rng(2)
    x = np.arange(5, 12.0)
    y = r.random(7)
    y /= y.sum()
    loc, scale = k.fit_normal(x, y, (8.0, 1.75), 30.0)
    best = min(((k.normal_pdf(x, a, b) - y) ** 2).sum() for a in np.arange(5, 12, 0.1) for b in np.arange(0.3, 10, 0.1))
    assert ((k.normal_pdf(x, loc, scale) - y) ** 2).sum() <= best + 1e-4


def test_mixture_of_two_bursts():
    x = np.arange(60.0)
    found = k.periodic_fit(k.normal_pdf(x, 10, 2) + k.normal_pdf(x, 45, 2), 30)
    assert [round(m) for _, m, _ in found] == [10, 45]


def test_divergences():
    p, q = np.array([1.0, 0, 0]), np.array([0, 1.0, 1.0])
    assert k.kl_bits(p, q) == math.inf and k.kl_bits(p, p) == 0 and math.isnan(k.kl_bits(p * 0, q))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 10**6))
def test_transport_against_enumeration(n, m, seed):
    r = np.random.default_rng(seed)
    x, y = r.random((n, 2)), r.random((m, 2))
    got = k.word_movers(x, y)
    assert k.relaxed_movers(x, y) <= got + 1e-9
    a, b = np.repeat(x, m, axis=0), np.repeat(y, n, axis=0)  # equal shares: an assignment problem
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    if n * m <= 6:
        best = min(sum(cost[i, p[i]] for i in range(n * m)) for p in itertools.permutations(range(n * m))) / (n * m)
        assert got == pytest.approx(best)


def test_binomial():
    p = [math.comb(20, i) * 0.3**i * 0.7 ** (20 - i) for i in range(21)]
    assert np.allclose(np.exp(k.log_binomial(20, np.arange(21), 0.3)), p)
    for q in (0.5, 0.9, 0.999):
        assert k.binomial_quantile(20, 0.3, q) == next(i for i in range(21) if sum(p[: i + 1]) >= q)
    assert k.binomial_quantile(20, 0.0, 0.9) == 0


def test_runs():
    assert k.longest_run(np.array([0, 1, 1, 0, 1, 1, 1]) > 0) == [(1, 2)]
    assert k.longest_run(np.array([0, 1, 1, 0, 1, 1, 1]) > 0, closed=False) == [(1, 2), (4, 6)]


def test_smoothers_keep_what_they_should():
    x = np.arange(40.0)
    assert np.allclose(k.savgol(2 + x - 0.1 * x**2 + 0.01 * x**3), 2 + x - 0.1 * x**2 + 0.01 * x**3)
    for shape in ("hann", "hamming", "bartlett", "blackman", "gaussian"):
        assert np.allclose(k.window_smooth(np.ones(40), 7, shape)[5:-5], 1)
    power, period = k.legacy_period(np.cos(2 * np.pi * x / 8))
    assert period == 8
