"""Greedy kernels against the set functions themselves."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mixloom.functions import greedy as g


def value(s, objective, picked):
    if objective == "fl":
        return sum(max([0.0, *(s[i, j] for j in picked)]) for i in range(len(s)))
    if objective == "gc":
        return s[:, picked].sum() - 0.4 * s[np.ix_(picked, picked)].sum()
    return np.linalg.slogdet(s[np.ix_(picked, picked)] + np.eye(len(picked)))[1] if picked else 0.0


def plain_greedy(x, objective, k):
    u = g.unit_rows(x)
    s = u @ u.T
    picked, gains = [], []
    for _ in range(k):
        open_rows = [j for j in range(len(x)) if j not in picked]
        gain = {j: value(s, objective, [*picked, j]) - value(s, objective, picked) for j in open_rows}
        best = min(open_rows, key=lambda j: (-round(gain[j], 9), j))
        picked.append(best)
        gains.append(gain[best])
    return picked, gains


def vectors(seed, n, width, copies):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    for _ in range(copies):
        x[rng.integers(n)] = x[rng.integers(n)]
    if seed % 3 == 0:
        x[rng.integers(n)] = 0.0
    return x


@pytest.mark.parametrize("objective", ["fl", "gc", "logdet"])
@given(seed=st.integers(0, 10_000), n=st.integers(1, 25), width=st.integers(1, 8), copies=st.integers(0, 6))
@settings(max_examples=40, deadline=None)
def test_same_picks_as_the_definition(objective, seed, n, width, copies):
    x = vectors(seed, n, width, copies)
    places, gains = g.greedy(x, objective, n)
    wanted, wanted_gains = plain_greedy(x, objective, n)
    assert places.tolist() == wanted
    np.testing.assert_allclose(gains, wanted_gains, atol=1e-7)


@pytest.mark.parametrize("objective", ["fl", "gc", "logdet"])
def test_similarities_on_demand_change_nothing(objective, monkeypatch):
    x = vectors(1, 300, 16, 40)
    cached = g.greedy(x, objective, 300)
    monkeypatch.setattr(g, "CACHED_ROWS", 0)
    monkeypatch.setattr(g, "BLOCK", 64)
    monkeypatch.setattr(g, "REFRESH", 7)
    fresh = g.greedy(x, objective, 300)
    assert cached[0].tolist() == fresh[0].tolist()
    np.testing.assert_allclose(cached[1], fresh[1], atol=1e-9)


@pytest.mark.parametrize("objective", ["fl", "gc", "logdet"])
def test_picks_are_nested(objective):
    x = vectors(2, 60, 8, 10)
    whole = g.greedy(x, objective, 60)[0].tolist()
    assert sorted(whole) == list(range(60))
    for k in (1, 7, 59):
        assert g.greedy(x, objective, k)[0].tolist() == whole[:k]


@pytest.mark.parametrize("objective", ["fl", "logdet"])
def test_gains_do_not_grow(objective):
    gains = g.greedy(vectors(3, 120, 8, 20), objective, 120)[1]
    assert (np.diff(gains) <= 1e-9).all()


@pytest.mark.parametrize("objective", ["fl", "gc", "logdet"])
def test_ties_go_to_the_first_row(objective):
    x = np.tile(np.array([[3.0, 4.0]]), (5, 1))
    assert g.greedy(x, objective, 5)[0].tolist() == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("listed", [1, 3000, 60_000, 10**7])
@pytest.mark.parametrize("cached", [0, 4096])
def test_facility_location_from_lists_picks_the_same(listed, cached, monkeypatch):
    """However early the similarities are listed: ties, zero and opposite vectors, coverage from outside and few picks included."""
    monkeypatch.setattr(g, "LISTED", listed)
    monkeypatch.setattr(g, "CACHED_ROWS", cached)
    rng = np.random.default_rng(21)
    x = rng.normal(size=(220, 6))
    x = g.unit_rows(np.concatenate([x, x[:60], -x[60:90], np.zeros((4, 6))]))
    n = len(x)
    for covered in (np.zeros(n), rng.random(n)):
        # Plain greedy over the whole matrix.
        s, cover, free, wanted, rises = x @ x.T, covered.copy(), np.ones(n, bool), [], []
        for _ in range(n):
            gain = np.maximum(s - cover[:, None], 0.0).sum(axis=0)
            j = int(np.where(free, np.round(gain, 9), -np.inf).argmax())
            wanted.append(j)
            rises.append(gain[j])
            free[j], cover = False, np.maximum(cover, s[:, j])
        for k in (1, 40, n):
            places, gains = g.facility_location(x, k, covered)
            assert places.tolist() == wanted[:k] and np.allclose(gains, rises[:k], atol=1e-9)


def test_a_full_order_works_out_gains_a_few_times_only(monkeypatch):
    """Gains of all rows cost the square of their number; an order must not cost that again for every few picks."""
    cells = []
    sums = g._clipped_sums
    monkeypatch.setattr(g, "_clipped_sums", lambda c, at, rows, *a: (cells.append(len(at) * len(rows)), sums(c, at, rows, *a))[1])
    x = g.unit_rows(np.random.default_rng(22).normal(size=(1000, 16)))
    g.facility_location(x, 1000)
    assert sum(cells) < 5 * 1000 * 1000


def test_first_picks_follow_gains_instead_of_making_them_anew(monkeypatch):
    """Few picks of a large set cost a few times the square of its rows, not that again for every other pick."""
    monkeypatch.setattr(g, "CACHED_ROWS", 0)
    made = [0]
    sums, rough = g._clipped_sums, getattr(g, "_Rough", None)
    monkeypatch.setattr(g, "_clipped_sums", lambda c, at, rows, *a: (made.__setitem__(0, made[0] + len(at) * len(rows)), sums(c, at, rows, *a))[1])
    if rough:
        rest = rough.sums
        monkeypatch.setattr(rough, "sums", lambda self, at, rows, *a: (made.__setitem__(0, made[0] + len(at) * len(rows)), rest(self, at, rows, *a))[1])
    n = 3000
    x = g.unit_rows(np.random.default_rng(23).normal(size=(n, 48)))
    places, gains = g.facility_location(x, 40)
    assert made[0] < 5 * n * n
    s, cover, free = x @ x.T, np.zeros(n), np.ones(n, bool)
    for j, made_gain in zip(places.tolist(), gains):
        gain = np.maximum(s - cover[:, None], 0.0).sum(axis=0)
        assert j == int(np.where(free, np.round(gain, 9), -np.inf).argmax()) and abs(gain[j] - made_gain) < 1e-8
        free[j], cover = False, np.maximum(cover, s[:, j])


@pytest.mark.parametrize("width", [3, 64, 300])
def test_rough_sums_are_wrong_by_no_more_than_they_say(width):
    rng = np.random.default_rng(24)
    x = rng.normal(size=(1300, width))
    x[700:1000] = x[:300] + 1e-4 * rng.normal(size=(300, width))
    x = g.unit_rows(np.concatenate([x, x[:50], np.zeros((3, width))]))
    s, every = x @ x.T, np.arange(len(x))
    rough = g._Rough(x)
    found, error = rough.positive()
    assert (np.abs(found - np.maximum(s, 0.0).sum(axis=0)) <= error).all()
    low, gap = s[:, 5].clip(0.0), rng.random(len(x))
    for at, rows in ((every, every), (every[3:600], every[::3])):
        for most in (None, gap[rows]):
            found, error = rough.sums(at, rows, low[rows], most)
            wanted = np.minimum(np.maximum(s[np.ix_(rows, at)] - low[rows, None], 0.0), np.inf if most is None else most[:, None]).sum(axis=0)
            assert (np.abs(found - wanted) <= error).all() and (error < 0.03 * len(rows)).all()


@pytest.mark.parametrize("first", [True, False])
def test_large_sets_have_the_picks_of_plain_greedy(first, monkeypatch):
    """Clusters of unlike size, copies, zero rows: gains far below the best are left aside, bounds stay above, ties go to the first."""
    monkeypatch.setattr(g, "CACHED_ROWS", 0)
    monkeypatch.setattr(g, "LISTED", 40_000)
    monkeypatch.setattr(g, "EXACT", 20)
    rng = np.random.default_rng(25)
    x = rng.normal(size=(700, 24))
    x[100:400] = x[0] + 0.2 * rng.normal(size=(300, 24))
    x[400:450] = x[1] + 0.2 * rng.normal(size=(50, 24))
    x[450:520] = x[2]
    x[690:] = 0.0
    x = g.unit_rows(x)
    n, s = len(x), x @ x.T
    cover, free, wanted = np.zeros(n), np.ones(n, bool), []
    for _ in range(n):
        gain = np.where(free, np.round(np.maximum(s - cover[:, None], 0.0).sum(axis=0), 9), -np.inf)
        wanted.append(int(gain.argmax()))
        free[wanted[-1]], cover = False, np.maximum(cover, s[:, wanted[-1]])
    known = np.maximum(s, 0.0).sum(axis=0) if first else None
    for k in (3, 60, n):
        assert g.facility_location(x, k, None, known)[0].tolist() == wanted[:k]
