"""Greedy maximisation of three set functions over the rows of one bounded block.

All take unit vectors (zero rows stay zero), pick `k` rows one by one and return their places and
marginal gains. None of them needs the n x n similarity matrix: graph cut and log-determinant
keep a d-sized state, facility location evaluates similarities in blocks. Gains are compared after
rounding, and the lower place wins a tie, so that float noise never decides.
"""

from __future__ import annotations

import numpy as np

from mixloom.config import GAIN_DIGITS, GRAPH_CUT_LAMBDA, LOG_DET_LAMBDA

# Similarity columns are cached as one matrix up to this many rows (128 MB), else made on demand.
CACHED_ROWS = 4096
# Facility location: side of a block of similarities (2 MB), gains worked out at a time, gains kept in full precision before
# the lower half is followed in single precision again, and the part of the best gain below which gains are not followed.
BLOCK = 512
REFRESH = 64
EXACT = 512
IDLE = 0.8
# Half a unit in the last place of single precision, and what a similarity may exceed another by that is the same.
ROUNDING = 2.0**-24
NOISE = 2e-15
# Similarities above what covers their row that are kept as lists, about 250 MB, and how many similarities are made in the time
# that one of them takes; rows they are estimated from, and how many times the picks there were at one estimate make the next.
LISTED = 8_000_000
LIST_COST = 50
TRIAL_ROWS = 256
TRIAL_STEP = 1.25

# What one task may do: bytes of vectors, and multiplications of facility location's first gains.
ONE_TASK_BYTES = 256 << 20
ONE_TASK_PRODUCTS = 3.2e11


def fits_one_task(rows: int, width: int, objective: str) -> bool:
    """Whether greedy over so many vectors is work for one task."""
    return rows * width * 8 <= ONE_TASK_BYTES and (objective != "fl" or rows * rows * width <= ONE_TASK_PRODUCTS)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _similarity(x: np.ndarray):
    """Columns of the similarity matrix, by place or list of places."""
    if len(x) <= CACHED_ROWS:
        full = x @ x.T
        return lambda j: full[:, j]
    return lambda j: x @ x[j].T


def _best(gain: np.ndarray, taken: np.ndarray) -> int:
    return int(np.argmax(np.where(taken, -np.inf, np.round(gain, GAIN_DIGITS))))


def graph_cut(x: np.ndarray, k: int, weight: float = GRAPH_CUT_LAMBDA):
    """f(X) = sum of s(i, j) over i in V, j in X, minus weight * sum of s(i, j) over i, j in X."""
    similar = _similarity(x)
    gain = x @ x.sum(axis=0) - weight * (x * x).sum(axis=1)
    taken = np.zeros(len(x), dtype=bool)
    places, gains = np.empty(k, dtype=np.int64), np.empty(k)
    for step in range(k):
        j = _best(gain, taken)
        places[step], gains[step], taken[j] = j, gain[j], True
        gain -= 2.0 * weight * similar(j)
    return places, gains


def log_determinant(x: np.ndarray, k: int, weight: float = LOG_DET_LAMBDA):
    """f(X) = log det(S_X + weight * I), by rank-one updates of a d x d inverse."""
    inverse = np.eye(x.shape[1]) / weight
    spread = (x * x).sum(axis=1) / weight
    taken = np.zeros(len(x), dtype=bool)
    places, gains = np.empty(k, dtype=np.int64), np.empty(k)
    for step in range(k):
        gain = np.log(weight) + np.log1p(spread)
        j = _best(gain, taken)
        places[step], gains[step], taken[j] = j, gain[j], True
        u = inverse @ x[j]
        scale = 1.0 + x[j] @ u
        along = x @ u
        spread = np.maximum(spread - along * along / scale, 0.0)
        inverse -= np.outer(u, u) / scale
    return places, gains


def _clipped_sums(cells, at: np.ndarray, rows: np.ndarray, low: np.ndarray, gap=None) -> np.ndarray:
    """For each j in `at`, the sum over i in `rows` of s(i, j) - low(i), clipped to [0, gap(i)].

    `cells(at, rows)` gives similarities; they are made and summed up in small blocks.
    """
    sums = np.zeros(len(at))
    for start in range(0, len(rows), BLOCK):
        part = slice(start, start + BLOCK)
        for first in range(0, len(at), BLOCK):
            block = cells(at[first : first + BLOCK], rows[part])
            block -= low[part]
            np.maximum(block, 0.0, out=block)
            if gap is not None:
                np.minimum(block, gap[part], out=block)
            sums[first : first + BLOCK] += block.sum(axis=1)
    return sums


class _Rough:
    """`_clipped_sums` in single precision, for a third of the time, and what they are wrong by at most."""

    def __init__(self, x: np.ndarray):
        # A last column takes what is subtracted from the similarities of a row.
        self.x = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
        self.cell_error = 2.0 * (x.shape[1] + 8) * ROUNDING
        self.ones, self.block = np.ones(BLOCK, np.float32), np.empty((BLOCK, BLOCK), np.float32)

    def lowered(self, rows, low: np.ndarray) -> np.ndarray:
        own = self.x[rows].copy()
        own[:, -1] = -low
        return own

    def product(self, own: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """s(i, j) less what `own` was lowered by, in a block that the next call overwrites."""
        return np.matmul(own, ahead.T, out=self.block if len(own) == len(ahead) == BLOCK else None)

    def sums(self, at: np.ndarray, rows: np.ndarray, low: np.ndarray, gap=None) -> tuple[np.ndarray, np.ndarray]:
        gap = None if gap is None else gap.astype(np.float32)[:, None]
        sums, ahead, zero = np.zeros(len(at)), self.x[at], np.float32(0.0)
        for start in range(0, len(rows), BLOCK):
            part = slice(start, start + BLOCK)
            own = self.lowered(rows[part], low[part])
            for first in range(0, len(at), BLOCK):
                block = self.product(own, ahead[first : first + BLOCK])
                np.maximum(block, zero, out=block)
                if gap is not None:
                    np.minimum(block, gap[part], out=block)
                sums[first : first + BLOCK] += self.ones[: len(own)] @ block
        return sums, self._error(len(rows), sums)

    def positive(self) -> tuple[np.ndarray, np.ndarray]:
        """`sums` of all rows over all rows with nothing covered: similarities are symmetric, so half of them are made."""
        sums, zero, count = np.zeros(len(self.x)), np.float32(0.0), len(self.x)
        for start in range(0, count, BLOCK):
            part = slice(start, start + BLOCK)
            own = self.lowered(part, 0.0)
            for first in range(start, count, BLOCK):
                block = self.product(own, self.x[first : first + BLOCK])
                np.maximum(block, zero, out=block)
                sums[first : first + BLOCK] += self.ones[: len(own)] @ block
                if first > start:
                    sums[part] += block @ self.ones[: block.shape[1]]
        return sums, self._error(count, sums)

    def _error(self, rows: int, sums: np.ndarray) -> np.ndarray:
        return rows * self.cell_error + (BLOCK + 2) * ROUNDING * sums


def facility_location(x: np.ndarray, k: int, covered: np.ndarray | None = None, first: np.ndarray | None = None):
    """f(X) = sum over i of the best s(i, j), j in X, at least 0, or at least what `covered` says of i.

    A pick lowers the gains of all others by what the rows that it covers better held for them, and a row is covered better the
    more rarely the more picks there are: following all gains costs a few times the square of the rows. Of large sets they are
    followed in single precision, as bounds from above with their errors added; only those that reach the best gain are worked
    out in full. Gains far below the best are not followed until it comes down to them, then by all that happened since. With the
    picks fewer and fewer similarities exceed what covers their row. Once these fit into LISTED, the picks that are left are made
    from them. `first` are the first gains, if they are known.
    """
    n = len(x)
    every = np.arange(n)
    covered = np.zeros(n) if covered is None else covered.copy()
    full = x @ x.T if n <= CACHED_ROWS else None
    rough = None if full is not None else _Rough(x)

    def cells(at, rows):
        return x[at] @ x[rows].T if full is None else full[np.ix_(at, rows)]

    def above(at, rows, low, gap=None):
        """Sums that are not too low, and sums that are not too high."""
        if rough is None:
            sums = _clipped_sums(cells, at, rows, low, gap)
            return sums, sums
        sums, error = rough.sums(at, rows, low, gap)
        return sums + error, np.maximum(sums - error, 0.0)

    taken, active = np.zeros(n, dtype=bool), np.ones(n, dtype=bool)
    exact = np.full(n, rough is None or first is not None)
    bound = None if first is None else first.astype(np.float64)
    # Sets of rows that are not followed: their highest bound, the rows, and the coverage of their bounds.
    idle: list[tuple[float, np.ndarray, np.ndarray]] = []
    slack = 2.0 * 10.0**-GAIN_DIGITS
    places, gains = np.empty(k, dtype=np.int64), np.empty(k)
    # Multiples of n similarities that a pick takes of late, as many times the picks: what falls with the picks, this keeps.
    trial, work = 0.0, float(n)
    for step in range(k):
        # What is left to do without lists, and what lists cost: all similarities, and work on each entry.
        left = work * np.log(k / max(step, 0.5))
        if step >= trial and (left >= n + LIST_COST * LISTED / n or full is not None):
            trial = max(step + 1, TRIAL_STEP * step)
            if _exceeding(cells, covered) <= LISTED:
                places[step:], gains[step:] = _listed_picks(x, full, covered, taken, k - step)
                break
        if bound is None:
            if rough is None or covered.any():
                bound = above(every, every, covered)[0]
            else:
                bound = sum(rough.positive())
        spent = 0.0
        while True:
            known = active & exact & ~taken
            floor = bound[known].max() if known.any() else -np.inf
            reached = [i for i, part in enumerate(idle) if part[0] >= floor - slack]
            if reached and (floor > -np.inf or not (active & ~taken).any()):
                for i in reversed(reached):
                    _, own, before = idle.pop(i)
                    rows = np.flatnonzero(covered > before)
                    bound[own] -= above(own, rows, before[rows], covered[rows] - before[rows])[1]
                    active[own], exact[own] = True, rough is None
                    spent += len(own) * len(rows) / n
                continue
            doubtful = np.flatnonzero(active & ~exact & ~taken & (bound >= floor - slack))
            if not len(doubtful):
                break
            if len(doubtful) > REFRESH:
                doubtful = doubtful[np.argpartition(-bound[doubtful], REFRESH)[:REFRESH]]
            bound[doubtful] = _clipped_sums(cells, doubtful, every, covered)
            exact[doubtful] = True
            spent += 2.0 * len(doubtful)
        # What is not exact lies below the best gain by more than a rounding step.
        j = _best(bound, taken | ~active | ~exact)
        places[step], gains[step], taken[j] = j, bound[j], True
        low = np.flatnonzero(active & ~taken & (bound < IDLE * floor))
        if 10 * len(low) > active.sum():
            # Those of the same size come back together.
            level = np.floor(np.log2(np.maximum(bound[low], 1e-300) / floor))
            for part in np.unique(level):
                own = low[level == part]
                idle.append((float(bound[own].max()), own, covered))
            active[low] = False
        before, covered = covered, np.maximum(covered, x @ x[j])
        rows = np.flatnonzero(covered > before)
        if len(rows):
            low, gap = before[rows], covered[rows] - before[rows]
            if rough is not None:
                own = np.flatnonzero(active & exact & ~taken)
                if len(own) > EXACT:
                    exact[own[bound[own] < np.median(bound[own])]] = False
                    own = own[exact[own]]
                bound[own] -= _clipped_sums(cells, own, rows, low, gap)
            own = np.flatnonzero(active & ~taken & (~exact if rough is not None else True))
            bound[own] -= above(own, rows, low, gap)[1]
            np.maximum(bound, 0.0, out=bound)
            spent += len(own) * len(rows) / n
        work = 0.8 * work + 0.2 * spent * (step + 1)
    return places, gains


def _exceeding(cells, covered: np.ndarray) -> float:
    """About how many similarities exceed what covers their row."""
    n = len(covered)
    every = np.arange(n)
    some = every[:: max(1, n // TRIAL_ROWS)]
    more = 0
    for start in range(0, n, BLOCK):
        more += (cells(some, every[start : start + BLOCK]) > covered[some][:, None] + NOISE).sum()
    return more * n / len(some)


def _lists(x: np.ndarray, full: np.ndarray | None, covered: np.ndarray):
    """Per row how many similarities exceed what covers it, their columns and values, one row after the other."""
    n = len(covered)
    rough = None if full is not None else _Rough(x)
    sizes, columns, values = [], [], []
    for start in range(0, n, BLOCK):
        low = covered[start : start + BLOCK] + NOISE
        lowered = None if rough is None else rough.lowered(slice(start, start + BLOCK), low)
        found = []
        for first in range(0, n, BLOCK):
            part = slice(start, start + BLOCK), slice(first, first + BLOCK)
            if full is not None:
                block = full[part]
                own, other = np.nonzero(block > low[:, None])
                found.append((own, first + other, block[own, other]))
                continue
            block = rough.product(lowered, rough.x[part[1]])
            at = np.flatnonzero(block > np.float32(-rough.cell_error))
            own, other = np.divmod(at, block.shape[1])
            if 100 * len(own) > block.size:
                value = (x[part[0]] @ x[part[1]].T)[own, other]
            else:
                value = np.einsum("ij,ij->i", x[start + own], x[first + other])
            more = value > low[own]
            found.append((own[more], first + other[more], value[more]))
        own, other, value = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(own, kind="stable")
        sizes.append(np.bincount(own, minlength=len(low)))
        columns.append(other[order].astype(np.int32))
        values.append(value[order])
    return np.concatenate(sizes), np.concatenate(columns), np.concatenate(values)


def _listed_picks(x: np.ndarray, full: np.ndarray | None, covered: np.ndarray, taken: np.ndarray, k: int):
    """The next `k` picks of facility location, from lists of all similarities that exceed what covers their row."""
    n = len(covered)
    every = np.arange(n)
    sizes, columns, values = _lists(x, full, covered)
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), sizes]))
    row = np.repeat(every.astype(np.int32), np.diff(ends))
    gain = np.bincount(columns, values - covered[row], minlength=n)
    # Places in the lists by column, to find the rows that a pick covers better.
    by_column = np.argsort(columns, kind="stable").astype(np.int32)
    column_ends = np.concatenate([[0], np.cumsum(np.bincount(columns, minlength=n))])
    value = np.where(taken, -np.inf, np.round(gain, GAIN_DIGITS))
    taken, covered = taken.copy(), covered.copy()
    places, gains = np.empty(k, dtype=np.int64), np.empty(k)
    for step in range(k):
        j = int(value.argmax())
        places[step], gains[step], taken[j] = j, max(gain[j], 0.0), True
        own = by_column[column_ends[j] : column_ends[j + 1]]
        own = own[values[own] > covered[row[own]]]
        rows = row[own]
        before, now = covered[rows], values[own]
        covered[rows] = now
        # The lists of all these rows, one after the other.
        sizes = ends[rows + 1] - ends[rows]
        at = np.arange(sizes.sum()) + np.repeat(ends[rows] - (np.cumsum(sizes) - sizes), sizes)
        lost = np.minimum(values[at], np.repeat(now, sizes)) - np.repeat(before, sizes)
        less = lost > 0.0
        touched = columns[at[less]]
        np.subtract.at(gain, touched, lost[less])
        value[touched] = np.round(gain[touched], GAIN_DIGITS)
        value[touched[taken[touched]]] = -np.inf
        value[j] = -np.inf
    return places, gains


GREEDY = {"fl": facility_location, "gc": graph_cut, "logdet": log_determinant}


def greedy(x: np.ndarray, objective: str, k: int):
    """Places and marginal gains of the first `k` picks, in pick order."""
    return GREEDY[objective](unit_rows(x), min(k, len(x)))
