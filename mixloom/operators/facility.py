"""Facility location over rows of any size: exact greedy picks, many per cycle of distributed passes.

The gain of a row j is the sum over all rows i of max(0, s(i, j) - covered(i)). Rows lie in blocks around centres, so that
rows of one block are alike. A cycle

1. brings the highest bounds of every block to the driver, and the vectors of the best of all, FRESH_BYTES at most. A gain only
   shrinks, so an outdated one bounds the new one from above; gains of rows that were brought are worked out anew,
   skipping blocks that are too far from the row to be covered better by it;
2. sums up, for the best of them, how much the gains of any two overlap, and for every block a lower bound of what each pick
   takes from all rows of the block. A row within the radius r of the centre is at least 1 - 2 r^2 similar to each of them;
3. commits picks one after the other, as long as the next gain certainly beats what any other row can still have. After one
   pick that overlaps, a gain is known exactly, after several it lies between two bounds. Picks in different blocks hardly
   overlap, so most of the blocks can give a pick or more;
4. works out the gains of the committed picks in their order, and stores coverage and bounds.

Once the blocks come apart, they need no more cycles: blocks that are too far from each other to cover one another's rows better
than they are have orders of their own. Where a caller says how many rows are work for one task, and no set of blocks that
are near each other has more, every set is ordered in a task and the orders are merged by gain, by distributed positions. Groups
that have no more to begin with need no blocks: `whole_picks` makes the first gains of all of them together.

The driver holds the centres, one cycle's rows and two matrices over the heads; picks go to a table. Blocks decide how many picks
a cycle commits, never which.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixloom.cluster import stored
from mixloom.config import GAIN_DIGITS
from mixloom.functions.greedy import facility_location, unit_rows
from mixloom.operators.ranking import range_positions
from mixloom.operators.similarity import grid_sums, matrix

# Blocks at most, and rows a block has on average at least; rows that centres are worked out from.
BLOCKS = 256
BLOCK_ROWS = 64
SAMPLE_ROWS = 4096
ROUNDS = 6
# Rows per block that a cycle brings: at first, and at most where bounds are too loose to commit a pick.
BROUGHT = 16
BROUGHT_MOST = 64
# Bytes of vectors that a cycle brings, but HEADS rows at least.
FRESH_BYTES = 2 << 20
# Rows whose overlaps are worked out; a cycle that commits less than one in so many of them is followed by a wider one.
HEADS = 256
FEW = 4
# Tasks that groups are dealt over which are work for one task each.
GROUP_TASKS = 1024
# Gains are compared rounded; what is surely less is less by more than a rounding step.
STEP = 10.0**-GAIN_DIGITS
# Overlaps below this are rounding errors of disjoint sums.
NOTHING = 1e-13
ROWS = "row_idx bigint, embedding array<double>, block int, distance double, covered double, bound double, seen bigint"


def _vectors(table: pa.Table) -> np.ndarray:
    return matrix(table["embedding"], table["row_idx"])


def _lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)[: len(x) + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(2.0 * x @ centres.T - (centres * centres).sum(axis=1), axis=1)


def centres_of(rows: DataFrame, count: int) -> np.ndarray:
    """Centres of blocks, made in a task from a sample of bounded size that the hash of row_idx makes."""

    def centres(sample: pa.Table) -> pa.Table:
        x = unit_rows(_vectors(sample.sort_by("row_idx")))
        number = max(1, min(BLOCKS, count // BLOCK_ROWS, len(x)))
        # Each next centre is the row that is farthest from those before.
        chosen, far = [0], np.full(len(x), np.inf)
        for _ in range(number - 1):
            gap = x - x[chosen[-1]]
            far = np.minimum(far, (gap * gap).sum(axis=1))
            chosen.append(int(far.argmax()))
        made = x[chosen]
        for _ in range(ROUNDS):
            own = _nearest(x, made)
            members = np.bincount(own, minlength=number)
            total = np.zeros_like(made)
            np.add.at(total, own, x)
            made = np.where(members[:, None] > 0, total / np.maximum(members, 1)[:, None], made)
        return pa.table({"line": pa.array(np.arange(number, dtype=np.int32)), "v": _lists(made)})

    share = max(1, -(-count // SAMPLE_ROWS))
    keyed = rows.select("row_idx", "embedding")
    sample = keyed.where(F.pmod(F.xxhash64("row_idx"), F.lit(share)) == 0).limit(2 * SAMPLE_ROWS)
    for part in (sample, keyed.limit(1)):
        found = part.groupBy().applyInArrow(centres, "line int, v array<double>").collect()
        if found:
            break
    return np.array([r["v"] for r in sorted(found, key=lambda r: r["line"])])


def whole_picks(rows: DataFrame, groups: int) -> DataFrame:
    """(_group, place, row_idx, gain), places from 0, of `groups` groups that are work for one task each.

    `rows` holds (_group, row_idx, embedding, quota) and is stored, `_group` numbers the groups from 0, the largest first. First
    gains are made by cells of all groups together; the picks follow them in a task per group.
    """
    keys = ["_group", "row_idx"]
    known = rows.join(grid_sums(rows, ["_group"]).withColumnRenamed("positive_sum", "_first"), keys)

    def order(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_idx")
        wanted = min(table["quota"][0].as_py() or len(table), len(table))
        places, gains = facility_location(unit_rows(_vectors(table)), wanted, None, table["_first"].to_numpy())
        picked = table.select(keys).take(pa.array(places))
        picked = picked.add_column(1, "place", pa.array(np.arange(len(places))))
        return picked.append_column("gain", pa.array(gains))

    dealt = known.repartitionById(max(1, min(groups, GROUP_TASKS)), F.col("_group"))
    return dealt.groupBy("_group").applyInArrow(order, "_group int, place bigint, row_idx bigint, gain double")


class Facility:
    """The state of one greedy run; `rows` holds (row_idx, embedding) and is stored."""

    def __init__(self, rows: DataFrame, one_task_rows: int = 0):
        self.one_task_rows = one_task_rows
        first = grid_sums(rows.withColumn("_all", F.lit(0)), ["_all"])
        bounded = rows.join(first.select("row_idx", F.col("positive_sum").alias("bound")), "row_idx")
        self.centres = centres = centres_of(rows, rows.count())

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                x = unit_rows(_vectors(table))
                block = _nearest(x, centres)
                gap = np.sqrt(((x - centres[block]) ** 2).sum(axis=1))
                zero = np.zeros(len(x))
                columns = [table["row_idx"].combine_chunks(), _lists(x), block.astype(np.int32), gap, zero, table["bound"].combine_chunks()]
                columns = [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns]
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(zero.astype(np.int64))], [f.split()[0] for f in ROWS.split(", ")])

        placed = bounded.select("row_idx", "embedding", "bound").mapInArrow(place, ROWS)
        # Tasks with rows of few blocks skip most of the others' work.
        self.rows = stored(placed.repartitionByRange("block", "row_idx").sortWithinPartitions("block", "row_idx"))
        self.radius = np.zeros(len(centres))
        for r in self.rows.groupBy("block").agg(F.max("distance").alias("radius")).collect():
            self.radius[r["block"]] = r["radius"]
        self.cycles = 0

    def picks(self, count: int, out) -> DataFrame:
        wide, tried = BROUGHT, 0
        while out.count < count:
            if self.one_task_rows and out.count >= tried:
                apart = self._apart()
                if apart is not None:
                    self._apart_picks(apart, out, count)
                    break
                # Tried again when there are twice as many picks: few trials, however many cycles.
                tried = max(1, 2 * out.count)
            self.cycles += 1
            ids, block, x, gain, floors, last = self._brought(wide, out.count)
            order = np.lexsort((ids, -np.round(gain, GAIN_DIGITS)))
            best = order[0]
            top = round(float(gain[best]), GAIN_DIGITS)
            if top <= 0.0 and floors.max() < STEP / 2:
                self._rest(out, count)
                break
            if not self._first_is_sure(top, ids[best], floors, last):
                wide = min(4 * wide, BROUGHT_MOST)
                self._store(np.zeros((0, x.shape[1])), ids, gain, np.zeros(len(floors)), out.count, out.count)
                continue
            heads = order[:HEADS]
            rest = order[HEADS:]
            np.maximum.at(floors, block[rest], gain[rest])
            overlap, taken = self._overlaps(x[heads])
            chosen, bound, cut = self._commit(ids[heads], gain[heads], overlap, taken, floors, count - out.count)
            picked = heads[chosen]
            gains = self._gains_in_order(x[picked])
            before = out.count
            for j, g in zip(picked.tolist(), gains.tolist()):
                out.add(int(ids[j]), g)
            known = gain.copy()
            known[heads] = bound
            known[picked] = -np.inf
            self._store(x[picked], ids, known, cut, before, out.count)
            out.write()
            wide = min(2 * wide, BROUGHT_MOST) if len(chosen) < len(heads) // FEW else wide
        return out.rows()

    def _brought(self, wide: int, picks: int):
        """The rows of highest bounds with gains of now, and per block the bound and row_idx of the first one that was not brought.

        `wide` rows of a block may be among them. A block that has no more rows than were brought has a bound of minus infinity.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                best = table if best is None else pa.concat_tables([best, table])
                best = _leading(best, wide + 1)
            if best is not None:
                yield from best.to_batches()

        shape = "row_idx bigint, block int, bound double, seen bigint"
        columns = [f.split()[0] for f in shape.split(", ")]
        open_ = self.rows.select(columns).where("bound >= 0")
        order = Window.partitionBy("block").orderBy(F.round("bound", GAIN_DIGITS).desc(), "row_idx")
        found = open_.mapInArrow(run, shape).withColumn("place", F.row_number().over(order))
        found = found.where(F.col("place") <= wide + 1).collect()
        # Of all and of every block the best ones come first, so each block's rows that are not brought follow those that are.
        found.sort(key=lambda r: (-round(r["bound"], GAIN_DIGITS), r["row_idx"]))
        fresh = max(HEADS, FRESH_BYTES // (8 * self.centres.shape[1]))
        kept = [r for r in found if r["place"] <= wide][:fresh]
        brought = {r["row_idx"] for r in kept}
        floors, last = np.full(len(self.centres), -np.inf), np.zeros(len(self.centres), np.int64)
        for r in found:
            if r["row_idx"] not in brought and floors[r["block"]] == -np.inf:
                floors[r["block"]] = r["bound"]
                last[r["block"]] = r["row_idx"]
        vectors = self.rows.select("row_idx", "embedding").where(F.col("row_idx").isin(sorted(brought)))
        vectors = {r["row_idx"]: r["embedding"] for r in vectors.collect()}
        ids, block = (np.array([r[c] for r in kept], np.int64) for c in ("row_idx", "block"))
        x = np.array([vectors[r["row_idx"]] for r in kept])
        gain = np.array([r["bound"] for r in kept])
        old = np.flatnonzero([r["seen"] != picks for r in kept])
        if len(old):
            gain[old] = self._gains(x[old])
        return ids, block, x, gain, floors, last

    @staticmethod
    def _first_is_sure(top: float, row: int, floors: np.ndarray, last: np.ndarray) -> bool:
        """No row that was not brought comes before the best one that was: equal bounds have higher ids than the last."""
        rounded = np.round(floors, GAIN_DIGITS)
        less = rounded < top - STEP / 2
        equal = ~less & (rounded < top + STEP / 2) & (last > row)
        return bool((less | equal).all())

    def _summed(self, kernel, width: int) -> np.ndarray:
        """Sum over all rows of what `kernel(x, covered, block)` gives for a batch: (line, values) pairs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    table = pa.Table.from_batches([batch])
                    covered, block = table["covered"].to_numpy(), table["block"].to_numpy()
                    made = kernel(_vectors(table), covered, block)
                    total = made if total is None else total + made
            if total is not None:
                lines = pa.array(np.arange(len(total), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([lines, _lists(total)], ["line", "v"])

        parts = self.rows.select("row_idx", "embedding", "covered", "block").mapInArrow(run, "line int, v array<double>")
        parts = parts.groupBy("line").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
        return np.array([r["v"] for r in sorted(parts.collect(), key=lambda r: r["line"])]).reshape(-1, width)

    def _gains(self, ahead: np.ndarray) -> np.ndarray:
        centres, radius = self.centres, self.radius

        def kernel(x, covered, block):
            total = np.zeros(len(ahead))
            length = (ahead * ahead).sum(axis=1)
            for b in np.unique(block):
                own = np.flatnonzero(block == b)
                # Similarity of unit vectors falls with their distance; a zero vector covers nothing.
                gap = np.sqrt(np.maximum(length - 2.0 * ahead @ centres[b] + centres[b] @ centres[b], 0.0))
                most = 1.0 - np.maximum(gap - radius[b] - STEP, 0.0) ** 2 / 2.0
                near = np.flatnonzero(most > covered[own].min() - STEP)
                if len(near):
                    part = x[own] @ ahead[near].T
                    part -= covered[own][:, None]
                    total[near] += np.maximum(part, 0.0, out=part).sum(axis=0)
            return total[:, None]

        return self._summed(kernel, 1)[:, 0]

    def _overlaps(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per two heads the sum of the lesser of their parts of the gain; per head and block what it surely takes from each row."""
        alike, blocks = 1.0 - 2.0 * self.radius**2 - STEP, len(self.centres)

        def kernel(x, covered, block):
            part = np.maximum(x @ heads.T - covered[:, None], 0.0)
            both = np.zeros((len(heads), len(heads) + blocks))
            sure = np.minimum(part, np.maximum(alike[block] - covered, 0.0)[:, None])
            for a in range(len(heads)):
                own = np.flatnonzero(part[:, a])
                if len(own):
                    both[a, : len(heads)] = np.minimum(part[own], part[own, a][:, None]).sum(axis=0)
                    both[a, len(heads) :] = np.bincount(block[own], weights=sure[own, a], minlength=blocks)
            return both

        made = self._summed(kernel, len(heads) + blocks)
        return made[:, : len(heads)], made[:, len(heads) :]

    @staticmethod
    def _commit(ids, gain, overlap, taken, floors, most: int):
        """Places of the picks that are sure, upper bounds of all heads after them, and what is surely cut from each block."""
        high, low = gain.copy(), gain.copy()
        free, cut = np.ones(len(ids), bool), np.zeros(len(floors))
        chosen: list[int] = []
        # Committed picks that overlap with each head, pairwise disjoint ones as long as the gain is exact.
        exact = np.ones(len(ids), bool)
        while len(chosen) < min(most, len(ids)):
            open_ = np.flatnonzero(free)
            value = np.round(high[open_], GAIN_DIGITS)
            at = open_[np.lexsort((ids[open_], -value))]
            j = at[0]
            if chosen:
                least = low[j] - STEP
                if len(at) > 1:
                    k = at[1]
                    tied = exact[j] and exact[k] and round(high[k], GAIN_DIGITS) <= round(low[j], GAIN_DIGITS)
                    if not tied and high[at[1:]].max() >= least:
                        break
                if not exact[j] and len(at) > 1 and high[at[1:]].max() >= least:
                    break
                if np.maximum(floors - cut, 0.0)[floors > -np.inf].max(initial=-np.inf) >= least:
                    break
            others = np.flatnonzero(free & (overlap[j] > NOTHING))
            for k in others[others != j].tolist():
                earlier = [c for c in chosen if overlap[c, k] > NOTHING]
                alone = all(overlap[c, j] <= NOTHING for c in earlier)
                low[k] = max(low[k] - overlap[j, k], 0.0)
                if exact[k] and alone:
                    high[k] = low[k]
                else:
                    exact[k] = False
                    high[k] = max(min(high[k], gain[k] - overlap[j, k]), low[k])
            free[j] = False
            chosen.append(int(j))
            cut = np.maximum(cut, taken[j])
        return np.array(chosen), high, cut

    def _gains_in_order(self, picked: np.ndarray) -> np.ndarray:
        def kernel(x, covered, block):
            part = np.maximum(x @ picked.T - covered[:, None], 0.0)
            reached = np.maximum.accumulate(part, axis=1)
            return (reached.sum(axis=0) - np.concatenate([[0.0], reached.sum(axis=0)[:-1]]))[:, None]

        return self._summed(kernel, 1)[:, 0]

    def _store(self, picked: np.ndarray, ids: np.ndarray, known: np.ndarray, cut: np.ndarray, before: int, after: int) -> None:
        """Coverage and bounds after the picks: what is known of `ids`, and less what is cut from the block of the others."""
        order = np.argsort(ids)
        ids, known = ids[order], known[order]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                row, block, covered, bound, seen = (
                    table[c].to_numpy() for c in ("row_idx", "block", "covered", "bound", "seen")
                )
                gone = bound < 0
                if len(picked):
                    covered = np.maximum(covered, (_vectors(table) @ picked.T).max(axis=1))
                at = np.minimum(np.searchsorted(ids, row), len(ids) - 1)
                own = ids[at] == row
                bound = np.where(own, known[at], np.maximum(bound - cut[block], 0.0))
                bound = np.where(gone, -np.inf, bound)
                seen = np.where(own & (before == after), after, seen)
                for name, values in (("covered", covered), ("bound", bound), ("seen", seen)):
                    table = table.set_column(table.schema.get_field_index(name), name, pa.array(values))
                yield from table.to_batches()

        self.rows = stored(self.rows.mapInArrow(run, ROWS))

    def _apart(self) -> np.ndarray | None:
        """Per block the number of its set, if all sets of near blocks are work for one task; sets cover none of each other's rows."""
        number = len(self.centres)
        rows, least = np.zeros(number, np.int64), np.full(number, np.inf)
        left = self.rows.where("bound >= 0").groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("covered").alias("least"))
        for r in left.collect():
            rows[r["block"]], least[r["block"]] = r["n"], r["least"]
        if rows.sum() <= self.one_task_rows:
            return np.zeros(number, np.int64)
        length = (self.centres * self.centres).sum(axis=1)
        gap = np.sqrt(np.maximum(length[:, None] + length - 2.0 * self.centres @ self.centres.T, 0.0))
        most = 1.0 - np.maximum(gap - self.radius[:, None] - self.radius - STEP, 0.0) ** 2 / 2.0
        near = (most > np.minimum(least[:, None], least) - STEP) & (rows[:, None] > 0) & (rows > 0)
        found = np.arange(number)
        while True:
            lower = np.minimum(found, np.where(near, found, number).min(axis=1))
            if (lower == found).all():
                break
            found = lower
        return found if np.bincount(found, weights=rows).max() <= self.one_task_rows else None

    def _apart_picks(self, apart: np.ndarray, out, count: int) -> None:
        """The picks that are left, every set in a task of its own. Gains fall along an order, so sorting by gain merges the orders."""
        wanted = count - out.count

        def order(table: pa.Table) -> pa.Table:
            table = table.sort_by("row_idx")
            places, gains = facility_location(_vectors(table), min(wanted, len(table)), table["covered"].to_numpy())
            picked = table.select(["row_idx"]).take(pa.array(places))
            picked = picked.append_column("gain", pa.array(gains))
            # Rounded alike in every task, and never rising by what rounding leaves.
            falling = np.minimum.accumulate(np.round(gains, GAIN_DIGITS)) + 0.0
            return picked.append_column("_from_top", pa.array(-falling))

        of_block = F.element_at(F.array(*[F.lit(int(a)) for a in apart]), F.col("block") + 1)
        left = self.rows.where("bound >= 0").select("row_idx", "embedding", "covered", of_block.alias("_set"))
        picks = left.groupBy("_set").applyInArrow(order, "row_idx bigint, gain double, _from_top double")
        placed = range_positions(picks, [], ["_from_top", "row_idx"], "place").where(F.col("place") < wanted)
        out.append(placed.select((F.col("place") + out.count).alias("place"), "row_idx", "gain"))
        out.count = count

    def _rest(self, out, count: int) -> None:
        """Rows without a gain follow in order, without the driver."""
        rest = self.rows.where("bound >= 0").select("row_idx")
        placed = range_positions(rest, [], ["row_idx"], "place").where(F.col("place") < count - out.count)
        out.append(placed.select((F.col("place") + out.count).alias("place"), "row_idx", F.lit(0.0).alias("gain")))
        out.count = count


def _leading(table: pa.Table, wide: int) -> pa.Table:
    """The `wide` rows of highest bound of every block."""
    block, ids = table["block"].to_numpy(), table["row_idx"].to_numpy()
    order = np.lexsort((ids, -np.round(table["bound"].to_numpy(), GAIN_DIGITS), block))
    sorted_ = block[order]
    first = np.searchsorted(sorted_, sorted_, side="left")
    return table.take(pa.array(order[np.arange(len(order)) - first < wide]))
