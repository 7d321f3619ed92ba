"""Side fits of many sweep cells from one sorted point array per frame.

Sweeps fit the same points again and again: with another near window, or with one class preferred. Points are shuffled once by
frame and travel as one array per frame. A task lays the arrays of a batch end to end, sorted by side and lateral position, and
answers every cell from them: members of a cell are a mask, how many of them lie in an interval is a difference of the mask's
prefix counts at two places, and their median is a pick among the mask's positions. Places come from binary searches for all
sides of the batch at once, so there are no loops over frames or points, and points are never multiplied by cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklab import params as P
from tracklab.plans.segments import spread

TRUNK, POLE = 0, 1
CLASSES = ("none", "single_row", "two_row")


@dataclass(frozen=True)
class Cell:
    """One way to fit a frame: near window, class preference, and which class comes first among equals."""

    name: str
    near: float = P.NEAR_M
    #: A side with ``least`` points of this class uses them alone, any other side uses all.
    prefer: int | None = None
    least: int = 1
    #: Only this class takes part.
    only: int | None = None
    #: Class that comes first among equally dense points; without one the detection order decides.
    first: int | None = None


class Sides:
    """Points of a batch sorted by (frame, side, Y); sides without points have no entry."""

    def __init__(self, frame: np.ndarray, left: np.ndarray, x: np.ndarray, y: np.ndarray, x_bin: np.ndarray, kind: np.ndarray, frames: int):
        side = 2 * frame + ~left
        order = np.lexsort((y, side))
        self.frames, self.rank = frames, order
        self.side, self.x, self.y, self.kind = side[order], x[order], y[order], kind[order]
        self.starts = np.flatnonzero(np.diff(self.side, prepend=-1))
        self.ends = np.append(self.starts[1:], self.side.size)
        self.group = np.repeat(np.arange(self.starts.size), self.ends - self.starts)
        # Distinct x bins: runs of equal (side, bin).
        by_bin = np.lexsort((x_bin[order], self.side))
        s, b = self.side[by_bin], x_bin[order][by_bin]
        self.by_bin, self.bin_starts = by_bin, np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (b[1:] != b[:-1]))[: s.size])
        self.bin_group = self.group[by_bin][self.bin_starts]
        # Neighbourhood of every point, whatever the cell.
        lo, hi = self.starts[self.group], self.ends[self.group]
        below, above = self.y - P.SEED_HALF_M, self.y + P.SEED_HALF_M
        self.lo = self.search(lo, hi, lambda k: self.y[k] >= below)
        self.hi = self.search(lo, hi, lambda k: self.y[k] > above)

    def search(self, lo: np.ndarray, hi: np.ndarray, holds: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """First place in [lo, hi) at which ``holds``, which stays true from there on; hi if there is none."""
        lo, hi = lo.copy(), hi.copy()
        while (on := lo < hi).any():
            middle = (lo + hi) // 2
            found = holds(np.minimum(middle, self.y.size - 1))
            hi = np.where(on & found, middle, hi)
            lo = np.where(on & ~found, middle + 1, lo)
        return lo

    def around(self, centre: np.ndarray, half: float, closed: bool) -> tuple[np.ndarray, np.ndarray]:
        """Per side the places [lo, hi) of points within ``half`` of its centre; none where the centre is missing."""
        gap = lambda k: self.y[k] - centre
        if closed:
            lo = self.search(self.starts, self.ends, lambda k: gap(k) >= -half)
            return lo, np.maximum(lo, self.search(self.starts, self.ends, lambda k: gap(k) > half))
        lo = self.search(self.starts, self.ends, lambda k: gap(k) > -half)
        return lo, np.maximum(lo, self.search(self.starts, self.ends, lambda k: gap(k) >= half))

    def count(self, mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), self.starts)

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)

    def median(self, mask: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Median Y of the masked points of every side, or of those in [lo, hi); NaN where there are none."""
        upto = np.append(0, np.cumsum(mask))
        a, b = upto[self.starts if lo is None else lo], upto[self.ends if hi is None else hi]
        picked = self.y[np.flatnonzero(mask)]
        out = np.full(self.starts.size, np.nan)
        some = b > a
        out[some] = 0.5 * picked[(a + b - 1)[some] // 2] + 0.5 * picked[(a + b)[some] // 2]
        return out


def fit(sides: Sides, cell: Cell) -> dict[str, np.ndarray]:
    """Accepted flag, line, counts and adjacent flag of every side with points."""
    g, y, x = sides.group, sides.y, sides.x
    member = np.ones(y.size, bool)
    if cell.only is not None:
        member = sides.kind == cell.only
    elif cell.prefer is not None:
        member = (sides.kind == cell.prefer) | (sides.count(sides.kind == cell.prefer) < cell.least)[g]
    near = member & (x < cell.near)
    upto = np.append(0, np.cumsum(near))
    # Densest near point, first in the cell's order among equals: one maximum over a combined number.
    place = sides.rank if cell.first is None else sides.rank + y.size * (sides.kind != cell.first)
    span = 2 * y.size
    best = np.maximum.reduceat(np.where(near, (upto[sides.hi] - upto[sides.lo]) * span + (span - 1 - place), -1), sides.starts)
    at_place = np.zeros(span, np.int64)
    at_place[place] = np.arange(y.size)
    dense = np.where(best >= 0, y[at_place[span - 1 - best % span]], np.nan)
    seed = sides.median(near, *sides.around(dense, P.SEED_HALF_M, True))
    most, shift = np.full(seed.size, -1), np.zeros(seed.size)
    for k in range(P.SWEEP_STEPS):
        s = -P.SWEEP_SPAN_M + P.SWEEP_STEP_M * k
        lo, hi = sides.around(seed + s, P.INLIER_M, False)
        hits = upto[hi] - upto[lo]
        shift = np.where(hits > most, s, shift)
        most = np.maximum(most, hits)
    inner = near & (np.abs(y - (seed + shift)[g]) < P.INLIER_M)
    near_y = sides.median(inner)
    inl = inner | (member & ~near & (x <= P.FAR_M) & (np.abs(y - near_y[g]) <= P.FAR_TOL_M))
    row_y = sides.median(inl)
    outer = member & ~inl & (np.sign(y) == np.sign(row_y)[g]) & (np.abs(y) > np.abs(row_y)[g] + (P.INLIER_M + P.ADJACENT_GAP_M))
    n = sides.count(inl)
    far_x = np.maximum.reduceat(np.where(inl, x, -np.inf), sides.starts)
    low_x = np.minimum.reduceat(np.where(inl, x, np.inf), sides.starts)
    held_bins = np.logical_or.reduceat(inl[sides.by_bin], sides.bin_starts)
    n_x = np.bincount(sides.bin_group, held_bins, seed.size)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean_x, mean_y = sides.total(np.where(inl, x, 0.0)) / n, sides.total(np.where(inl, y, 0.0)) / n
        dx, dy = np.where(inl, x - mean_x[g], 0.0), np.where(inl, y - mean_y[g], 0.0)
        slope = sides.total(dx * dy) / sides.total(dx * dx)
    ok = (sides.count(near) >= 2) & (n >= P.MIN_POINTS) & (np.abs(row_y) <= P.MAX_ABS_Y_M)
    ok &= (far_x - low_x >= P.MIN_X_SPAN_M) & (n_x >= P.MIN_DISTINCT_X)
    return {"ok": ok, "slope": slope, "icept": mean_y - slope * mean_x, "n_raw": sides.count(member), "adjacent": ok & (sides.count(outer) >= 3)}


def frames(sides: Sides, cell: Cell) -> dict[str, np.ndarray]:
    """Class (as its place in ``CLASSES``), centre line and counts of every frame of the batch."""
    got = fit(sides, cell)
    owner = sides.side[sides.starts]

    def wide(name: str, empty: float) -> tuple[np.ndarray, np.ndarray]:
        both = np.full(2 * sides.frames, empty, got[name].dtype)
        both[owner] = got[name]
        return both[0::2], both[1::2]

    (ok_l, ok_r), (m_l, m_r), (b_l, b_r) = wide("ok", False), wide("slope", np.nan), wide("icept", np.nan)
    (n_l, n_r), (a_l, a_r) = wide("n_raw", 0), wide("adjacent", False)
    two = ok_l & ok_r
    fitted = lambda v: np.where(two, v, np.nan)
    return {
        "cls": np.where(two, 2, (ok_l | ok_r).astype(int)),
        "offset": fitted((m_l * P.LOOK_M + b_l + (m_r * P.LOOK_M + b_r)) / 2),
        "heading": fitted(np.degrees(np.arctan((m_l + m_r) / 2))),
        "mL": fitted(m_l),
        "mR": fitted(m_r),
        "n_base": n_l + n_r,
        "adj": a_l.astype(np.int64) + a_r,
    }


def packed(points: DataFrame, frame: Sequence[str], seed: str | None = None) -> DataFrame:
    """One row per frame with its points in detection order. With ``seed``, that column stays inside the points."""
    kind = F.col("kind").cast("int") if "kind" in points.columns else F.lit(0)
    point = [F.col("o").alias("o"), (F.col("side") == "L").alias("left"), F.col("X").cast("double").alias("x"), F.col("Y").cast("double").alias("y"), F.bround(F.col("X").cast("double"), 1).alias("x_bin"), kind.alias("kind")]
    point += [(F.col(seed) if seed else F.lit(0)).cast("long").alias("seed")]
    rows = points.where("side is not null and X is not null and Y is not null").select(*frame, F.struct(*point).alias("p"))
    return spread(rows, *frame).groupBy(*frame).agg(F.array_sort(F.collect_list("p")).alias("points")).withColumn("points", F.transform("points", lambda p: p.dropFields("o")))


def _unpack(column: pa.ListArray) -> tuple[np.ndarray, Sides]:
    """(row of the batch, sides) with one frame per (row, seed)."""
    p = column.flatten()
    value = {f.name: np.asarray(p.field(k).to_numpy(zero_copy_only=False)) for k, f in enumerate(p.type)}
    row = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths()))
    units, number = np.unique(np.stack([row, value["seed"]]), axis=1, return_inverse=True)
    return units[0], Sides(number.ravel(), value["left"].astype(bool), value["x"], value["y"], value["x_bin"], value["kind"], units.shape[1])


FRAME_FIELDS = [
    *[T.StructField(c, T.DoubleType()) for c in ("offset", "heading", "mL", "mR")],
    *[T.StructField(c, T.LongType()) for c in ("n_base", "adj")],
]


def _numbers(values: np.ndarray) -> pa.Array:
    return pa.array(values, from_pandas=True)


def _run(df: DataFrame, keep: Sequence[str], fields: Sequence[T.StructField], cells: Sequence[Cell], work: Callable[[np.ndarray, Sides, Cell], tuple[np.ndarray, list]]) -> DataFrame:
    """``work`` gives, for one cell, the rows of the batch that its output rows belong to, and their columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*[df.schema[c] for c in keep], T.StructField("cell", T.StringType()), *fields])
    schema, names, cells = to_arrow_schema(out), list(keep), list(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, sides = _unpack(batch.column("points"))
            for cell in cells:
                owner, columns = work(row, sides, cell)
                taken = pa.array(owner)
                made = [*[batch.column(c).take(taken) for c in names], pa.repeat(cell.name, len(owner)), *columns]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(made, schema)], names=schema.names)

    return df.mapInArrow(run, out)


def cell_frames(points: DataFrame, frame: Sequence[str], cells: Sequence[Cell]) -> DataFrame:
    """(*frame, cell, cls, offset, heading, mL, mR, n_base, adj) of every frame with points that take part in the cell."""

    def work(row: np.ndarray, sides: Sides, cell: Cell) -> tuple[np.ndarray, list]:
        got = frames(sides, cell)
        some = got["n_base"] > 0
        classes = pa.array(CLASSES).take(pa.array(got["cls"][some]))
        return row[some], [classes, *[_numbers(got[f.name][some]) for f in FRAME_FIELDS]]

    return _run(packed(points, frame), frame, [T.StructField("cls", T.StringType()), *FRAME_FIELDS], cells, work)


def cell_means(points: DataFrame, frame: Sequence[str], seed: str, cells: Sequence[Cell]) -> DataFrame:
    """(*frame, cell, two, one, base, o, h): over the seeds of a frame, how many saw two rows or one, their points, and the mean centre line."""
    fields = [*[T.StructField(c, T.LongType()) for c in ("two", "one", "base")], *[T.StructField(c, T.DoubleType()) for c in ("o", "h")]]

    def work(row: np.ndarray, sides: Sides, cell: Cell) -> tuple[np.ndarray, list]:
        got = frames(sides, cell)
        n = int(row.max()) + 1
        two = np.bincount(row, got["cls"] == 2, n).astype(np.int64)
        one = np.bincount(row, got["cls"] == 1, n).astype(np.int64)
        base = np.bincount(row, got["n_base"], n).astype(np.int64)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = [np.bincount(row, np.nan_to_num(got[c]), n) / two for c in ("offset", "heading")]
        some = np.flatnonzero(base > 0)
        return some, [_numbers(v[some]) for v in (two, one, base, *mean)]

    return _run(packed(points, frame, seed), frame, fields, cells, work)
