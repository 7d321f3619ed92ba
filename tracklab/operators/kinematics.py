"""Speed, smoothed velocity, heading and arc length of recorded poses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.plans.segments import SEGMENT_ROWS, bounded, fills

HALF = P.SMOOTH_TAPS // 2


def box_mean(col: str | Column, w: WindowSpec, taps: int = P.SMOOTH_TAPS) -> Column:
    """Centred moving mean padded with zeros: edges still divide by the full width."""
    half = taps // 2
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c).over(w.rowsBetween(-half, half)) / F.lit(float(taps))


def gradient(y: str, t: str, w: WindowSpec) -> Column:
    """Derivative on uneven spacing: second order inside, one-sided at the ends."""
    yp, yn = F.lag(y).over(w), F.lead(y).over(w)
    a = F.col(t) - F.lag(t).over(w)
    b = F.lead(t).over(w) - F.col(t)
    inner = (a * a * yn + (b * b - a * a) * F.col(y) - b * b * yp) / (a * b * (a + b))
    return (
        F.when(a.isNull() & b.isNull(), F.lit(0.0))
        .when(a.isNull(), (yn - F.col(y)) / b)
        .when(b.isNull(), (F.col(y) - yp) / a)
        .otherwise(inner)
    )


def step(w: WindowSpec) -> dict[str, Column]:
    dt = F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(P.NOMINAL_DT_S))
    ds = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return {"dt": dt, "ds": ds, "step_speed": ds / F.greatest(dt, F.lit(P.MIN_DT_S))}


def step_speed(df: DataFrame, keys: Sequence[str], size: int = SEGMENT_ROWS) -> DataFrame:
    return bounded(df, keys, 1, [step], size=size)


def kinematics(df: DataFrame, keys: Sequence[str], size: int = SEGMENT_ROWS) -> DataFrame:
    """``ds``, smoothed ``speed`` and smoothed along-row velocity ``vy`` in one pass."""
    steps = [
        lambda w: {**step(w), "_gy": gradient("y", "t", w)},
        lambda w: {"speed": box_mean("step_speed", w), "vy": box_mean("_gy", w)},
    ]
    return bounded(df, keys, HALF + 1, steps, size=size).drop("_gy")


def heading_rate(df: DataFrame, keys: Sequence[str], size: int = SEGMENT_ROWS) -> DataFrame:
    """Smoothed angular change of the smoothed velocity, zero where the motion is too slow."""

    def turn(w):
        px, py = F.lag("_vx").over(w), F.lag("_vy").over(w)
        cross = px * F.col("_vy") - py * F.col("_vx")
        dot = px * F.col("_vx") + py * F.col("_vy")
        dt = F.greatest(F.col("t") - F.lag("t").over(w), F.lit(P.MIN_DT_S))
        raw = F.coalesce(F.abs(F.atan2(cross, dot)) / dt, F.lit(0.0))
        slow = F.hypot("_vx", "_vy") < P.MIN_HEADING_SPEED_MS
        return {"_hr": F.when(slow, F.lit(0.0)).otherwise(raw)}

    steps = [
        lambda w: {"_gx": gradient("x", "t", w), "_gy": gradient("y", "t", w)},
        lambda w: {"_vx": box_mean("_gx", w), "_vy": box_mean("_gy", w)},
        turn,
        lambda w: {"heading_rate": box_mean("_hr", w)},
    ]
    return bounded(df, keys, 2 * HALF + 2, steps, size=size).drop("_gx", "_gy", "_vx", "_vy", "_hr")


def arc_length(df: DataFrame, keys: Sequence[str], size: int = SEGMENT_ROWS) -> DataFrame:
    """Distance travelled along the given rows of each key, taken in ``i`` order."""
    prev = fills(df, keys, ["i"], before={"_q": F.struct("x", "y")}, size=size, inclusive=False)
    d = F.coalesce(F.hypot(F.col("x") - F.col("_q.x"), F.col("y") - F.col("_q.y")), F.lit(0.0))
    return fills(prev.withColumn("_d", d), keys, ["i"], sums={"pos": F.col("_d")}, size=size).drop("_q", "_d")


def heading_from_track(
    df: DataFrame, keys: Sequence[str], reach: int = 5, min_travel: float = P.MIN_TRAVEL_M, size: int = SEGMENT_ROWS
) -> DataFrame:
    """Bearing of the displacement over +-``reach`` rows; rows with too little travel are left out."""

    def ends(w):
        ahead, back = w.rowsBetween(0, reach), w.rowsBetween(-reach, 0)
        return {
            "hx": F.last("x").over(ahead) - F.first("x").over(back),
            "hy": F.last("y").over(ahead) - F.first("y").over(back),
        }

    out = bounded(df, keys, reach, [ends], size=size)
    out = out.where(F.hypot("hx", "hy") >= min_travel)
    return out.withColumn("bearing", F.degrees(F.atan2("hx", "hy")))


def forward_path(
    df: DataFrame,
    keys: Sequence[str],
    ahead: int = 220,
    reach_m: float = 9.0,
    half_width_m: float | None = None,
    behind_m: float = -0.5,
    size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Upcoming positions in the row's own frame, up to the first one leaving the view box.

    ``heading`` is the row's travel direction in radians.  NULL when fewer than two points remain.
    """

    def collect(w):
        return {"_next": F.collect_list(F.struct("x", "y")).over(w.rowsBetween(0, ahead - 1))}

    out = bounded(df, keys, ahead, [collect], size=size)
    c, s = F.cos("heading"), F.sin("heading")
    x0, y0 = F.col("x"), F.col("y")
    local = F.transform(
        "_next",
        lambda p: F.struct(
            ((p.x - x0) * c + (p.y - y0) * s).alias("X"), ((p.y - y0) * c - (p.x - x0) * s).alias("Y")
        ),
    )
    out = out.withColumn("_local", local)
    wide = (lambda p: F.abs(p.Y) > half_width_m) if half_width_m is not None else (lambda p: F.lit(False))
    leaves = F.transform("_local", lambda p: (p.X > reach_m) | wide(p))
    first = F.array_position(leaves, True)
    kept = F.when(first == 0, F.col("_local")).otherwise(F.slice("_local", 1, F.greatest(first - 1, F.lit(0)).cast("int")))
    kept = F.filter(kept, lambda p: p.X > behind_m)
    return out.withColumn("path", F.when(F.size(kept) >= 2, kept)).drop("_next", "_local")
