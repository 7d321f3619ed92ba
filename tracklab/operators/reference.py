"""Errors against surveyed lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.functions.geometry import enu_to_view, signed_perp, wrap_fold
from tracklab.operators.metrics import rms
from tracklab.operators.paired import sign_of
from tracklab.session import stored


#: (bits of a level's cells over the finest, bits from there to the cells above); the top has four cells, one per quadrant.
LEVELS = ((32, 30), (16, 16), (8, 8), (4, 4), (0, 4))
LINE = ["line_id", "ax", "ay", "bx", "by"]


def _cells(spots: DataFrame, lines: DataFrame, cell: float, reach: float) -> DataFrame:
    """Occupied cells that a line, prolonged, passes within ``reach``: found from coarse cells down.

    Only cells that hold points exist on any level, so the work follows the data, not the extent of its coordinates; a cell is
    looked into only by lines that pass its parent.
    """
    quadrant = F.sequence(F.lit(-1).cast("long"), F.lit(0).cast("long"))
    long = lines.where("ax <> bx or ay <> by")
    near = long.select(*LINE, F.explode(quadrant).alias("_ux")).select("*", F.explode(quadrant).alias("_uy"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    for bits, up in LEVELS:
        held = spots.select(F.shiftright("_cx", bits).alias("_cx"), F.shiftright("_cy", bits).alias("_cy")).distinct() if bits else spots
        below = held.withColumns({"_ux": F.shiftright("_cx", up), "_uy": F.shiftright("_cy", up)})
        size = cell * 2.0**bits
        x, y = (F.col("_cx") + 0.5) * size, (F.col("_cy") + 0.5) * size
        off = F.abs((x - F.col("ax")) * dy - (y - F.col("ay")) * dx) / F.hypot(dx, dy)
        slack = 0.70711 * size + 1e-9 * (F.abs(x) + F.abs(y))
        near = near.join(below, ["_ux", "_uy"]).where(off <= reach + slack).select(*LINE, F.col("_cx").alias("_ux"), F.col("_cy").alias("_uy"))
    return near.withColumnsRenamed({"_ux": "_cx", "_uy": "_cy"})


def nearest_line(points: DataFrame, lines: DataFrame, reach: float = P.LINE_REACH_M) -> DataFrame:
    """Nearest line by absolute signed offset within ``reach``; ties go to the lower line id.

    Points look up the lines of their own grid cell: an equi-join instead of all pairs. ``points`` need a unique ``i`` with
    ``px, py`` and travel ``hx, hy``; the offset changes sign when travelling along the stored direction of the line. A point
    without a finite position, and a line without length, match nothing.
    """
    cell = 2 * reach
    known = (F.abs("px") < 1e18) & (F.abs("py") < 1e18) & ~F.isnan("px") & ~F.isnan("py")
    p = points.where(known).withColumns({"_cx": F.floor(F.col("px") / cell), "_cy": F.floor(F.col("py") / cell)})
    spots = stored(p.select("_cx", "_cy").distinct())
    m = p.join(_cells(spots, lines, cell, reach), ["_cx", "_cy"])
    m = m.withColumn("_s", signed_perp(*[F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")]))
    m = m.where(F.abs("_s.off") <= reach)
    along = F.col("hx") * (F.col("bx") - F.col("ax")) + F.col("hy") * (F.col("by") - F.col("ay")) > 0
    m = m.withColumn("_t", F.when(along, -F.col("_s.off")).otherwise(F.col("_s.off")))
    pick = F.struct(
        "line_id", F.col("_t").alias("true_offset"), F.col("_s.bearing").alias("line_bearing"), "ax", "ay", "bx", "by"
    )
    first = [F.first(c).alias(c) for c in points.columns if c != "i"]
    g = m.groupBy("i").agg(*first, F.min_by(pick, F.struct(F.abs("_s.off"), "line_id")).alias("_b"))
    return g.select(*points.columns, "_b.*")


def with_truth(scores: DataFrame, truth: DataFrame, key: Sequence[str]) -> DataFrame:
    """Offset and heading error of each fitted row that has a usable reference."""
    t = truth.where(F.hypot("hx", "hy") >= P.MIN_TRAVEL_M)
    robot = F.degrees(F.atan2("hx", "hy"))
    want = wrap_fold(F.col("line_bearing"), robot + 180.0)
    t = t.select(*key, "line_id", "true_offset", want.alias("want"))
    out = scores.where((F.col("cls") == "two_row") & F.col("offset").isNotNull()).join(t, list(key))
    return out.withColumns(
        {"error": F.col("offset") - F.col("true_offset"), "heading_error": F.col("heading") - F.col("want")}
    )


def referenced_error(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        rms("error").alias("rms"),
        F.avg("error").alias("mean"),
        rms("offset").alias("zero_ref_rms"),
        rms("heading_error").alias("heading_rms"),
        F.avg("heading_error").alias("heading_mean"),
    )


def line_residuals(rows: DataFrame, min_rows: int = P.MIN_LINE_ROWS) -> DataFrame:
    g = rows.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean"), F.stddev_pop("error").alias("std")
    )
    return g.where(F.col("n") >= min_rows)


def reference_quality(per_line: DataFrame) -> DataFrame:
    """Spread of line means against the scatter within lines."""
    return per_line.agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("mean").alias("lowest"),
        F.max("mean").alias("highest"),
        F.stddev_pop("mean").alias("between"),
        F.avg("std").alias("within"),
    )


def paired_referenced(rows: DataFrame) -> DataFrame:
    """Paired differences per seed on frames with a reference, pooled, with the sign under each seed."""
    wide = rows.groupBy("seed", "i").agg(*[F.max(F.when(F.col("arm") == a, F.col("offset"))).alias(a) for a in P.ARMS])
    made = [
        F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col(a) - F.col(b)).alias("d")))
        for a, b in P.PAIRS
    ]
    d = wide.select("seed", F.explode(F.array_compact(F.array(*made))).alias("_p")).select("seed", "_p.*")
    per = d.groupBy("pair", "seed").agg(F.count(F.lit(1)).alias("_n"), F.sum("d").alias("_s"))
    per = per.withColumn("sign", sign_of(F.round(F.col("_s") / F.col("_n"), 12)))
    signs = F.transform(F.array_sort(F.collect_list(F.struct("seed", "sign"))), lambda s: s.sign)
    g = per.groupBy("pair").agg(F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("mean_diff"), signs.alias("_g"))
    return g.select("pair", "n", "mean_diff", F.array_join("_g", " ").alias("signs"), (F.size(F.array_distinct("_g")) == 1).alias("consistent"))


# fixed values: error budget of the assumed mounting and of the reference, in metres
INNER_BAND_M, REFERENCE_BAND_M = 0.182, 0.130


def within_budget(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of rows inside the inner band and inside the sum of both bands."""
    e = F.abs("error")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (100.0 * F.avg((e <= INNER_BAND_M).cast("int"))).alias("inner_pct"),
        (100.0 * F.avg((e <= INNER_BAND_M + REFERENCE_BAND_M).cast("int"))).alias("summed_pct"),
    )


def _samples_inside(lo: Column, hi: Column, unsure: Column, first: float, step: float, n: int, seen) -> Column:
    """How many of ``n`` evenly spaced parameters fall into [lo, hi], by ``seen`` at its ends.

    The samples next to an end are looked at themselves, since rounding decides there; where it may decide along the whole
    line (``unsure``), all are.
    """
    a, b = (F.least(F.greatest((end - first) / step, F.lit(-2.0)), F.lit(n + 1.0)) for end in (lo, hi))
    a, b = F.ceil(a), F.floor(b)
    near = F.array_distinct(F.array(*[end + k for end in (a, b) for k in (-1, 0, 1)]))
    asked = F.when(unsure, F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).otherwise(F.filter(near, lambda k: (k >= 0) & (k < n)))
    inner = F.greatest(F.least(b - 2, F.lit(n - 1)) - F.greatest(a + 2, F.lit(0)) + 1, F.lit(0))
    return F.size(F.filter(asked, lambda k: seen(F.lit(first) + k * F.lit(step)))) + F.when(unsure, 0).otherwise(inner)


def line_in_view(rows: DataFrame, x_low: float, x_high: float, half_width: float = 4.0) -> DataFrame:
    """Sample points of each row's line inside the camera's ground window; points on its sides are outside.

    Position along the line is linear in its parameter, so the visible stretch is an interval and the
    samples in it are counted rather than generated.
    """
    bearing = F.degrees(F.atan2("hx", "hy"))
    a = enu_to_view(F.col("ax"), F.col("ay"), F.col("px"), F.col("py"), bearing)
    b = enu_to_view(F.col("bx"), F.col("by"), F.col("px"), F.col("py"), bearing)
    h = F.radians(bearing)
    r = rows.withColumns({"_a": a, "_b": b, "_sin": F.sin(h), "_cos": F.cos(h)})
    r = r.withColumns({"_dx": F.col("_b.X") - F.col("_a.X"), "_dy": F.col("_b.Y") - F.col("_a.Y")})
    size = sum((F.abs(c) for c in ("ax", "ay", "bx", "by", "px", "py")), F.lit(1.0))

    def span(start: Column, d: Column, lo: float, hi: float):
        t0, t1 = (lo - start) / d, (hi - start) / d
        return F.least(t0, t1), F.greatest(t0, t1)

    def seen(t: Column) -> Column:
        x = F.col("ax") + t * (F.col("bx") - F.col("ax")) - F.col("px")
        y = F.col("ay") + t * (F.col("by") - F.col("ay")) - F.col("py")
        ahead, aside = -(x * F.col("_sin") + y * F.col("_cos")), x * F.col("_cos") - y * F.col("_sin")
        return (ahead >= x_low) & (ahead <= x_high) & (F.abs(aside) < half_width)

    r = r.withColumn("_unsure", F.least(F.abs("_dx"), F.abs("_dy")) <= 1e-9 * size)
    sure = lambda d: F.when(~F.col("_unsure"), F.col(d))
    l1, h1 = span(F.col("_a.X"), sure("_dx"), x_low, x_high)
    l2, h2 = span(F.col("_a.Y"), sure("_dy"), -half_width, half_width)
    r = r.withColumns({"_lo": F.greatest(l1, l2), "_hi": F.least(h1, h2)})
    ends = F.col("_lo"), F.col("_hi"), F.col("_unsure")
    return r.withColumns(
        {
            "n_segment": _samples_inside(*ends, 0.0, 1.0 / 199, 200, seen).cast("bigint"),
            "n_extended": _samples_inside(*ends, -1.5, 4.0 / 399, 400, seen).cast("bigint"),
        }
    ).drop("_a", "_b", "_sin", "_cos", "_dx", "_dy", "_unsure", "_lo", "_hi")


def view_shares(rows: DataFrame, more_than: int = 3) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("n_segment") > more_than).alias("segment"),
        F.count_if(F.col("n_extended") > more_than).alias("extended"),
    )
