"""Parameter sweeps over fits and the rules that select among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.operators.metrics import rms
from tracklab.operators.resampling import block_ci, overlaps
from tracklab.operators.sidefit import POLE, TRUNK, Cell, cell_frames, cell_means

SWEEP_CELLS = ("agnostic",) + tuple(f"{k}_T{t}" for k in ("trunk", "pole") for t in P.CLASS_THRESHOLDS)
SINGLE_CLASS_CELLS = ("trunk_only", "pole_only")
ALL_CELLS = SWEEP_CELLS + SINGLE_CLASS_CELLS


def cell_number(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in ALL_CELLS]), c)


#: A cell prefers one class on a side that has at least T of it and otherwise takes both, the preferred one first.
CELLS = (
    Cell("agnostic", first=TRUNK),
    *[Cell(f"trunk_T{t}", prefer=TRUNK, least=t, first=TRUNK) for t in P.CLASS_THRESHOLDS],
    *[Cell(f"pole_T{t}", prefer=POLE, least=t, first=POLE) for t in P.CLASS_THRESHOLDS],
    Cell("trunk_only", only=TRUNK, first=TRUNK),
    Cell("pole_only", only=POLE, first=POLE),
)


def config_frames(points: DataFrame, keys: Sequence[str], cells: Sequence[Cell] = CELLS) -> DataFrame:
    """Scores of every frame and cell over its seeds, from one shuffle by frame."""
    return cell_means(points, [*keys, "i"], "seed", cells)


def config_summary(per_frame: DataFrame, points: DataFrame, keys: Sequence[str], n_seeds: int = len(P.SEEDS), cells: Sequence[Cell] = CELLS) -> DataFrame:
    """Coverage and error per sweep cell over frames seen by any seed."""
    keys = list(keys)
    full = F.col("two") == n_seeds
    found = per_frame.groupBy(*keys, "cell").agg(
        F.sum("two").alias("_two"),
        F.sum("one").alias("_one"),
        F.sum("base").alias("_base"),
        rms(F.when(full, F.col("o"))).alias("offset_rms"),
        rms(F.when(full, F.col("h"))).alias("heading_rms"),
        F.count_if(full).alias("n_two_row_frames"),
    )
    seen = points.select(*keys, "i").distinct().groupBy(*keys).agg((n_seeds * F.count(F.lit(1))).alias("_tot"))
    grid = seen.withColumn("cell", F.explode(F.array(*[F.lit(c.name) for c in cells])))
    out = grid.join(found, [*keys, "cell"], "left")
    two, one = F.coalesce("_two", F.lit(0)), F.coalesce("_one", F.lit(0))
    return out.select(
        *keys,
        "cell",
        (100.0 * two / F.col("_tot")).alias("two_row_pct"),
        (100.0 * one / F.col("_tot")).alias("single_pct"),
        (100.0 * (F.col("_tot") - two - one) / F.col("_tot")).alias("none_pct"),
        (F.coalesce("_base", F.lit(0)) / F.col("_tot")).alias("mean_base"),
        "offset_rms",
        "heading_rms",
        F.coalesce("n_two_row_frames", F.lit(0)).alias("n_two_row_frames"),
    )


def config_sweep(points: DataFrame, keys: Sequence[str], n_seeds: int = len(P.SEEDS), cells: Sequence[Cell] = CELLS) -> DataFrame:
    return config_summary(config_frames(points, keys, cells), points, keys, n_seeds, cells)


def config_intervals(per_frame: DataFrame, places: DataFrame, lengths: DataFrame, keys: Sequence[str], n_seeds: int = len(P.SEEDS), **options) -> DataFrame:
    """(*keys, cell, metric, n, rms, ci_low, ci_high) over frames that every seed fits.

    ``places`` gives run and position of a frame by the first key, ``lengths`` the block length by that key and metric. The
    draw of a block depends on its run and last frame alone, so all cells are drawn alike and their overlaps compare like draws.
    """
    keys = list(keys)
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("v")) for m, c in (("offset", "o"), ("heading", "h"))])).alias("_m")
    full = per_frame.where(F.col("two") == n_seeds).select(*keys, "cell", "i", stacked).select(*keys, "cell", "i", "_m.*")
    series = full.join(places, [keys[0], "i"]).join(lengths, [keys[0], "metric"])
    got = block_ci(series, [*keys, "cell", "metric"], "rms", **options)
    return got.select(*keys, "cell", "metric", "n", F.col("point").alias("rms"), "ci_low", "ci_high")


def select_config(cells: DataFrame, keys: Sequence[str], floor_pct: float = P.VIABLE_COVERAGE_PCT) -> DataFrame:
    """Lowest error among cells reaching the coverage floor; an overlap with the baseline locks the baseline.

    ``cells`` has ``cell``, ``two_row_pct``, ``rms``, ``ci_low``, ``ci_high``.  Without a viable cell the row says so. ``flat``: the
    intervals of all viable cells overlap one another.
    """
    sweep = cells.where(F.col("cell").isin(*SWEEP_CELLS))
    viable = F.col("two_row_pct") >= floor_pct
    band = F.struct("ci_low", "ci_high")
    got = sweep.groupBy(*keys).agg(
        F.max("two_row_pct").alias("max_two_row_pct"),
        F.count_if(viable).alias("n_viable"),
        F.min_by(
            F.struct("cell", "rms", "ci_low", "ci_high"),
            F.when(viable & F.col("rms").isNotNull(), F.struct("rms", cell_number(F.col("cell")))),
        ).alias("_best"),
        F.max(F.when(F.col("cell") == "agnostic", band)).alias("_base"),
        (F.max(F.when(viable, F.col("ci_low"))) <= F.min(F.when(viable, F.col("ci_high")))).alias("_flat"),
        F.count_if(viable & F.col("ci_low").isNull()).alias("_open"),
    )
    hit = overlaps(F.col("_best.ci_low"), F.col("_best.ci_high"), F.col("_base.ci_low"), F.col("_base.ci_high"))
    some = F.col("_best").isNotNull()
    return got.select(
        *keys,
        "max_two_row_pct",
        "n_viable",
        F.col("_best.cell").alias("argmin"),
        F.col("_best.rms").alias("argmin_rms"),
        F.when(some, hit).alias("overlaps_baseline"),
        F.when(some, F.when(hit, "agnostic").otherwise(F.col("_best.cell"))).alias("locked"),
        F.when(some, F.coalesce(F.col("_flat") & (F.col("_open") == 0), F.lit(False))).alias("flat"),
    )


def with_pause(selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether any metric of a group locks another cell than the baseline, which pauses what follows; null without a viable cell."""
    other = selected.groupBy(*keys).agg(F.max(F.col("locked") != "agnostic").alias("pause"))
    return selected.join(other, list(keys))


def window_frames(points: DataFrame, frame: Sequence[str], grid: Sequence[float] = P.WINDOW_GRID_M) -> DataFrame:
    """Scores of every frame under every near window."""
    got = cell_frames(points, frame, [Cell(str(float(g)), near=float(g)) for g in grid])
    return got.withColumn("win", F.col("cell").cast("double")).drop("cell")


def window_sweep(points: DataFrame, spine: DataFrame, keys: Sequence[str], base_win: float = P.NEAR_M) -> DataFrame:
    """Per seed and near window: coverage, error, frames recovered or lost against the base window."""
    keys = list(keys)
    frame = [*keys, "seed", "i"]
    scored = window_frames(points, frame)
    cols = ["cls", "offset", "heading", "mL", "mR", "n_base"]
    base = F.max(F.when(F.col("win") == base_win, F.struct(*cols))).over(Window.partitionBy(*frame))
    s = scored.select(*frame, "win", *cols).withColumn("_b", base)
    two, was = F.col("cls") == "two_row", F.col("_b.cls") == "two_row"
    back, gone, kept = two & ~was, was & ~two, two & was
    odd = (
        (F.abs("offset") > P.FILTER_OFFSET_M)
        | (F.abs("heading") > P.FILTER_HEADING_DEG)
        | (F.abs(F.col("mL") - F.col("mR")) > P.FILTER_PARALLEL)
        | (F.col("_b.n_base") < P.FILTER_MIN_POINTS)
    )
    g = s.groupBy(*keys, "seed", "win").agg(
        F.count_if(two).alias("two"),
        F.count_if(was).alias("base_two"),
        F.count_if(back).alias("recovered"),
        F.count_if(gone).alias("lost"),
        F.count_if(back & odd).alias("odd"),
        rms(F.when(two, F.col("offset"))).alias("full_rms"),
        rms(F.when(back, F.col("offset"))).alias("recovered_rms"),
        F.avg(F.when(kept, F.abs(F.col("offset") - F.col("_b.offset")))).alias("shift_mean"),
        F.max(F.when(kept, F.abs(F.col("offset") - F.col("_b.offset")))).alias("shift_max"),
        F.count_if(kept).alias("kept"),
    )
    total = spine.groupBy(*keys, "seed").agg(F.count(F.lit(1)).alias("frames"))
    return total.join(g, [*keys, "seed"])


def window_shifts(points: DataFrame, keys: Sequence[str], base_win: float = P.NEAR_M) -> DataFrame:
    """Absolute offset change against the base window for frames fitted under both."""
    frame = [*keys, "seed", "i"]
    scored = window_frames(points, frame).where("cls = 'two_row'").select(*frame, "win", "offset")
    base = F.max(F.when(F.col("win") == base_win, F.col("offset"))).over(Window.partitionBy(*frame))
    out = scored.withColumn("_b", base).where("_b is not null")
    return out.select(*keys, "seed", "i", "win", F.abs(F.col("offset") - F.col("_b")).alias("shift"))


def window_summary(per_seed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seed means of the sweep's rates."""
    one = F.lit(1)
    return per_seed.groupBy(*keys, "win").agg(
        F.avg(100.0 * F.col("two") / F.greatest("frames", one)).alias("two_row_pct"),
        F.avg("full_rms").alias("full_rms"),
        F.avg(100.0 * F.col("recovered") / F.greatest(F.col("frames") - F.col("base_two"), one)).alias("recovery_pct"),
        F.avg("recovered_rms").alias("recovered_rms"),
        F.avg(100.0 * F.col("lost") / F.greatest("base_two", one)).alias("lost_pct"),
        F.avg(100.0 * F.col("odd") / F.greatest("recovered", one)).alias("odd_pct"),
        (F.sum(F.col("shift_mean") * F.col("kept")) / F.sum("kept")).alias("shift_mean"),
        F.max("shift_max").alias("shift_max"),
    )


def window_optimum(summary: DataFrame, keys: Sequence[str], tolerance: float = 0.10, base_win: float = P.NEAR_M) -> DataFrame:
    """Largest window within an error tolerance, and the last one whose coverage gain keeps pace with its loss.

    The windows of a key are the fixed sweep grid, so the windows used here are of that size.
    """
    w = Window.partitionBy(*keys).orderBy("win")
    s = summary.withColumn("_base", F.max(F.when(F.col("win") == base_win, F.col("full_rms"))).over(Window.partitionBy(*keys)))
    gain = F.col("two_row_pct") - F.lag("two_row_pct").over(w)
    loss = 100.0 * (F.col("full_rms") - F.lag("full_rms").over(w))
    pays = F.coalesce(gain >= F.greatest(loss, F.lit(0.0)), F.lag("win").over(w).isNull())
    s = s.withColumn("_pays", pays.cast("int"))
    s = s.withColumn("_all", F.min("_pays").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    within = F.col("full_rms") <= F.col("_base") * (1 + tolerance)
    return s.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(within, F.col("win"))), F.lit(base_win)).alias("optimum_a"),
        F.max(F.when(F.col("_all") == 1, F.col("win"))).alias("optimum_b"),
    )


def threshold_sweep(elements: DataFrame, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """IoU per frame and confidence threshold.

    ``elements``: one row per (frame, element) with ``conf``, the highest confidence of a detection covering
    it (NULL when none does), and ``truth``.  Counting per threshold needs each element once, not once per
    threshold: counts per confidence band are formed first and accumulated over the fixed grid.
    """
    g = sorted(float(t) for t in grid)
    level = F.size(F.filter(F.array(*[F.lit(t) for t in g]), lambda t: t <= F.col("conf")))
    banded = elements.withColumn("_l", F.when(F.col("conf").isNull(), 0).otherwise(level))
    per = banded.groupBy(*keys).agg(
        F.count_if("truth").alias("_gt"),
        *[F.count_if((F.col("_l") > n) & F.col("truth")).alias(f"_i{n}") for n in range(len(g))],
        *[F.count_if(F.col("_l") > n).alias(f"_p{n}") for n in range(len(g))],
    )
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("threshold"),
                    F.try_divide(F.col(f"_i{n}"), F.col(f"_p{n}") + F.col("_gt") - F.col(f"_i{n}")).alias("iou"),
                )
                for n, t in enumerate(g)
            ]
        )
    )
    return per.select(*keys, cells.alias("_c")).select(*keys, "_c.*")


def threshold_curve(per_frame: DataFrame, keys: Sequence[str], catastrophic: float = 0.1) -> DataFrame:
    return per_frame.groupBy(*keys, "threshold").agg(
        F.avg("iou").alias("mean_iou"), F.count_if(F.col("iou") < catastrophic).alias("n_catastrophic"), F.count("iou").alias("n")
    )


def best_threshold(curve: DataFrame, keys: Sequence[str], by: str = "mean_iou") -> DataFrame:
    """First threshold with the highest value."""
    return curve.groupBy(*keys).agg(
        F.max_by("threshold", F.struct(by, -F.col("threshold"))).alias("threshold"), F.max(by).alias("value")
    )


def calibrate_threshold(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decision threshold one above the highest negative control, and what it separates."""
    neg, pos, unk = (F.col("role") == r for r in ("negative", "positive", "unknown"))
    got = scores.groupBy(*keys).agg(
        F.max(F.when(neg, F.col("score"))).alias("max_negative"),
        F.min(F.when(pos, F.col("score"))).alias("min_positive"),
        F.count_if(unk).alias("n_unknown"),
    )
    got = got.withColumn("threshold", F.coalesce("max_negative", F.lit(0)) + 1)
    got = got.withColumn("separates", F.col("min_positive") > F.col("max_negative"))
    above = scores.where(unk).join(got.select(*keys, "threshold"), list(keys)).where("score >= threshold")
    n = above.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_above"))
    return got.join(n, list(keys), "left").withColumn("n_above", F.coalesce("n_above", F.lit(0)))


def assumption_sweep(errors: DataFrame, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """RMS after adding each constant shift to every error, from n, sum and sum of squares only."""
    s = errors.groupBy(*keys).agg(
        F.count("e").alias("_n"), F.sum("e").alias("_s"), F.sum(F.col("e") * F.col("e")).alias("_q")
    )
    s = s.withColumn("shift", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    sq = F.col("_q") + 2 * F.col("shift") * F.col("_s") + F.col("_n") * F.col("shift") * F.col("shift")
    return s.select(*keys, "shift", F.sqrt(F.greatest(sq, F.lit(0.0)) / F.col("_n")).alias("rms"))


def linear_r2(rows: DataFrame, keys: Sequence[str], y: str, a: str, b: str) -> DataFrame:
    """Best R2 of ``y`` on two regressors and a constant, from second moments."""
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr(y, a).alias(f"corr_{a}"),
        F.corr(y, b).alias(f"corr_{b}"),
        F.var_pop(a).alias("_aa"),
        F.var_pop(b).alias("_bb"),
        F.covar_pop(a, b).alias("_ab"),
        F.covar_pop(y, a).alias("_ya"),
        F.covar_pop(y, b).alias("_yb"),
        F.var_pop(y).alias("_yy"),
    )
    det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
    top = (
        F.col("_ya") * F.col("_ya") * F.col("_bb")
        - 2 * F.col("_ya") * F.col("_yb") * F.col("_ab")
        + F.col("_yb") * F.col("_yb") * F.col("_aa")
    )
    explained = F.try_divide(top, det)
    return m.select(
        *keys,
        "n",
        f"corr_{a}",
        f"corr_{b}",
        F.try_divide(explained, F.col("_yy")).alias("r2"),
        F.sqrt(F.greatest(F.col("_yy") - explained, F.lit(0.0))).alias("resid_rms"),
        F.sqrt("_yy").alias("reference_std"),
    )
