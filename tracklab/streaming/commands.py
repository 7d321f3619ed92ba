"""The command law on arriving rows.

One state per (rec, arm, seed, pass_id): time and values of the last row and the last fresh one. The rows of a stream in a
micro-batch are put in time order and evaluated as arrays, with the same helpers as the batch operators; a row at the time of
the last one is kept, with the nominal step, and an older one is dropped and counted on the next row that leaves.
Rows behind the watermark are removed by Spark before they get here and are not in that count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.operators.commands import _follow, frozen_integral

STREAM = ["rec", "arm", "seed", "pass_id"]
STATE = (
    "t DOUBLE, command DOUBLE, have BOOLEAN, off DOUBLE, off_t DOUBLE, integral DOUBLE, ramp DOUBLE, hold_run BIGINT, "
    "last_valid_i BIGINT, late BIGINT"
)
OUTPUT = (
    "rec BIGINT, arm STRING, seed BIGINT, pass_id BIGINT, i BIGINT, t DOUBLE, source STRING, hold_reason STRING, "
    "hold_run BIGINT, last_valid_i BIGINT, omega_cmd DOUBLE, omega_cmd_ramp DOUBLE, saturated BOOLEAN, late_dropped BIGINT"
)
START = (None, 0.0, False, None, None, 0.0, 0.0, 0, -1, 0)


def _last_before(fresh: np.ndarray, inclusive: bool) -> np.ndarray:
    """Position of the latest fresh row at or before (or strictly before) each row, -1 if none."""
    seen = np.maximum.accumulate(np.where(fresh, np.arange(fresh.size), -1))
    return seen if inclusive else np.concatenate([[-1], seen[:-1]])


def law(rows: pd.DataFrame, state: dict, kd: float, ki: float) -> tuple[pd.DataFrame, dict]:
    """(output columns, next state) for one stream's rows in time order."""
    n = len(rows)
    col = {c: rows[c].to_numpy(dtype=float, na_value=np.nan) for c in ("t", "vx", "v_min", "offset", "heading", "kp", "kpsi", "omega_max", "slew_rate")}
    idle, gate = rows["abstained"].to_numpy(dtype=bool), ~(col["vx"] > col["v_min"])
    fresh = ~(idle | gate)
    step = np.diff(col["t"], prepend=np.nan if state["t"] is None else state["t"])
    dt = np.where(step > 0, step, P.NOMINAL_DT_S)
    # Fresh rows alone carry the law; the fresh row before the first of them is in the state.
    at = np.flatnonzero(fresh)
    off, when = col["offset"][at], col["t"][at]
    known = state["off"] is not None
    d_off, d_t = np.diff(off, prepend=state["off"] if known else np.nan), np.diff(when, prepend=state["off_t"] if known else np.nan)
    rate = np.divide(d_off, d_t, out=np.zeros(at.size), where=d_t > 0)
    base = col["kp"][at] * off + col["kpsi"][at] * (col["heading"][at] - P.TILT_DEG) + kd * rate
    top = col["omega_max"][at]
    total = frozen_integral(base[None, :], np.array([ki]), off * dt[at], top, np.array([state["integral"]]))[0] if at.size else np.zeros(0)
    before = np.concatenate([[state["integral"]], total[:-1]]) if at.size else total
    made = np.clip(base + ki * total, -top, top)
    # Every row repeats the latest command.
    latest = np.cumsum(fresh) - 1
    pick = lambda new, old: np.where(latest >= 0, np.append(new, old)[latest], old)  # noqa: E731  latest of -1 is the appended old one
    cmd = pick(made, state["command"])
    have = (latest >= 0) | bool(state["have"])
    saturated = have & (np.abs(cmd) >= col["omega_max"] - 1e-9)
    saturated[at] = np.abs(base + ki * (before + off * dt[at])) > top
    since = np.arange(n) - _last_before(fresh, True)
    run = np.where(latest >= 0, since, np.arange(1, n + 1) + state["hold_run"])
    valid = pick(rows["i"].to_numpy()[at], state["last_valid_i"]).astype(np.int64)
    ramp = _follow(state["ramp"], cmd, col["slew_rate"] * dt)
    reason = np.select([fresh, idle & gate, idle], ["", "both", "abstain"], "state_gate")
    out = pd.DataFrame(
        {"i": rows["i"].to_numpy(), "t": col["t"], "source": np.where(fresh, "fresh", "held"), "hold_reason": reason, "hold_run": run, "last_valid_i": valid, "omega_cmd": cmd, "omega_cmd_ramp": ramp, "saturated": saturated}
    )
    following = dict(state, t=float(col["t"][-1]), command=float(cmd[-1]), have=bool(have[-1]), ramp=float(ramp[-1]), hold_run=int(run[-1]), last_valid_i=int(valid[-1]))
    if at.size:
        following |= {"off": float(off[-1]), "off_t": float(when[-1]), "integral": float(total[-1])}
    return out, following


def stream_commands(
    rows: DataFrame, kd: float = 0.0, ki: float = 0.0, delay: str = "10 minutes", idle: str = "1 hour"
) -> DataFrame:
    """Commands for a streaming DataFrame of scored rows.

    ``rows`` carry ``event_time``, the columns of ``to_streams`` and the recording's gains.  State is dropped once
    the watermark has passed ``idle`` beyond a stream's last row.
    """
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    fields = [c.split()[0] for c in STATE.split(", ")]
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def handle(key, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(fields, state.get if state.exists else START))
        arrived = pd.concat(list(batches)).sort_values(["t", "i"])
        late = arrived["t"] < held["t"] if held["t"] is not None else pd.Series(False, index=arrived.index)
        held["late"] += int(late.sum())
        timely = arrived[~late.to_numpy()]
        if len(timely):
            out, held = law(timely, held, kd, ki)
            out = out.assign(**dict(zip(STREAM, key)), late_dropped=held["late"])[names]
        else:
            out = pd.DataFrame(columns=names)
        state.update(tuple(held[f] for f in fields))
        last_ms = int(arrived["event_time"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs()) + idle_ms)
        yield out

    return (
        rows.withWatermark("event_time", delay)
        .groupBy(*STREAM)
        .applyInPandasWithState(handle, OUTPUT, STATE, "append", "EventTimeTimeout")
    )


def with_gains(rows: DataFrame, gains: DataFrame, start_ms: int = 1_704_067_200_000) -> DataFrame:
    """Static gains joined to arriving rows; event time is the recording clock counted from ``start_ms``.

    The watermark begins at the epoch and drops rows at or before it, so recordings must start later.
    """
    g = gains.select("rec", "kp", "kpsi", "omega_max", "v_min", "slew_rate")
    ms = F.lit(start_ms) + F.round(F.col("t") * 1000).cast("bigint")
    return rows.join(g, "rec").withColumn("event_time", F.timestamp_millis(ms))
