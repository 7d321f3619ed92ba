"""Column functions for camera and site geometry."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklab import params as P


@dataclass(frozen=True)
class Calibration:
    """Pinhole camera over flat ground; ``ground`` maps native pixels to base-frame rays."""

    width: float
    height: float
    k: tuple
    rotation: tuple
    position: tuple

    @property
    def ground(self) -> np.ndarray:
        scale = np.diag([self.width / P.FRAME_PX, self.height / P.FRAME_PX, 1.0])
        return np.array(self.rotation) @ np.linalg.inv(np.array(self.k)) @ scale


# optical axes (z forward, x right, y down) in body axes (x forward, y left, z up)
_BODY_FROM_OPTICAL = np.array([[0.0, 0.0, 1.0], [-1.0, 0.0, 0.0], [0.0, -1.0, 0.0]])


def _tuple(m: np.ndarray) -> tuple:
    return tuple(tuple(float(v) for v in row) for row in m)


def from_quaternion(width, height, k, quat_xyzw, position) -> Calibration:
    q = np.array(quat_xyzw, float)
    v, s = q[:3] / np.linalg.norm(q), q[3] / np.linalg.norm(q)
    skew = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    body = np.eye(3) + 2 * s * skew + 2 * skew @ skew
    return Calibration(width, height, k, _tuple(body @ _BODY_FROM_OPTICAL), tuple(position))


def from_euler(width, height, k, roll_deg, pitch_deg, yaw_deg, position) -> Calibration:
    def turn(axis: int, deg: float) -> np.ndarray:
        a, b = [n for n in range(3) if n != axis]
        m = np.eye(3)
        c, s = np.cos(np.radians(deg)), np.sin(np.radians(deg)) * (-1 if axis == 1 else 1)
        m[a, a] = m[b, b] = c
        m[a, b], m[b, a] = -s, s
        return m

    body = turn(2, yaw_deg) @ turn(1, pitch_deg) @ turn(0, roll_deg)
    return Calibration(width, height, k, _tuple(body @ _BODY_FROM_OPTICAL), tuple(position))


# fixed values: camera calibration of the two sites
FIRST_SITE = from_quaternion(
    1920.0,
    1080.0,
    ((1057.0, 0.0, 952.2), (0.0, 1057.0, 553.6), (0.0, 0.0, 1.0)),
    (0.0, 0.017, 0.0, 1.0),
    (0.345, 0.060, 0.763),
)
SECOND_SITE = from_euler(
    1280.0,
    720.0,
    ((908.902, 0.0, 650.331), (0.0, 909.155, 363.993), (0.0, 0.0, 1.0)),
    0.75,
    5.75,
    0.0,
    (0.0, 0.0, 1.269),
)
SITES = {"first": FIRST_SITE, "second": SECOND_SITE}
PROJECTION_NEAR_M = 8.0


def _row(m, u: Column, v: Column) -> Column:
    return F.lit(float(m[0])) * u + F.lit(float(m[1])) * v + F.lit(float(m[2]))


def project_px(u: Column, v: Column, cal: Calibration, near: float = PROJECTION_NEAR_M) -> Column:
    """Pixel on the square frame to ground ``(X forward, Y left)``; NULL above the horizon or out of range."""
    g = cal.ground
    dx, dy, dz = (_row(g[n], u, v) for n in range(3))
    px, py, pz = cal.position
    scale = F.lit(-pz) / dz
    x, y = F.lit(px) + scale * dx, F.lit(py) + scale * dy
    seen = (dz < -1e-6) & (x > 0) & (x < near)
    return F.when(seen, F.struct(x.alias("X"), y.alias("Y")))


def project_ground(x: Column, y: Column, cal: Calibration, z: Column | float = 0.0) -> Column:
    """Ground point to pixel ``(u, v)`` on the square frame; NULL behind the image plane."""
    z = z if isinstance(z, Column) else F.lit(float(z))
    back = np.array(cal.rotation).T
    px, py, pz = cal.position
    rel = (x - px, y - py, z - pz)
    ray = [sum((F.lit(float(back[n][m])) * rel[m] for m in (1, 2)), F.lit(float(back[n][0])) * rel[0]) for n in range(3)]
    k = cal.k
    u = (k[0][0] * ray[0] / ray[2] + k[0][2]) * (P.FRAME_PX / cal.width)
    v = (k[1][1] * ray[1] / ray[2] + k[1][2]) * (P.FRAME_PX / cal.height)
    return F.when(ray[2] > 1e-6, F.struct(u.alias("u"), v.alias("v")))


def to_local_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Equirectangular degrees to metres around an origin."""
    east = (lon - lon0) * (P.METRES_PER_DEG_LON * F.cos(F.radians(lat0)))
    return F.struct(east.alias("x"), ((lat - lat0) * P.METRES_PER_DEG_LAT).alias("y"))


def signed_perp(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed offset from a segment (left positive), distance to it and its bearing in degrees."""
    abx, aby = bx - ax, by - ay
    n2 = abx * abx + aby * aby
    t = F.greatest(F.least(((px - ax) * abx + (py - ay) * aby) / n2, F.lit(1.0)), F.lit(0.0))
    vx, vy = px - (ax + t * abx), py - (ay + t * aby)
    return F.struct(
        ((vy * abx - vx * aby) / F.sqrt(n2)).alias("off"),
        F.hypot(vx, vy).alias("dist"),
        F.degrees(F.atan2(abx, aby)).alias("bearing"),
    )


def enu_to_view(px: Column, py: Column, rx: Column, ry: Column, heading_deg: Column) -> Column:
    """World point in the frame of a camera looking backwards along the robot's heading."""
    s, c = F.sin(F.radians(heading_deg)), F.cos(F.radians(heading_deg))
    dx, dy = px - rx, py - ry
    return F.struct((-(dx * s + dy * c)).alias("X"), (dx * c - dy * s).alias("Y"))


def wrap_fold(a: Column, b: Column) -> Column:
    """Difference of two bearings wrapped to +-180 degrees, then folded to the acute sense of a line."""
    d = F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0
    return F.when(F.abs(d) > 90.0, d - 180.0 * F.signum(d)).otherwise(d)


def base_point(kind: str) -> tuple[Column, Column]:
    """Ground contact of a box (``x1..y2``) or of a component (``x, y, w, h``)."""
    if kind == "box":
        return (F.col("x1") + F.col("x2")) / 2, F.col("y2")
    return F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") - 1


def area_fraction() -> Column:
    return (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / float(P.FRAME_PX * P.FRAME_PX)


def size_guard(frac: Column) -> Column:
    """``drop`` above the size limit, ``near`` for large boxes that are kept, else ``keep``."""
    return (
        F.when(frac > P.OVERSIZE_FRACTION, "drop").when(frac > P.NEAR_FRACTION, "near").otherwise("keep")
    )


def band(score: Column, low: float = P.BAND_LOW, high: float = P.BAND_HIGH) -> Column:
    """Three-band verdict; both bounds belong to the decided side."""
    return F.when(score <= low, "absent").when(score >= high, "present").otherwise("needs_review")


def assumption_budget(lateral: Column, yaw_deg: Column, look: float = P.LOOK_M) -> Column:
    """Worst-case offset of the assumed mounting: lateral error plus look-ahead times tan(yaw)."""
    return lateral + look * F.tan(F.radians(yaw_deg))
