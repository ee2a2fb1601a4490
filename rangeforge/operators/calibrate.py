"""Calibration: map building, dense maps with branches, guided line fits, corner lines, and a least-squares camera and fan model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import rotation
from .fits import isotonic
from .matching import dimension, interpolate_line
from .windows import moving_median


def build_map(samples: DataFrame) -> DataFrame:
    """Nodes (fan, direction, d, x0, m) from measured lines (fan, d, x0, m).

    The line of L moves up with the distance, those of R and B down. Places and
    slopes of L and B are median-smoothed, and their places made monotone that
    way; R, which is no rigid plane, stays as measured.
    """
    keep = ["fan", "direction", "d", "x0", "m"]
    aimed = samples.withColumn("direction", F.when(F.col("fan") == "L", 1).otherwise(-1))
    smooth = aimed.where("fan <> 'R'")
    for c in ("x0", "m"):
        smooth = moving_median(smooth, ["fan"], "d", c).withColumn(c, F.col("smooth")).drop("smooth")
    rising = isotonic(smooth.withColumn("_v", F.col("x0") * F.col("direction")), ["fan"], "d", "_v").withColumn("x0", F.col("fit") * F.col("direction"))
    return rising.select(keep).unionByName(aimed.where("fan = 'R'").select(keep))


def branches(nodes: DataFrame, ends: int = 3) -> DataFrame:
    """(fan, lo, hi, near, far): a map's limits, and the branches v0 + k / d of place and slope fitted to its first and its last nodes."""
    by = Window.partitionBy("fan")
    placed = nodes.withColumns({"_up": F.row_number().over(by.orderBy("d")), "_down": F.row_number().over(by.orderBy(F.desc("d")))})

    def fitted(at: str):
        own = lambda c: F.when(F.col(at) <= ends, F.col(c))
        return F.struct(*[fit(own(c), 1 / F.col("d")).alias(f"{c}_{name}") for c in ("x0", "m") for name, fit in (("v", F.regr_intercept), ("k", F.regr_slope))])

    return placed.groupBy("fan").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), fitted("_up").alias("near"), fitted("_down").alias("far"))


def branched_lines(rows: DataFrame, nodes: DataFrame, d: str, *, blend: float = 0.15) -> DataFrame:
    """rows (with fan and d) with x0 and m of their fan's line: linear between nodes; outside, the branch of the nearest three nodes,
    blended in over `blend` metres below the first node, and from `blend` to twice that behind the last. Rows of unknown fans or without d go."""
    limits = branches(nodes).select(F.col("fan").alias("_fan"), "lo", "hi", "near", "far")
    held = interpolate_line(rows.where(F.col(d).isNotNull()), nodes, d).join(dimension(limits), F.col("fan") == F.col("_fan"))
    clipped = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / blend))
    below = F.col(d) < F.col("lo")
    w = F.when(below, clipped(F.col("lo") - F.col(d))).otherwise(clipped(F.col(d) - F.col("hi") - blend))
    beyond = lambda c: F.when(below, F.col(f"near.{c}_v") + F.col(f"near.{c}_k") / F.col(d)).otherwise(F.col(f"far.{c}_v") + F.col(f"far.{c}_k") / F.col(d))
    line = {c: F.when(w > 0, (1 - w) * F.col(c) + w * beyond(c)).otherwise(F.col(c)) for c in ("x0", "m")}
    return held.withColumns(line).select(*rows.columns, "x0", "m")


def corner_lines(nodes: DataFrame, side: str, bottom: str = "B") -> DataFrame:
    """(d, x, y): where a side fan's line meets the bottom fan's at each distance that both have."""
    s, b = (nodes.where(F.col("fan") == f).select("d", F.col("x0").alias(f"{p}x"), F.col("m").alias(f"{p}m")) for f, p in ((side, "s"), (bottom, "b")))
    both = s.join(b, "d")
    x = (F.col("sm") * (F.col("bx") - F.col("bm") * 640.0 - 360.0) + F.col("sx")) / (1 - F.col("sm") * F.col("bm"))
    return both.withColumn("x", x).select("d", "x", (F.col("bm") * (F.col("x") - 640.0) + F.col("bx")).alias("y"))


@dataclass(frozen=True)
class FanModel:
    """Camera height, angles and focal lengths, and each fan's unit normal and offset."""

    parameters: np.ndarray
    fans: tuple[str, ...]

    def lines(self, d: float) -> np.ndarray:
        """(fan, 3): normalised image lines on a wall at distance d."""
        h, yaw, pitch, roll, fx, fy, cx, cy = self.parameters[:8]
        turn, out = rotation(pitch, yaw, roll), []
        for k in range(len(self.fans)):
            n, c = self.parameters[8 + 4 * k : 11 + 4 * k], self.parameters[11 + 4 * k]
            n = n / np.linalg.norm(n)
            along = np.array([-n[1], n[0], 0.0]) / max(np.hypot(n[0], n[1]), 1e-9)
            at = n * np.array([1, 1, 0]) * (c - n[2] * d) / max(n[0] ** 2 + n[1] ** 2, 1e-9) + np.array([0, 0, d])
            p = [turn.T @ (q - np.array([0, h, 0])) for q in (at - along, at + along)]
            (u0, v0), (u1, v1) = ((q[0] / q[2] * fx + cx, q[1] / q[2] * fy + cy) for q in p)
            line = np.array([v0 - v1, u1 - u0, u0 * v1 - u1 * v0])
            out.append(line / max(np.hypot(line[0], line[1]), 1e-9))
        return np.array(out)


    def fan_lines(self, fan: str, d: np.ndarray) -> np.ndarray:
        """(n, 3): one fan's lines at distances."""
        k = self.fans.index(fan)
        return np.array([self.lines(float(v))[k] for v in d])

    def plane_distance(self, x: float, y: float, fan: str = "B", near: float = 0.3, far: float = 25.0) -> float | None:
        """Distance at which a pixel's ray meets a fan's plane, if between near and far."""
        h, yaw, pitch, roll, fx, fy, cx, cy = self.parameters[:8]
        k = self.fans.index(fan)
        normal, c = self.parameters[8 + 4 * k : 11 + 4 * k], self.parameters[11 + 4 * k]
        ray, at = rotation(pitch, yaw, roll) @ np.array([(x - cx) / fx, (y - cy) / fy, 1.0]), np.array([0, h, 0])
        along = float(normal @ ray)
        t = (c - float(normal @ at)) / along if abs(along) >= 1e-6 else -1.0
        z = float((at + t * ray)[2])
        return z if t > 0 and near < z < far else None


def line_residual(model: np.ndarray, seen: np.ndarray, probe: float = 100.0, centre: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
    """Distances of two probe points of the seen line, around its point nearest to the image's origin, from the model's; signs aligned."""
    a, b, c = seen
    s = a * centre[0] + b * centre[1] + c
    x, y = centre[0] - s * a, centre[1] - s * b
    out = np.array([model[0] * (x - t * b) + model[1] * (y + t * a) + model[2] for t in (-probe, probe)])
    return out if model[0] * a + model[1] * b >= 0 else -out


def fit_model(samples: list[tuple[float, np.ndarray]], start: FanModel, *, rounds: int = 300, settle: float = 1e-10) -> tuple[FanModel, float, bool]:
    """(model, cost, settled): Levenberg-Marquardt on the probe residuals of (d, lines by fan); a handful of samples, so it runs on the driver."""
    def residuals(p: np.ndarray) -> np.ndarray:
        m = FanModel(p, start.fans)
        parts = [line_residual(model, seen) for d, lines in samples for model, seen in zip(m.lines(d), lines, strict=True) if np.isfinite(seen).all()]
        parts += [np.array([np.linalg.norm(p[8 + 4 * k : 11 + 4 * k]) - 1]) for k in range(len(start.fans))]
        return np.concatenate(parts)

    p, damping = start.parameters.astype(float).copy(), 1e-2
    r = residuals(p)
    cost = float(r @ r)
    for _ in range(rounds):
        steps = 1e-6 * np.maximum(1, np.abs(p))
        j = np.stack([(residuals(p + e) - residuals(p - e)) / (2 * s) for e, s in zip(np.diag(steps), steps, strict=True)], axis=1)
        h, g = j.T @ j, j.T @ r
        while damping < 1e12:
            new = p - np.linalg.lstsq(h + damping * np.diag(np.maximum(np.diag(h), 1e-12)), g, rcond=None)[0]
            rn = residuals(new)
            if rn @ rn < cost:
                gain = cost - float(rn @ rn)
                p, r, cost, damping = new, rn, float(rn @ rn), max(damping / 5, 1e-12)
                break
            damping *= 4
        else:
            return FanModel(p, start.fans), cost, True
        if gain <= settle * max(cost, 1e-30):
            return FanModel(p, start.fans), cost, True
    return FanModel(p, start.fans), cost, False
