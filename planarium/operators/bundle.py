"""Bundle adjustment: cameras and points moved until what they predict meets what was seen.

Observations, cameras and points are tables. A round joins them, differentiates each residual where it stands, adds up
blocks by camera and by point, eliminates the points (each point's block is inverted by itself) and solves the small
system of the cameras on the driver, six unknowns each; points then follow by a join. Focal lengths and distortion stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import checkpointed

_CAM = ["r1", "r2", "r3", "t1", "t2", "t3", "f", "k1", "k2"]


def rotate(r: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points turned by rotation vectors, row by row (Rodrigues)."""
    angle = np.linalg.norm(r, axis=1, keepdims=True)
    axis = np.divide(r, angle, out=np.zeros_like(r), where=angle > 1e-12)
    dot = (axis * p).sum(1, keepdims=True)
    return p * np.cos(angle) + np.cross(axis, p) * np.sin(angle) + axis * dot * (1 - np.cos(angle))


def project(cams: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The image of each point in its camera (r, t, f, k1, k2), which looks down -z."""
    p = rotate(cams[:, :3], points) + cams[:, 3:6]
    xy = -p[:, :2] / p[:, 2:]
    square = (xy**2).sum(1, keepdims=True)
    return cams[:, 6:7] * (1 + cams[:, 7:8] * square + cams[:, 8:9] * square**2) * xy


def jacobians(cams: np.ndarray, points: np.ndarray, step: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the image by the camera's six motions (n, 2, 6) and by the point (n, 2, 3), by central differences."""
    by_cam, by_point = np.zeros((len(cams), 2, 6)), np.zeros((len(cams), 2, 3))
    for k in range(6):
        d = np.zeros(9)
        d[k] = step
        by_cam[:, :, k] = (project(cams + d, points) - project(cams - d, points)) / (2 * step)
    for k in range(3):
        d = np.zeros(3)
        d[k] = step
        by_point[:, :, k] = (project(cams, points + d) - project(cams, points - d)) / (2 * step)
    return by_cam, by_point


def _joined(obs: DataFrame, cams: DataFrame, points: DataFrame) -> DataFrame:
    return obs.join(cams, "cam_id").join(points, "pt_id")


def residuals(obs: DataFrame, cams: DataFrame, points: DataFrame) -> DataFrame:
    """(cam_id, pt_id, du, dv): predicted less observed."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = project(b[_CAM].to_numpy(float), b[["x", "y", "z"]].to_numpy(float))
            yield pd.DataFrame({"cam_id": b["cam_id"], "pt_id": b["pt_id"], "du": seen[:, 0] - b["u"], "dv": seen[:, 1] - b["v"]})

    return _joined(obs, cams, points).mapInPandas(step, "cam_id int, pt_id int, du double, dv double")


def error(obs: DataFrame, cams: DataFrame, points: DataFrame) -> float:
    """The sum of all residuals' lengths."""
    return residuals(obs, cams, points).agg(F.sum(F.expr("sqrt(du * du + dv * dv)"))).first()[0] or 0.0


def _blocks(rows: pd.DataFrame, damping: float) -> tuple:
    c, p = rows[_CAM].to_numpy(float), rows[["x", "y", "z"]].to_numpy(float)
    r = project(c, p) - rows[["u", "v"]].to_numpy(float)
    jc, jp = jacobians(c, p)
    v = np.einsum("nki,nkj->ij", jp, jp) + damping * np.eye(3)
    w = np.einsum("nki,nkj->nij", jc, jp)
    return r, jc, jp, np.linalg.inv(v), w


def _reducer(damping: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a point's observations add to the cameras' system once the point is eliminated; b is -1 for the right side."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        r, jc, jp, v, w = _blocks(rows, damping)
        g, ids, n = np.einsum("nki,nk->i", jp, r), rows["cam_id"].to_numpy(), len(rows)
        right = np.einsum("nki,nk->ni", jc, r) - w @ (v @ g)
        block = -np.einsum("aij,jk,blk->abil", w, v, w)
        block[np.arange(n), np.arange(n)] += np.einsum("nki,nkj->nij", jc, jc)
        a, b, i, j = (x.ravel() for x in np.indices(block.shape))
        sides, axis = (x.ravel() for x in np.indices(right.shape))
        columns = {"a": np.r_[ids[sides], ids[a]], "b": np.r_[np.full(len(sides), -1), ids[b]], "i": np.r_[axis, i], "j": np.r_[np.zeros(len(axis), int), j], "value": np.r_[right.ravel(), block.ravel()]}
        return pd.DataFrame(columns)

    return reduce


def _follower(by_cam: dict[int, np.ndarray], damping: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A point moved after its cameras."""

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        r, _, jp, v, w = _blocks(rows, damping)
        d = np.stack([by_cam[c] for c in rows["cam_id"]])
        step = -v @ (np.einsum("nki,nk->i", jp, r) + np.einsum("nij,ni->j", w, d))
        x = rows[["x", "y", "z"]].to_numpy(float)[0] + step
        return pd.DataFrame({"pt_id": [rows["pt_id"].iloc[0]], "x": [x[0]], "y": [x[1]], "z": [x[2]]})

    return follow


def adjust(obs: DataFrame, cams: DataFrame, points: DataFrame, rounds: int = 20, damping: float = 10.0, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame, list[float]]:
    """(cameras, points, errors by round). A round that does not lower the error is dropped and damping grows tenfold;
    it ends after `rounds`, or when the error changes by no more than the tolerance.

    The cameras' system has (6 x cameras) squared entries, summed by key on the executors: its size follows the cameras
    of one problem, never the observations. A point's observations are one group, no more than there are cameras.
    """
    errors = [error(obs, cams, points)]
    for _ in range(rounds):
        joined = _joined(obs, cams, points)
        sums = joined.groupBy("pt_id").applyInPandas(_reducer(damping), "a int, b int, i int, j int, value double").groupBy("a", "b", "i", "j").agg(F.sum("value").alias("value")).collect()
        order = {c: k for k, c in enumerate(sorted({s.a for s in sums}))}
        m, right = np.eye(6 * len(order)) * damping, np.zeros(6 * len(order))
        for s in sums:
            if s.b < 0:
                right[6 * order[s.a] + s.i] += s.value
            else:
                m[6 * order[s.a] + s.i, 6 * order[s.b] + s.j] += s.value
        move = -np.linalg.solve(m, right).reshape(-1, 6)
        by_cam = {c: move[k] for c, k in order.items()}

        new_points = checkpointed(joined.groupBy("pt_id").applyInPandas(_follower(by_cam, damping), "pt_id int, x double, y double, z double"))
        moves = obs.sparkSession.createDataFrame([(int(c), *map(float, d)) for c, d in by_cam.items()], "cam_id int, " + ", ".join(f"d{k} double" for k in range(6)))
        moved = [(F.col(c) + F.coalesce(f"d{k}", F.lit(0.0))).alias(c) for k, c in enumerate(_CAM[:6])]
        new_cams = checkpointed(cams.join(moves, "cam_id", "left").select("cam_id", *moved, *_CAM[6:]))
        now = error(obs, new_cams, new_points)
        if now >= errors[-1]:
            damping *= 10
            if errors[-1] - now > -tolerance or damping > 1e12:
                break
            continue
        cams, points, damping = new_cams, new_points, damping / 3
        errors.append(now)
        if errors[-2] - now <= tolerance:
            break
    return cams, points, errors
