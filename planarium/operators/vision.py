"""Two-view geometry: linear fits from pairs of points, robust choices among hypotheses, poses and triangulation.

Each image pair is one group; its hypotheses come from samples drawn by a seeded generator for that pair's key, so a
rerun gives the same result wherever the group lands.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _normalised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to their mean and scaled to a mean square distance of two, and the matrix that did it."""
    mean, spread = p.mean(0), np.sqrt(p.var(0).sum() / 2)
    s = 1 / spread if spread > 0 else 1.0
    t = np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1]])
    return (p - mean) * s, t


def _least(m: np.ndarray) -> np.ndarray:
    """The unit vector that m makes shortest. The left singular vectors, as many as rows squared, are never built whole."""
    return np.linalg.svd(m, full_matrices=len(m) < m.shape[1])[2][-1]


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 3 x 3 map from a to b by the direct linear transform, its last entry 1 where that is possible."""
    (p, t), (q, u) = _normalised(a), _normalised(b)
    zero, one = np.zeros(len(p)), np.ones(len(p))
    top = np.stack([-p[:, 0], -p[:, 1], -one, zero, zero, zero, q[:, 0] * p[:, 0], q[:, 0] * p[:, 1], q[:, 0]], 1)
    low = np.stack([zero, zero, zero, -p[:, 0], -p[:, 1], -one, q[:, 1] * p[:, 0], q[:, 1] * p[:, 1], q[:, 1]], 1)
    h = np.linalg.solve(u, _least(np.concatenate([top, low])).reshape(3, 3)) @ t
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def fundamental(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank-two matrix F with b' F a = 0, from eight pairs or more."""
    (p, t), (q, u) = _normalised(a), _normalised(b)
    p, q = (np.c_[x, np.ones(len(x))] for x in (p, q))
    f = _least((q[:, :, None] * p[:, None, :]).reshape(len(p), 9)).reshape(3, 3)
    u_, s, v = np.linalg.svd(f)
    f = u.T @ (u_ * [s[0], s[1], 0]) @ v @ t
    return f / np.linalg.norm(f)


def transfer_errors(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = np.c_[a, np.ones(len(a))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.linalg.norm(m[:, :2] / m[:, 2:] - b, axis=1), nan=np.inf)


def epipolar_errors(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The larger of the two distances between a point and its partner's line."""
    p, q = (np.c_[x, np.ones(len(x))] for x in (a, b))
    line, back = p @ f.T, q @ f
    with np.errstate(divide="ignore", invalid="ignore"):
        off = np.abs((line * q).sum(1))
        return np.nan_to_num(np.maximum(off / np.hypot(line[:, 0], line[:, 1]), off / np.hypot(back[:, 0], back[:, 1])), nan=np.inf)


MODELS: dict[str, tuple[int, Callable, Callable]] = {"homography": (4, homography, transfer_errors), "fundamental": (8, fundamental, epipolar_errors)}


def robust(a: np.ndarray, b: np.ndarray, model: str, tolerance: float, rounds: int, seed: int, median: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
    """(matrix, inliers) of the first hypothesis with most inliers, or the least median error; refitted to its inliers."""
    size, fit, error = MODELS[model]
    if len(a) < size:
        return None
    rng, best = np.random.default_rng(seed), None
    for _ in range(rounds):
        pick = rng.choice(len(a), size, replace=False)
        try:
            errors = error(fit(a[pick], b[pick]), a, b)
        except np.linalg.LinAlgError:
            continue
        score = -float(np.median(errors)) if median else float((errors <= tolerance).sum())
        if best is None or score > best[0]:
            best = score, errors <= tolerance, pick
    if best is None:
        return None
    inside = best[1] if best[1].sum() >= size else np.isin(np.arange(len(a)), best[2])
    matrix = fit(a[inside], b[inside])
    return matrix, error(matrix, a, b) <= tolerance


def robust_models(matches: DataFrame, key: str, model: str, tolerance: float, rounds: int = 500, seed: int = 0, median: bool = False) -> DataFrame:
    """(key, m: nine numbers in row order, inliers, n) for each image pair of matches (key, x1, y1, x2, y2).

    Pairs with too few matches for the model give no row. Rows are put in order first, so a rerun samples the same.
    """
    kind = dict(matches.dtypes)[key]

    def step(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x1", "y1", "x2", "y2"])
        p = rows[["x1", "y1", "x2", "y2"]].to_numpy(float)
        found = robust(p[:, :2], p[:, 2:], model, tolerance, rounds, zlib.crc32(f"{seed}/{group[0]}".encode()), median)
        out = [] if found is None else [(group[0], found[0].ravel().tolist(), int(found[1].sum()), len(p))]
        return pd.DataFrame(out, columns=[key, "m", "inliers", "n"])

    return matches.select(key, "x1", "y1", "x2", "y2").groupBy(key).applyInPandas(step, f"{key} {kind}, m array<double>, inliers long, n long")


def poses(essential: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four (R, t) that an essential matrix allows, t of unit length."""
    u, _, v = np.linalg.svd(essential)
    u, v = u * np.sign(np.linalg.det(u)), v * np.sign(np.linalg.det(v))
    w = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]], float)
    return [(r, s * u[:, 2]) for r in (u @ w @ v, u @ w.T @ v) for s in (1, -1)]


def triangulate(p1: np.ndarray, p2: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Points seen at a by the 3 x 4 camera p1 and at b by p2: the linear solution of each."""
    rows = np.stack([a[:, :1] * p1[2] - p1[0], a[:, 1:] * p1[2] - p1[1], b[:, :1] * p2[2] - p2[0], b[:, 1:] * p2[2] - p2[1]], 1)
    x = np.linalg.svd(rows)[2][:, -1]
    return x[:, :3] / np.where(np.abs(x[:, 3:]) > 1e-12, x[:, 3:], 1e-12)


def best_pose(essential: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(R, t, points in front of both cameras) of the pose with most of them, for rays a and b of calibrated cameras."""
    first, found = np.eye(3, 4), []
    for k, (r, t) in enumerate(poses(essential)):
        x = triangulate(first, np.c_[r, t], a, b)
        found.append((int(((x[:, 2] > 0) & ((x @ r.T + t)[:, 2] > 0)).sum()), -k, r, t))
    n, _, r, t = max(found, key=lambda f: f[:2])
    return r, t, n


def intrinsics(width: int, height: int, fov: float = 86.0) -> np.ndarray:
    """A pinhole camera with one field of view on both axes."""
    tan = np.tan(np.radians(fov) / 2)
    return np.array([[width / 2 / tan, 0, width / 2], [0, height / 2 / tan, height / 2], [0, 0, 1]])


def rectifying(k: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Homographies of two views after which partners lie in one row: both turn until the baseline is the x axis."""
    base = -r.T @ t
    x = base / np.linalg.norm(base)
    y = np.cross([0, 0, 1], x)
    y = y / np.linalg.norm(y) if np.linalg.norm(y) > 1e-9 else np.array([0.0, 1, 0])
    turn = np.stack([x, y, np.cross(x, y)])
    back = np.linalg.inv(k)
    return k @ turn @ back, k @ turn @ r.T @ back


def _pair_poses(group: tuple, rows: pd.DataFrame, camera: np.ndarray, tolerance: float, rounds: int, seed: int, median: bool) -> list[tuple]:
    rows = rows.sort_values(["x1", "y1", "x2", "y2"])
    p = rows[["x1", "y1", "x2", "y2"]].to_numpy(float)
    found = robust(p[:, :2], p[:, 2:], "fundamental", tolerance, rounds, zlib.crc32(f"{seed}/{group[0]}".encode()), median)
    if found is None:
        return []
    f, inside = found
    back = np.linalg.inv(camera)
    a, b = ((np.c_[q[inside], np.ones(int(inside.sum()))] @ back.T)[:, :2] for q in (p[:, :2], p[:, 2:]))
    out = []
    for k, (r, t) in enumerate(poses(camera.T @ f @ camera)):
        x = triangulate(np.eye(3, 4), np.c_[r, t], a, b) if len(a) else np.zeros((0, 3))
        front = int(((x[:, 2] > 0) & ((x @ r.T + t)[:, 2] > 0)).sum())
        out.append((group[0], k, r.ravel().tolist(), t.tolist(), front, int(inside.sum()), len(p)))
    return out


def pose_hypotheses(matches: DataFrame, key: str, camera: np.ndarray, tolerance: float = 1.0, rounds: int = 500, seed: int = 0, median: bool = False) -> DataFrame:
    """(key, hypothesis, r, t, front, inliers, n): the four poses of the second camera that each pair's matches allow.

    matches has key, x1, y1, x2, y2 in pixels of one camera. A robust fundamental matrix gives the essential one; front
    counts the inliers that lie before both cameras. r are nine numbers by rows, t has unit length. Pairs with fewer
    than eight matches give no row.
    """
    kind = dict(matches.dtypes)[key]

    def step(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_pair_poses(group, rows, camera, tolerance, rounds, seed, median), columns=[key, "hypothesis", "r", "t", "front", "inliers", "n"])

    return matches.select(key, "x1", "y1", "x2", "y2").groupBy(key).applyInPandas(step, f"{key} {kind}, hypothesis int, r array<double>, t array<double>, front long, inliers long, n long")


def best_poses(hypotheses: DataFrame, key: str) -> DataFrame:
    """(key, r, t, front, inliers, n): of each pair's hypotheses the one with most points in front, the first of equals."""
    best = F.max_by(F.struct("r", "t", "front", "inliers", "n"), F.struct("front", -F.col("hypothesis")))
    return hypotheses.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def triangulated(matches: DataFrame, found: DataFrame, key: str, camera: np.ndarray) -> DataFrame:
    """matches (key, x1, y1, x2, y2, ...) with x, y, z, the point in the first camera's frame, and z2, its depth in the second's.

    found has key, r and t of each pair; matches of other pairs are left out. Each match is solved by itself, so that rows
    need no grouping.
    """
    back = np.linalg.inv(camera)
    joined = matches.join(found.select(key, F.col("r").alias("_r"), F.col("t").alias("_t")), key)
    kinds, columns = ", ".join(f"`{n}` {t}" for n, t in matches.dtypes), matches.columns

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            a, b = ((np.c_[rows[[f"x{k}", f"y{k}"]].to_numpy(float), np.ones(len(rows))] @ back.T)[:, :2] for k in (1, 2))
            r, t = np.stack(rows["_r"].to_numpy()).reshape(-1, 3, 3), np.stack(rows["_t"].to_numpy())
            second = np.concatenate([r, t[:, :, None]], 2)
            first = np.broadcast_to(np.eye(3, 4), second.shape)
            m = np.stack([a[:, :1] * first[:, 2] - first[:, 0], a[:, 1:] * first[:, 2] - first[:, 1], b[:, :1] * second[:, 2] - second[:, 0], b[:, 1:] * second[:, 2] - second[:, 1]], 1)
            x = np.linalg.svd(m)[2][:, -1]
            x = x[:, :3] / np.where(np.abs(x[:, 3:]) > 1e-12, x[:, 3:], 1e-12)
            depth = (r[:, 2] * x).sum(1) + t[:, 2]
            yield rows[columns].assign(x=x[:, 0], y=x[:, 1], z=x[:, 2], z2=depth)

    return joined.mapInPandas(step, f"{kinds}, x double, y double, z double, z2 double")


def rectifications(found: DataFrame, key: str, camera: np.ndarray) -> DataFrame:
    """(key, h1, h2): for each pair's pose (key, r, t) the homographies, nine numbers each, that put partners in one row."""
    kind = dict(found.dtypes)[key]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [rectifying(camera, np.array(r).reshape(3, 3), np.array(t)) for r, t in zip(rows["r"], rows["t"])]
            yield pd.DataFrame({key: rows[key], "h1": [h.ravel().tolist() for h, _ in out], "h2": [h.ravel().tolist() for _, h in out]})

    return found.select(key, "r", "t").mapInPandas(step, f"{key} {kind}, h1 array<double>, h2 array<double>")
