"""From lines to walls: arcs merged on the sphere, main directions, corners between lines, traced and sampled outlines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import lines


def _within(u: float, low: float, high: float) -> bool:
    return low <= u <= high if low <= high else u >= low or u <= high


def _meet(a: tuple[float, float], b: tuple[float, float]) -> bool:
    return _within(a[0], *b) or _within(a[1], *b) or _within(b[0], *a) or _within(b[1], *a)


def _hull(a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float]:
    """The shortest interval of the ring that holds two that meet; the whole ring is (0, 1)."""
    ends = [(low, high) for low in (a[0], b[0]) for high in (a[1], b[1])]
    holds = [e for e in ends if all(_within(u, *e) for u in (*a, *b))]
    size = lambda e: (e[1] - e[0]) % 1.0
    return min(holds, key=size) if holds else (0.0, 1.0)


def _on_circle(n: np.ndarray, u: float, plane: int) -> np.ndarray:
    """The point of the great circle with normal n at the share u of a turn, axes cycled by plane."""
    a, b, c = np.roll(n, 1 - plane)
    lon = u * 2 * math.pi - math.pi
    lat = math.atan(-(math.sin(lon) * a + math.cos(lon) * b) / (c + 1e-12))
    return np.roll([math.cos(lat) * math.sin(lon), math.cos(lat) * math.cos(lon), math.sin(lat)], plane - 1)


def merge_arcs(arcs: DataFrame, key: str, degrees: float = 1.0, passes: int = 3) -> DataFrame:
    """(key, plane, nx, ny, nz, umin, umax, length, score): arcs of one circle whose ranges meet become one.

    Arcs (same columns) of one plane merge if their normals are within so many degrees, whichever way they point. The
    longest is taken first and takes in every arc that it meets, one after another. Normals add up by length, the score
    is the mean by length, and the length is measured anew: the angle between the merged arc's ends on its circle. The
    order matters, so one panorama's arcs, a few thousand, are one group; passes repeat until nothing merges.
    """
    kinds = dict(arcs.dtypes)
    columns = ["plane", "nx", "ny", "nz", "umin", "umax", "length", "score"]
    bound = math.cos(math.radians(degrees))

    def step(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = [[int(r[0]), np.array(r[1:4], float), (float(r[4]), float(r[5])), float(r[6]), float(r[7])] for r in rows[columns].itertuples(index=False)]
        held.sort(key=lambda a: (-a[3], a[0], a[2], tuple(a[1])))
        for _ in range(passes):
            out: list = []
            for arc in held:
                for other in out:
                    dot = float(arc[1] @ other[1])
                    if arc[0] == other[0] and abs(dot) > bound and _meet(arc[2], other[2]):
                        n = other[1] * other[3] + math.copysign(1, dot) * arc[1] * arc[3]
                        other[1] = n / np.linalg.norm(n)
                        other[2] = _hull(arc[2], other[2])
                        other[4] = (other[3] * other[4] + arc[3] * arc[4]) / (other[3] + arc[3]) if other[3] + arc[3] else other[4]
                        ends = [_on_circle(other[1], u, arc[0]) for u in other[2]]
                        other[3] = math.acos(max(-1.0, min(1.0, float(ends[0] @ ends[1]))))
                        break
                else:
                    out.append(list(arc))
            done, held = len(out) == len(held), out
            if done:
                break
        return pd.DataFrame([(group[0], a[0], *a[1], *a[2], a[3], a[4]) for a in held], columns=[key, *columns])

    schema = f"{key} {kinds[key]}, plane int, nx double, ny double, nz double, umin double, umax double, length double, score double"
    return arcs.select(key, *columns).groupBy(key).applyInPandas(step, schema)


def _frame(normals: np.ndarray, weights: np.ndarray, every: np.ndarray, level: int, within: float, square: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(three directions, their votes): the orthogonal triple of candidates with most votes, fitted `rounds` times anew."""
    score = ((np.abs(normals @ every.T) <= math.sin(math.radians(within))) * weights[:, None]).sum(0)
    flat = np.abs(every @ every.T) <= math.sin(math.radians(max(square, 1e-9) + 180 / (5 * 2**level)))
    best = None
    for i in np.argsort(-score, kind="stable"):
        ok = np.flatnonzero(flat[i])
        if not len(ok) or (best is not None and score[i] * 3 <= best[0]):  # the first of a triple is its highest
            continue
        pair = np.where(flat[np.ix_(ok, ok)], score[ok][:, None] + score[ok][None, :], -1.0)
        j, k = np.unravel_index(int(pair.argmax()), pair.shape)
        if pair[j, k] >= 0 and (best is None or score[i] + pair[j, k] > best[0] + 1e-12):
            best = score[i] + pair[j, k], (i, ok[j], ok[k])
    if best is None:
        return np.eye(3), np.zeros(3)
    axes = every[list(best[1])].copy()
    for turn in range(rounds):
        reach = math.radians((3 * within + 180 / (5 * 2**level)) / 2**turn)
        off = np.arcsin(np.minimum(1.0, np.abs(normals @ axes.T)))
        nearest = np.where(off.min(1) <= reach, off.argmin(1), 3)
        for k in range(3):
            own = normals[nearest == k] * weights[nearest == k][:, None]
            if len(own) >= 2:  # normals lie in the plane orthogonal to the direction
                v = np.linalg.eigh(own.T @ own)[1][:, 0]
                axes[k] = v * (np.sign(v @ axes[k]) or 1.0)
    votes = ((np.abs(normals @ axes.T) <= math.sin(math.radians(within))) * weights[:, None]).sum(0)
    return axes, votes


def manhattan_frames(arcs: DataFrame, key: str, level: int = 3, within: float = 2.0, square: float = 2.0, rounds: int = 3) -> DataFrame:
    """(key, axis, x, y, z, votes): for each panorama three orthogonal directions that its arcs vote for most.

    arcs has the key, nx, ny, nz and weight. Candidates are the points of a subdivided icosahedron, half of them by
    symmetry; an arc votes for a direction that its circle passes within so many degrees. Of all triples within `square`
    degrees of orthogonal the one with most votes is taken, the first of equals, and each direction is fitted `rounds`
    times to the arcs near it, ever nearer. A panorama's arcs, a few thousand, are one group; one without votes gets the
    axes of space.
    """
    every = np.array([p for p in lines.icosahedron(level) if (p[2], p[1], p[0]) > (0, 0, 0)])
    kind = dict(arcs.dtypes)[key]

    def step(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["nx", "ny", "nz", "weight"])
        n = rows[["nx", "ny", "nz"]].to_numpy(float)
        n = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-12)
        axes, votes = _frame(n, rows["weight"].to_numpy(float), every, level, within, square, rounds)
        return pd.DataFrame([(group[0], k, *map(float, axes[k]), float(votes[k])) for k in range(3)], columns=[key, "axis", "x", "y", "z", "votes"])

    return arcs.select(key, "nx", "ny", "nz", "weight").groupBy(key).applyInPandas(step, f"{key} {kind}, axis int, x double, y double, z double, votes double")


def refitted(arcs: DataFrame, keys: list[str], weight: float = 0.1, samples: int = 100) -> DataFrame:
    """arcs (keys, nx, ny, nz, plane, umin, umax, vx, vy, vz) with normals drawn towards passing their direction v.

    An arc is sampled evenly; its new normal is that of the plane through the middle of space which fits the samples and
    v, that counting as `weight` times all of them. No weight leaves an arc as it is. The samples are sums in the JVM;
    only a three by three matrix of each arc is solved in Python.
    """
    span = F.expr("umin + pmod(umax - umin, 1.0) * k / {0}".format(float(samples - 1)))
    dots = arcs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("u", F.pmod(span, F.lit(1.0)) * (2 * math.pi) - math.pi)
    x, y, z = G.c3_xyz(F.col("u"), G.great_circle_v(F.col("nx"), F.col("ny"), F.col("nz"), F.col("u"), F.col("plane")), F.col("plane"))
    seen = dots.select(*keys, x.alias("x"), y.alias("y"), z.alias("z"), F.lit(1.0).alias("weight"))
    drawn = arcs.select(*keys, F.col("vx").alias("x"), F.col("vy").alias("y"), F.col("vz").alias("z"), F.lit(float(weight * samples)).alias("weight"))
    sums = lines.scatter(seen.unionByName(drawn), keys)
    kinds = dict(arcs.dtypes)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            m = rows[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy(float).reshape(-1, 3, 3)
            n = np.linalg.eigh(m)[1][:, :, 0]
            yield rows[keys].assign(**{c: n[:, k] for k, c in enumerate(("ux", "uy", "uz"))})

    found = sums.mapInPandas(solve, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "ux double, uy double, uz double"]))
    side = F.when(F.expr("ux * nx + uy * ny + uz * nz < 0"), -1.0).otherwise(1.0)
    back = arcs.join(found, keys).withColumns({f"n{c}": side * F.col(f"u{c}") for c in "xyz"})
    return back.select(arcs.columns)


def _ends(ax: float, ay: float, bx: float, by: float, dots: np.ndarray, crossed: np.ndarray, radius: float, factor: float, most: int, reach: float) -> tuple | None:
    """(x0, y0, x1, y1, inliers) of one line: the two crossings with most of its points around, or its own ends."""
    along = bx * (dots[:, 0] - ax) + by * (dots[:, 1] - ay)
    own = np.array([[ax + t * bx, ay + t * by] for t in (along.min(), along.max())])
    if len(crossed) < 2:
        return *own[0], *own[1], 0
    first, second = np.triu_indices(len(crossed), 1)
    away = np.linalg.norm(dots[:, None, :] - crossed[None, :, :], axis=2)
    for turn in range(most):
        near = (away <= radius * (factor * turn if turn else 1)).sum(0)
        votes = near[first] + near[second]
        if (votes > 0).sum() >= 2:
            break
    k = int(votes.argmax())
    ends = [crossed[first[k]], crossed[second[k]]]
    far = np.array([[np.linalg.norm(p - q) for q in own] for p in ends])
    good = (far <= reach).any(1)
    if not good.any():
        ends = [own[0], own[1]]
    elif not good.all():  # the bad one gives way to the line's own end that the good one is not at
        ends[int(good[0])] = own[1 - int(far[int(not good[0])].argmin())]
    return *ends[0], *ends[1], int(votes[k])


def wall_ends(fitted: DataFrame, points: DataFrame, key: str, within: float, radius: float = 0.5, factor: float = 2.0, most: int = 5, reach: float = 1.0) -> DataFrame:
    """(key, line, x0, y0, x1, y1, inliers): the ends of each fitted line among its crossings with the others.

    fitted has key, line, ax, ay, bx, by; points key, x, y. A line's points are those within the distance that no line
    before it has. Of all pairs of crossings (once each after rounding to five places) the first with most of the line's
    points around either is taken; where fewer than two pairs have any, the radius grows by the factor, up to `most`
    tries. An end farther than `reach` from both ends of the line's points gives way to one of these. A plan's lines and
    points are one group.
    """
    kind = dict(fitted.dtypes)[key]

    def step(group: tuple, lines_: pd.DataFrame, dots: pd.DataFrame) -> pd.DataFrame:
        lines_, left, out = lines_.sort_values("line"), dots[["x", "y"]].to_numpy(float), []
        rows = lines_[["ax", "ay", "bx", "by"]].to_numpy(float)
        for k, (ax, ay, bx, by) in enumerate(rows):
            mine = np.abs(bx * (left[:, 1] - ay) - by * (left[:, 0] - ax)) <= within
            if not mine.any():
                continue
            other = np.delete(rows, k, 0)
            den = bx * other[:, 3] - by * other[:, 2]
            ok = np.abs(den) >= 1e-9
            t = ((other[ok, 0] - ax) * other[ok, 3] - (other[ok, 1] - ay) * other[ok, 2]) / den[ok]
            crossed = np.unique(np.round(np.stack([ax + t * bx, ay + t * by], 1), 5) + 0.0, axis=0)
            found = _ends(ax, ay, bx, by, left[mine], crossed, radius, factor, most, reach)
            out.append((group[0], int(lines_["line"].iloc[k]), *map(float, found[:4]), found[4]))
            left = left[~mine]
        return pd.DataFrame(out, columns=[key, "line", "x0", "y0", "x1", "y1", "inliers"])

    a, b = fitted.select(key, "line", "ax", "ay", "bx", "by").groupBy(key), points.select(key, "x", "y").groupBy(key)
    return a.cogroup(b).applyInPandas(step, f"{key} {kind}, line int, x0 double, y0 double, x1 double, y1 double, inliers long")


def wall_corners(crossed: DataFrame, points: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, line, x0, y0, x1, y1, inliers): for each line the two of its crossings between which most points lie near it.

    crossed has lines (key, line, ax, ay, bx, by: a point and a unit direction), points (key, x, y). Crossings with all
    other lines, once each after rounding to five places, are candidates; a pair's inliers are the points within the
    radius of the line whose foot lies between the two. The first pair in order of place wins. A plan's lines are few.
    """
    other = crossed.select(key, *(F.col(c).alias(f"o_{c}") for c in ("line", "ax", "ay", "bx", "by")))
    pairs = crossed.join(other, key).where("line <> o_line")
    den = G.cross(F.col("bx"), F.col("by"), F.col("o_bx"), F.col("o_by"))
    t = F.when(F.abs(den) >= 1e-9, G.cross(F.col("o_ax") - F.col("ax"), F.col("o_ay") - F.col("ay"), F.col("o_bx"), F.col("o_by")) / den)
    ends = pairs.select(key, "line", "ax", "ay", "bx", "by", (F.floor(t * 1e5 + 0.5) / 1e5).alias("t")).where("t is not null").distinct()
    far = ends.select(key, "line", F.col("t").alias("t2"))
    spans = ends.join(far, [key, "line"]).where("t < t2")
    met = spans.join(points.select(key, "x", "y"), key)
    off = F.abs(F.expr("bx * (y - ay) - by * (x - ax)")) <= radius
    foot = F.expr("bx * (x - ax) + by * (y - ay)").between(F.col("t"), F.col("t2"))
    counted = met.groupBy(key, "line", "ax", "ay", "bx", "by", "t", "t2").agg(F.count_if(off & foot).alias("inliers"))
    best = F.max_by(F.struct("ax", "ay", "bx", "by", "t", "t2", "inliers"), F.struct("inliers", -F.col("t"), -F.col("t2")))
    b = counted.groupBy(key, "line").agg(best.alias("b")).select(key, "line", "b.*")
    place = [F.expr(f"a{c} + {t} * b{c}").alias(f"{c}{k}") for k, t in enumerate(("t", "t2")) for c in "xy"]
    return b.select(key, "line", *place, "inliers")


def traced_wall(walls: DataFrame, width: int) -> DataFrame:
    """walls (..., u0, v0, u1, v1: pixel columns and latitudes of two floor corners) with a row for each column between.

    A wall is straight in the room: its floor points are those of the line between the corners' places on the floor
    plane. It goes the short way round, over the seam where the columns are half the width apart or more.
    """
    gap = F.pmod(F.floor("u1").cast("int") - F.floor("u0").cast("int"), F.lit(width))
    steps = F.when(gap <= width // 2, gap).otherwise(gap - width)
    at = walls.withColumn("_n", steps).withColumn("_k", F.explode(F.expr("sequence(0, _n, if(_n >= 0, 1, -1))")))
    angle = lambda u: (u + 0.5) / width * (2 * math.pi) - math.pi
    x = lambda u, v: F.sin(angle(F.col(u))) / F.tan(F.col(v))
    y = lambda u, v: F.cos(angle(F.col(u))) / F.tan(F.col(v))
    at = at.withColumns({"_x0": x("u0", "v0"), "_y0": y("u0", "v0"), "_x1": x("u1", "v1"), "_y1": y("u1", "v1")})
    col = F.pmod(F.floor("u0").cast("int") + F.col("_k"), F.lit(width))
    a = angle(col)
    dx, dy = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    den = F.sin(a) * dy - F.cos(a) * dx
    r = F.when(F.abs(den) > 1e-12, (F.col("_x0") * dy - F.col("_y0") * dx) / den)
    return at.withColumn("col", col).withColumn("v", F.when(r.isNull(), F.col("v0")).otherwise(F.atan(1 / r))).select(*walls.columns, "col", "v")


def stretched(corners: DataFrame, kx: float, ky: float) -> DataFrame:
    """corners (..., u: longitude, v: latitude) of a panorama whose room is stretched by kx and ky along its axes."""
    x, y = F.sin("u") * kx, F.cos("u") * ky
    return corners.withColumn("v", F.atan(F.tan("v") / F.sqrt(x * x + y * y))).withColumn("u", F.atan2(x, y))


def split_at_seam(polyline: DataFrame, keys: list[str], order: str, x: str) -> DataFrame:
    """polyline with `part`, which goes up where x falls back over the image's seam."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    back = F.when(F.col(x) - F.lag(x).over(w) < 0, 1).otherwise(0)
    return polyline.withColumn("_back", back).withColumn("part", F.sum("_back").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_back")


def inside(points: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of points (keys, x, y, ...) that lie in their polygon (keys, corners: array of x, y), by ray casting."""
    joined = points.join(polygons.select(*keys, "corners"), keys)
    crossings = F.expr("""aggregate(sequence(0, size(corners) - 1), 0, (n, k) -> n + if(
        (corners[k].y > y) <> (corners[(k + 1) % size(corners)].y > y)
        and x < (corners[(k + 1) % size(corners)].x - corners[k].x) * (y - corners[k].y) / (corners[(k + 1) % size(corners)].y - corners[k].y) + corners[k].x, 1, 0))""")
    return joined.where(crossings % 2 == 1).select(points.columns)


def spread_points(polygons: DataFrame, keys: list[str], n: int, tries: int = 64, seed: int = 0) -> DataFrame:
    """(keys, x, y): up to n well-spread points in each polygon: hashed points in its box, kept where inside, and thinned
    to the one nearest the middle of each of n groups by angle about the centroid."""
    box = polygons.select(*keys, "corners", *(F.expr(f"array_{f}(transform(corners, c -> c.{c}))").alias(f"{f}{c}") for f in ("min", "max") for c in "xy"))
    unit = lambda k: F.pmod(F.xxhash64(*keys, "i", F.lit(seed * 2 + k)), F.lit(1 << 30)) / float(1 << 30)
    dots = box.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(tries * n - 1))))
    dots = dots.withColumn("x", F.expr("minx") + unit(0) * F.expr("maxx - minx")).withColumn("y", F.expr("miny") + unit(1) * F.expr("maxy - miny"))
    kept = inside(dots.select(*keys, "i", "x", "y"), polygons, keys)
    middle = kept.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    turned = kept.join(middle, keys).withColumn("sector", F.floor((F.expr("atan2(y - my, x - mx)") / (2 * math.pi) + 0.5) * n))
    centre = turned.groupBy(*keys, "sector").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    near = turned.join(centre, [*keys, "sector"]).withColumn("d", F.expr("pow(x - cx, 2) + pow(y - cy, 2)"))
    best = near.groupBy(*keys, "sector").agg(F.min_by(F.struct("x", "y"), F.struct("d", "i")).alias("p"))
    return best.select(*keys, "p.x", "p.y")


def _axes(segments: list[np.ndarray], tolerance: float, margin: float) -> list[tuple[int, float]]:
    """(axis, place) of each wall of a ring: axis 0 holds x, axis 1 holds y.

    Walls are decided by how well their better axis fits, best first. One beside a decided wall turns against it, unless
    the same axis fits it better by the margin.
    """
    middle = [np.median(s, axis=0) for s in segments]
    fit = np.array([(np.abs(s - m) <= tolerance).mean(0) for s, m in zip(segments, middle)])
    n, axis = len(segments), [-1] * len(segments)
    for k in sorted(range(n), key=lambda k: (-fit[k].max(), k)):
        near = {axis[(k - 1) % n], axis[(k + 1) % n]} - {-1}
        best = int(fit[k, 1] > fit[k, 0])
        turned = 1 - next(iter(near)) if len(near) == 1 else best
        axis[k] = turned if fit[k, turned] + margin >= fit[k, 1 - turned] else 1 - turned
    return [(a, float(m[a])) for a, m in zip(axis, middle)]


def manhattan_walls(boundary: DataFrame, key: str, tolerance: float = 0.1, margin: float = 0.25) -> DataFrame:
    """(key, seq, x, y): the corners of a room with walls along x or y, from its boundary's segments in ring order.

    boundary has key, segment, col, x, y. Where two neighbours run along one axis, they become one wall if their places
    are within the tolerance, and else a wall between them is put in where one segment ends and the next begins.
    """
    kind = dict(boundary.dtypes)[key]

    def step(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [r.sort_values("col")[["x", "y"]].to_numpy(float) for _, r in rows.groupby("segment", sort=True)]
        walls, k = _axes(parts, tolerance, margin), 0
        while len(walls) > 1 and k < len(walls):
            (a, p), (b, q) = walls[k], walls[(k + 1) % len(walls)]
            if a == b and abs(p - q) <= tolerance:
                j = (k + 1) % len(walls)
                parts[k] = np.concatenate([parts[k], parts[j]])
                walls[k] = a, float(np.median(parts[k][:, a]))
                del walls[j], parts[j]
                k -= j < k
            else:
                k += 1
        out = []
        for k, (a, p) in enumerate(walls):
            j = (k + 1) % len(walls)
            b, q = walls[j]
            if a != b:
                out.append((p, q) if a == 0 else (q, p))
            elif len(walls) > 1:
                cut = float((parts[k][-1, 1 - a] + parts[j][0, 1 - a]) / 2)
                out += [(p, cut), (q, cut)] if a == 0 else [(cut, p), (cut, q)]
        return pd.DataFrame([(group[0], i, x, y) for i, (x, y) in enumerate(out)], columns=[key, "seq", "x", "y"])

    return boundary.select(key, "segment", "col", "x", "y").groupBy(key).applyInPandas(step, f"{key} {kind}, seq int, x double, y double")


def corner_pixels(corners: DataFrame, key: str, floor: Column, height: int, width: int) -> DataFrame:
    """corners (key, seq, x, y) with their pixels u, v on the image, numbered on from the leftmost one.

    The camera is at the origin, the floor so far below it; columns and rows are at half pixels.
    """
    from pyspark.sql import Window

    u = (F.atan2("x", "y") / (2 * math.pi) + 0.5) * width - 0.5
    v = (F.atan2(floor, F.sqrt(F.expr("x * x + y * y"))) / math.pi + 0.5) * height - 0.5
    seen = corners.withColumn("u", u).withColumn("v", v)
    whole = Window.partitionBy(key)
    first, n = F.min_by("seq", F.struct("u", "seq")).over(whole), F.count("*").over(whole)
    return seen.withColumn("seq", F.pmod(F.col("seq") - first, n).cast("int"))
