"""Histograms, robust line fitting and normal equations, grouped by key."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """(keys, bin, n): equal bins over each key's range, the last one closed, empty ones as 0."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("mn"), F.max(value).alias("mx"))
    place = F.least(F.floor((F.col(value) - F.col("mn")) / (F.col("mx") - F.col("mn")) * bins), F.lit(bins - 1)).cast("int")
    counts = df.join(ends, keys).groupBy(*keys, F.coalesce(place, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def uniformity(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, uniformity): 1 less the share of the worst squared deviation from equal bins, less 0.9; -1 for no rows."""
    sums = bins.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("bins"))
    mean = F.col("total") / F.col("bins")
    spread = F.col("squares") - F.col("total") * mean
    return sums.select(*keys, F.when(F.col("total") == 0, -1.0).otherwise(1 - spread / (F.col("total") - mean) ** 2 - 0.9).alias("uniformity"))


def normal_equations(df: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """(keys, i, j, value): sums of products of features, and with j -1 of features and the target, in one pass."""
    cells = [(i, j, F.col(a) * F.col(b)) for i, a in enumerate(features) for j, b in enumerate(features)]
    cells += [(i, -1, F.col(a) * F.col(target)) for i, a in enumerate(features)]
    summed = df.groupBy(*keys).agg(*(F.sum(v.cast("double")).alias(f"s{k}") for k, (_, _, v) in enumerate(cells)))
    long = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{k}").alias("value")) for k, (i, j, _) in enumerate(cells))))
    return summed.select(*keys, long.alias("c")).select(*keys, "c.i", "c.j", "c.value")


def _pairs(n: int, block: int, drawn: int | None, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of n places in order, in blocks; if there are more than `drawn`, so many drawn by the seed, in order."""
    if drawn is not None and n * (n - 1) // 2 > drawn:
        some = np.sort(np.random.default_rng(seed).integers(0, n, (drawn, 2)), 1)
        some = np.unique(some[some[:, 0] < some[:, 1]], axis=0)
        for at in range(0, len(some), block):
            yield some[at : at + block, 0], some[at : at + block, 1]
        return
    low = 0
    while low < n - 1:
        high = min(n - 1, low + max(1, block // n))
        size = n - 1 - np.arange(low, high)
        first = np.repeat(np.arange(low, high), size)
        yield first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
        low = high


def _judged(x: np.ndarray, y: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray, n: int, within: float, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inliers, uniformity, score) of the lines from points i to points j, over all points as often as their weights say."""
    dx, dy = x[j] - x[i], y[j] - y[i]
    size = np.sqrt(dx * dx + dy * dy)
    bx, by = dx / size, dy / size
    right, up = x[None, :] - x[i][:, None], y[None, :] - y[i][:, None]
    near = np.abs(bx[:, None] * up - by[:, None] * right) <= within
    votes = near @ weight
    even = np.zeros(len(i))
    if weights[1]:
        along = bx[:, None] * right + by[:, None] * up
        low, high = np.where(near, along, np.inf).min(1), np.where(near, along, -np.inf).max(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            place = np.minimum(np.floor((along - low[:, None]) / (high - low)[:, None] * 10), 9)
        row, col = np.nonzero(near)
        held = np.bincount(row * 10 + np.nan_to_num(place[row, col]).astype(np.int64), weight[col], 10 * len(i)).astype(np.int64).reshape(-1, 10)
        # a tenth of the inliers is expected in each of ten bins: the squares' sums are whole numbers
        even = 1 - (10 * (held * held).sum(1) - votes * votes) / (8.1 * votes * votes) - 0.9
    return votes, even, np.floor((weights[0] * votes / n + weights[1] * even) * 1e9 + 0.5)


def _most_near(p: np.ndarray, q: np.ndarray, weight: np.ndarray, own: np.ndarray, lean: float, reach: float) -> np.ndarray:
    """For the lines through each point `own` that rise or fall by at most `lean` along q, at least as many points as any has within reach.

    Such a line is at p = s where q is 0, with s within |q| * lean of its point's p, and passes a point within as much of s.
    """
    slack = np.abs(q) * lean
    low, high = p - slack, p + slack
    first, last = np.argsort(low), np.argsort(high)
    begun, ended = np.r_[0, np.cumsum(weight[first])], np.r_[0, np.cumsum(weight[last])]
    return begun[np.searchsorted(low[first], high[own] + reach, "right")] - ended[np.searchsorted(high[last], low[own] - reach, "left")]


def _pairs_within(p: np.ndarray, q: np.ndarray, lean: float, tiny: float, size: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, the first from low to high and the second among the next `size`, whose lines rise or fall by at most `lean`."""
    some = size[low:high]
    i = np.repeat(np.arange(low, high), some)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
    inside = p[j] - p[i] <= np.abs(q[j] - q[i]) * lean * (1 + 1e-9) + tiny
    return i[inside], j[inside]


def _straight(u: np.ndarray, v: np.ndarray, weight: np.ndarray, at: float, n: int, within: float, weights: tuple[float, float]) -> tuple[float, bool]:
    """At least the score of any line through points at u = at, and whether all of these lines score the same.

    They have the same points near, at the same places along them but for rounding: that moves only points at an end of a
    tenth, here spread over the tenths as evenly as can be.
    """
    near = np.abs(u - at) <= within
    along, held = v[near], weight[near]
    votes, even, at_end = int(held.sum()), 0.0, np.zeros(len(along), bool)
    if weights[1]:
        place = (along - along.min()) / np.ptp(along) * 10
        end = np.round(place)
        at_end = (np.abs(place - end) < 1e-9) & (end > 0) & (end < 10)
        sums = np.sort(np.bincount(np.minimum(place[~at_end].astype(int), 9), held[~at_end], 10))
        level = (np.cumsum(sums) + held[at_end].sum()) / np.arange(1, 11)
        filled = np.maximum(sums, level[np.flatnonzero(level <= np.r_[sums[1:], np.inf])[0]])
        even = 0.1 + 1e-9 - (10 * (filled * filled).sum() - votes * votes) / (8.1 * votes * votes)
    return float(np.floor((weights[0] * votes / n + weights[1] * even) * 1e9 + (1.5 if weights[1] else 0.5))), not at_end.any()


def _best_drawn(x: np.ndarray, y: np.ndarray, within: float, weights: tuple[float, float], drawn: int, seed: int, block: int) -> tuple[int, int, int, float, float] | None:
    best, n = None, len(x)
    for first, second in _pairs(n, max(1, block // max(1, n)), drawn, seed):
        dx, dy = x[second] - x[first], y[second] - y[first]
        good = np.sqrt(dx * dx + dy * dy) > 0
        i, j = first[good], second[good]
        if not len(i):
            continue
        votes, even, score = _judged(x, y, np.ones(n, np.int64), i, j, n, within, weights)
        k = int(score.argmax())
        if best is None or score[k] > best[4]:
            best = int(i[k]), int(j[k]), int(votes[k]), float(even[k]), float(score[k])
    return best


def _best_line(x: np.ndarray, y: np.ndarray, within: float, weights: tuple[float, float] = (1.0, 0.0), drawn: int | None = None, seed: int = 0, block: int = 1 << 20) -> tuple[int, int, int, float, float] | None:
    """(i, j, inliers, uniformity, score) of the line through two of the points that scores highest; the first pair of equals.

    The score is the share of points near the line and the uniformity of those along it, by `weights`; scores that agree
    in nine places are equal. Points that repeat are tried once, and count as often as they are there. Lines are sought
    by cells of directions, those with the highest bound of a score first, from the number of points near any line of a
    cell through a point. A cell is halved until it has few pairs; it and its pairs are left out where their bound can't
    win, so what is found is the best of all pairs.
    """
    n = len(x)
    if drawn is not None and n * (n - 1) // 2 > drawn:
        best = _best_drawn(x, y, within, weights, drawn, seed, block)
        return best if best is None else (*best[:4], best[4] / 1e9)
    known = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    if not len(known):
        return None
    points, kind = np.unique(np.stack([x[known], y[known]], 1), axis=0, return_inverse=True)
    kind = kind.ravel()
    by_kind = np.lexsort((known, kind))
    places, weight = known[by_kind], np.bincount(kind)
    start = np.cumsum(weight) - weight
    kind_ends = start + weight
    px, py, first, last, m = points[:, 0], points[:, 1], places[start], places[kind_ends - 1], len(points)
    mx, my = px - (px.min() + px.max()) / 2, py - (py.min() + py.max()) / 2
    tiny = 1e-9 * (within + np.hypot(mx, my).max())
    best, known_straight = None, {}

    def ceiling(most: np.ndarray) -> np.ndarray:
        """At least the score of a line with so many points near."""
        return np.floor((weights[0] * most / n + weights[1] * (0.1 + 1e-9)) * 1e9 + (1.5 if weights[1] else 0.5))

    def wins(bound: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whether lines from points `of` may win; those from later points by more only."""
        return bound >= (-np.inf if best is None else best[4] + (first[of] > best[0]))

    def straight(i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The bounds with those of lines along an axis; of lines that score the same, only those from the first point stay."""
        for u, v in ((px, py), (py, px)):
            same = np.flatnonzero(u[i] == u[j])
            for at in np.unique(u[i[same]]).tolist():
                if (id(u), at) not in known_straight:
                    mine = np.flatnonzero(u == at)
                    known_straight[id(u), at] = *_straight(u, v, weight, at, n, within, weights), first[mine].min()
                most, equal, least = known_straight[id(u), at]
                of = same[u[i[same]] == at]
                bound[of] = np.where(equal & (first[i[of]] != least), -np.inf, np.minimum(bound[of], most))
        return bound

    def judge(i: np.ndarray, j: np.ndarray, among: np.ndarray) -> None:
        nonlocal best
        at = np.empty(m, np.int64)
        at[among] = np.arange(len(among))
        votes, even, score = _judged(px[among], py[among], weight[among], at[i], at[j], n, within, weights)
        top = np.flatnonzero(score == score.max())
        for k in top[first[i[top]] == first[i[top]].min()].tolist():
            second = places[start[j[k]] : kind_ends[j[k]]]
            second = int(second[np.searchsorted(second, first[i[k]], "right")])
            if best is None or (score[k], -first[i[k]], -second) > (best[4], -best[0], -best[1]):
                best = int(first[i[k]]), second, int(votes[k]), float(even[k]), float(score[k])

    cell, cells = 16, [(-np.inf, k, (k + 0.5) * np.pi / 32, np.pi / 64, np.arange(m)) for k in range(32)]
    while cells:
        key, _, angle, half, own = heapq.heappop(cells)
        # a line may go from either of its points: only the first of all is early for sure
        if not wins(-key, first.argmin()):
            break
        p, q, lean = np.cos(angle) * my - np.sin(angle) * mx, np.cos(angle) * mx + np.sin(angle) * my, np.tan(half)
        reach, slack = within / np.cos(half) + tiny, np.abs(q).max() * lean
        most = ceiling(_most_near(p, q, weight, own, lean, reach))
        some = np.flatnonzero(wins(most, first.argmin()))
        some = some[np.argsort(p[own[some]], kind="stable")]
        own, most = own[some], most[some]
        if len(own) < 2:
            continue
        op, oq = p[own], q[own]
        size = np.searchsorted(op, op + np.ptp(oq) * lean * (1 + 1e-9) + tiny, "right") - np.arange(len(own)) - 1
        if size.sum() > 2000 and slack > max(within / 1000, tiny):
            for k, side in enumerate((-0.5, 0.5)):
                heapq.heappush(cells, (-most.max(), 2 * cell + k, angle + side * half, half / 2, own))
            cell += 1
            continue
        ends = np.searchsorted(np.cumsum(size), np.arange(block >> 2, size.sum() + block, block >> 2), "right")
        bounds = np.unique(np.r_[0, ends, len(own)])
        by_p = np.argsort(p, kind="stable")
        sorted_p = p[by_p]
        for low, high in sorted(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), key=lambda c: -most[c[0] : c[1]].max()):
            i, j = _pairs_within(op, oq, lean, tiny, size, low, high)
            bound, i, j = np.minimum(most[i], most[j]), own[i], own[j]
            i, j, bound = np.r_[i, j], np.r_[j, i], np.r_[bound, bound]
            good = wins(bound, i) & (last[j] > first[i]) & (np.sqrt((px[j] - px[i]) ** 2 + (py[j] - py[i]) ** 2) > 0)
            i, j, bound = i[good], j[good], bound[good]
            bound = straight(i, j, bound)
            lead = np.lexsort((first[i], -bound))[:16]
            if len(lead):
                judge(i[lead], j[lead], by_p)
            good = np.flatnonzero(wins(bound, i))
            good = good[np.argsort(p[i[good]], kind="stable")]
            i, j, bound = i[good], j[good], bound[good]
            from_p, at = p[i], 0
            while at < len(i):
                end = max(int(np.searchsorted(from_p, from_p[at] + within / 2, "right")), at + (block >> 4) // m)
                end = min(end, at + 128 + (block >> 4) // m, len(i))
                some = at + np.flatnonzero(wins(bound[at:end], i[at:end]))
                near = by_p[np.searchsorted(sorted_p, from_p[at] - 2 * slack - reach) : np.searchsorted(sorted_p, from_p[end - 1] + 2 * slack + reach, "right")]
                if len(some):
                    judge(i[some], j[some], near)
                at = end
    return best if best is None else (*best[:4], best[4] / 1e9)


def best_line(points: DataFrame, keys: list[str], tag: str, x: str, y: str, within: float) -> DataFrame:
    """(keys, i, j, inliers, share): of all lines through two of a key's points the one with most inliers; first wins.

    Every pair is a hypothesis, so the result is the same each time; points that are equal make none. A key's points are
    few by their meaning (the border of one wall), so a key is one group; its lines are judged in blocks of bounded size.
    """
    return extract_lines(points, keys, tag, x, y, within, 1).drop("round")


def fit_lines(points: DataFrame, keys: list[str], tag: str, x: str, y: str, within: float, weights: tuple[float, float] = (1.0, 1.0), outliers: float = 0.1, drawn: int | None = 10_000, lines: int | None = None) -> DataFrame:
    """(keys, line, i, j, ax, ay, bx, by, inliers, uniformity, score): lines taken one after another from each key's points.

    A line goes through the points i and j, from (ax, ay) in the unit direction (bx, by). Each is the one that scores
    highest among the points that earlier ones leave: weights[0] times the share of points within the distance, and
    weights[1] times how evenly these lie along it. It ends where at most `outliers` of the key's points are left, or
    none of those left scores above 0, or there are `lines` of them. Up to `drawn` pairs all are tried, beyond that so
    many drawn by a hash of the key. A key's points are those of one plan's walls, and one group. Points that are equal
    make no line.
    """
    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"line int, i {kinds[tag]}, j {kinds[tag]}, ax double, ay double, bx double, by double, inliers long, uniformity double, score double"])

    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values(tag, kind="stable"), []
        names, px, py = rows[tag].to_numpy(), rows[x].to_numpy(float), rows[y].to_numpy(float)
        left = np.arange(len(rows))
        while len(left) > max(1, outliers * len(rows)) and (lines is None or len(out) < lines):
            found = _best_line(px[left], py[left], within, weights, drawn, zlib.crc32(repr(key).encode()))
            if found is None or found[4] <= 0:
                break
            i, j = left[found[0]], left[found[1]]
            size = np.hypot(px[j] - px[i], py[j] - py[i])
            bx, by = (px[j] - px[i]) / size, (py[j] - py[i]) / size
            out.append((*key, len(out), names[i], names[j], px[i], py[i], bx, by, *found[2:]))
            left = left[np.abs(bx * (py[left] - py[i]) - by * (px[left] - px[i])) > within]
        return pd.DataFrame(out, columns=[*keys, "line", "i", "j", "ax", "ay", "bx", "by", "inliers", "uniformity", "score"])

    return points.select(*keys, tag, x, y).groupBy(*keys).applyInPandas(step, schema)


def extract_lines(points: DataFrame, keys: list[str], tag: str, x: str, y: str, within: float, rounds: int) -> DataFrame:
    """(round, keys, i, j, inliers, share): each round's best line, found among the points that earlier lines leave."""
    kinds = dict(points.dtypes)
    schema = ", ".join(["round int", *(f"`{k}` {kinds[k]}" for k in keys), f"i {kinds[tag]}", f"j {kinds[tag]}", "inliers long", "share double"])

    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values(tag, kind="stable"), []
        names, px, py = rows[tag].to_numpy(), rows[x].to_numpy(float), rows[y].to_numpy(float)
        for k in range(1, rounds + 1):
            found = _best_line(px, py, within)
            if found is None:
                break
            i, j, inliers = found[:3]
            out.append((k, *key, names[i], names[j], inliers, inliers / len(px)))
            dx, dy = px[j] - px[i], py[j] - py[i]
            size = np.sqrt(dx * dx + dy * dy)
            left = np.abs(dx / size * (py - py[i]) - dy / size * (px - px[i])) > within
            names, px, py = names[left], px[left], py[left]
        return pd.DataFrame(out, columns=["round", *keys, "i", "j", "inliers", "share"])

    return points.select(*keys, tag, x, y).groupBy(*keys).applyInPandas(step, schema)


def best_affine(pairs: DataFrame, keys: list[str], order: str, tolerance: float) -> DataFrame:
    """(keys, order, outliers, n): of the affine maps through three consecutive pairs (x, y) -> (u, v) the one with fewest
    outliers in its group, the first of equals. A map is solved in closed form; three points on a line make none.
    Coordinates may be decimals, whose differences are exact."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    cols = ("x", "y", "u", "v")
    triples = pairs.select(*keys, order, *(F.lead(c, k).over(w).alias(f"{c}{k}") for k in range(3) for c in cols)).where("x2 is not null")
    det = "((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))"
    solved = triples.where(f"abs({det}) > 1e-9").select(
        *keys, order, *(F.col(f"{c}0").cast("double").alias(f"{c}0") for c in cols), *(F.expr(f"(({t}1 - {t}0) * (y2 - y0) - ({t}2 - {t}0) * (y1 - y0)) / {det}").alias(f"{t}_x") for t in "uv"), *(F.expr(f"((x1 - x0) * ({t}2 - {t}0) - (x2 - x0) * ({t}1 - {t}0)) / {det}").alias(f"{t}_y") for t in "uv")
    )
    met = solved.join(pairs.select(*keys, *(F.col(c).cast("double").alias(c) for c in cols)), keys)
    error = F.expr("sqrt(pow(u0 + u_x * (x - x0) + u_y * (y - y0) - u, 2) + pow(v0 + v_x * (x - x0) + v_y * (y - y0) - v, 2))")
    counted = met.groupBy(*keys, order).agg(F.count_if(error > tolerance).alias("outliers"), F.count("*").alias("n"))
    best = F.min_by(F.struct(order, "outliers", "n"), F.struct("outliers", order))
    return counted.groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{order}", "b.outliers", "b.n")
