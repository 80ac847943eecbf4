"""Plane and sphere geometry as column expressions.

Conventions are part of the names: c1 rays put columns at half pixels and z down the rows; c2 is longitude and latitude
with y up; c3 permutes axes by plane; quaternions have the scalar first and rotate passively.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def norm(*xs: Column) -> Column:
    return F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))


def clamped_projection(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """(x, y, distance) of the point of the segment from a to b nearest to p; a segment of no length is its start."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size)))
    x, y = ax + t * dx, ay + t * dy
    return x, y, norm(px - x, py - y)


def crossing(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column, x4: Column, y4: Column, least: float = 1e-9) -> tuple[Column, Column]:
    """Where the lines through two segments cross, null for parallel ones."""
    den = cross(x2 - x1, y2 - y1, x4 - x3, y4 - y3)
    t = F.when(F.abs(den) >= least, cross(x3 - x1, y3 - y1, x4 - x3, y4 - y3) / den)
    return x1 + t * (x2 - x1), y1 + t * (y2 - y1)


def similarity(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column, x4: Column, y4: Column) -> Column:
    """Signed cosine between two segments, null where one has no length."""
    dot = (x2 - x1) * (x4 - x3) + (y2 - y1) * (y4 - y3)
    return dot / F.nullif(norm(x2 - x1, y2 - y1) * norm(x4 - x3, y4 - y3), F.lit(0.0))


def mirrored_similarity(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column, x4: Column, y4: Column) -> Column:
    """The similarity with the second segment flipped: its y where both differ more in x, else its x."""
    along = F.abs(x2 - x1) >= F.abs(y2 - y1)
    flipped_y = similarity(x1, y1, x2, y2, x3, -y3, x4, -y4)
    return F.when(along, flipped_y).otherwise(similarity(x1, y1, x2, y2, -x3, y3, -x4, y4))


def separation(x_sep: Column, y_sep: Column, to_point: Column, alike: Column, mirror: Column) -> Column:
    return (y_sep + to_point) / (x_sep + 1e-3) * (1 - alike) * mirror


def line_box(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    """The part of a line in a box: the second least and second greatest of its four crossings with the box's sides."""
    cuts = F.array_sort(F.array((x0 - ax) / F.nullif(bx, F.lit(0.0)), (x1 - ax) / F.nullif(bx, F.lit(0.0)), (y0 - ay) / F.nullif(by, F.lit(0.0)), (y1 - ay) / F.nullif(by, F.lit(0.0))))
    cuts = F.filter(cuts, lambda c: c.isNotNull())
    low = F.when(F.size(cuts) == 4, F.try_element_at(cuts, F.lit(2))).otherwise(F.try_element_at(cuts, F.lit(1)))
    high = F.when(F.size(cuts) == 4, F.try_element_at(cuts, F.lit(3))).otherwise(F.try_element_at(cuts, F.lit(2)))
    return ax + low * bx, ay + low * by, ax + high * bx, ay + high * by


def c1_ray(row: Column, col: Column, height: int, width: int) -> tuple[Column, Column, Column]:
    """The unit ray through a pixel of an equirectangular image, columns and rows at half pixels."""
    u, v = (col + 0.5) / width * (2 * PI), ((row + 0.5) / height - 0.5) * PI
    return F.cos(v) * F.cos(u), F.cos(v) * F.sin(u), -F.sin(v)


def c2_pixel(x: Column, y: Column, z: Column, height: int, width: int) -> tuple[Column, Column]:
    """(u, v) of a direction: longitude from z towards x, latitude from y."""
    lon, lat = F.atan2(x, z), F.asin(y / norm(x, y, z))
    return (lon / PI + 1) / 2 * width, (0.5 - lat / PI) * height


def c2_ray(u: Column, v: Column, height: int, width: int) -> tuple[Column, Column, Column]:
    lon, lat = (u / width * 2 - 1) * PI, (0.5 - v / height) * PI
    return F.cos(lat) * F.sin(lon), F.sin(lat), F.cos(lat) * F.cos(lon)


def c3_uv(x: Column, y: Column, z: Column, plane: Column) -> tuple[Column, Column]:
    """(u, v) of a direction with the axes cycled by plane 1, 2 or 3."""
    a = F.when(plane == 1, x).when(plane == 2, y).otherwise(z)
    b = F.when(plane == 1, y).when(plane == 2, z).otherwise(x)
    c = F.when(plane == 1, z).when(plane == 2, x).otherwise(y)
    return F.atan2(a, b), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c / norm(x, y, z))))


def c3_xyz(u: Column, v: Column, plane: Column) -> tuple[Column, Column, Column]:
    a, b, c = F.cos(v) * F.sin(u), F.cos(v) * F.cos(u), F.sin(v)
    pick = lambda one, two, three: F.when(plane == 1, one).when(plane == 2, two).otherwise(three)
    return pick(a, c, b), pick(b, a, c), pick(c, b, a)


def great_circle_v(nx: Column, ny: Column, nz: Column, u: Column, plane: Column) -> Column:
    """The latitude at longitude u of the great circle with a normal, axes cycled by plane."""
    a = F.when(plane == 1, nx).when(plane == 2, ny).otherwise(nz)
    b = F.when(plane == 1, ny).when(plane == 2, nz).otherwise(nx)
    c = F.when(plane == 1, nz).when(plane == 2, nx).otherwise(ny)
    return F.atan(-(F.sin(u) * a + F.cos(u) * b) / (c + 1e-12))


def floor_plane(row: Column, col: Column, z: Column, height: int, width: int) -> tuple[Column, Column]:
    """(x, y) on the plane at height z below the pixel, in pixels about the image's middle."""
    u, v = ((col + 0.5) / width - 0.5) * (2 * PI), -((row + 0.5) / height - 0.5) * PI
    c = z / F.tan(v)
    return c * F.sin(u) + width / 2 - 0.5, -c * F.cos(u) + height / 2 - 0.5


def perspective_ray(px: Column, py: Column, width: int, height: int, fov: float, yaw: Column, pitch: Column) -> tuple[Column, Column, Column]:
    """The direction of a perspective view's pixel, turned by pitch and then yaw (degrees)."""
    f = 0.5 * width / math.tan(0.5 * fov * PI / 180)
    x, y, z = px - (width - 1) / 2, -(py - (height - 1) / 2), F.lit(f)
    a, b = F.radians(pitch), F.radians(yaw)
    y2, z2 = y * F.cos(a) + z * F.sin(a), -y * F.sin(a) + z * F.cos(a)
    return x * F.cos(b) + z2 * F.sin(b), y2, -x * F.sin(b) + z2 * F.cos(b)


def perspective_pixel(x: Column, y: Column, z: Column, width: int, height: int, fov: float) -> tuple[Column, Column]:
    """Where an unturned view sees a direction, null behind it or outside its frame."""
    f = 0.5 * width / math.tan(0.5 * fov * PI / 180)
    px, py = F.when(z > 0, f * x / z + (width - 1) / 2), F.when(z > 0, -f * y / z + (height - 1) / 2)
    inside = (px >= 0) & (px < width) & (py >= 0) & (py < height)
    return F.when(inside, px), F.when(inside, py)


def yaw_to(dx: Column, dy: Column, rotation: Column) -> Column:
    """Degrees from a camera's heading to a target; not wrapped."""
    return F.degrees(F.atan2(dy, dx)) - rotation


def field_of_view(distance: Column, base: float = 90.0, least: float = 45.0) -> Column:
    """Narrower for far targets: base up to distance 2, then in proportion down to the least."""
    return F.when(distance > 2, F.greatest(F.lit(least), base * F.least(F.lit(1.0), 2 / distance))).otherwise(base)


def homogeneous(h: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3 x 3 homography in row order, null at infinity."""
    w = F.nullif(h[6] * x + h[7] * y + h[8], F.lit(0.0))
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def rotated(q: tuple[Column, ...], p: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """p turned by the passive rotation (2 s^2 - 1) I + 2 e e' - 2 s [e]x of the unit quaternion q = (s, e)."""
    s, a, b, c = q
    x, y, z = p
    dot = a * x + b * y + c * z
    k = 2 * s * s - 1
    return (
        k * x + 2 * a * dot - 2 * s * (b * z - c * y),
        k * y + 2 * b * dot - 2 * s * (c * x - a * z),
        k * z + 2 * c * dot - 2 * s * (a * y - b * x),
    )


def seen(p: tuple[Column, ...], f: Column, k1: Column, k2: Column) -> tuple[Column, Column]:
    """The image of a camera-frame point for a camera that looks down -z, with radial distortion."""
    x, y = -p[0] / p[2], -p[1] / p[2]
    r = x * x + y * y
    d = f * (1 + k1 * r + k2 * r * r)
    return d * x, d * y


def epipolar_distances(fm: list[float], x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """(of point 2 from the line of point 1, of point 1 from the line of point 2) under a fundamental matrix in row order."""

    def gap(m: list[float], ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        l0, l1, l2 = (m[3 * k] * ax + m[3 * k + 1] * ay + m[3 * k + 2] for k in range(3))
        return F.abs(l0 * bx + l1 * by + l2) / F.nullif(norm(l0, l1), F.lit(0.0))

    turned = [fm[3 * j + k] for k in range(3) for j in range(3)]
    return gap(fm, x1, y1, x2, y2), gap(turned, x2, y2, x1, y1)


def within_circle(u: Column, low: Column, high: Column) -> Column:
    """Whether u lies in an interval on the ring [0, 1), which wraps where low is above high."""
    return F.when(low <= high, (u >= low) & (u <= high)).otherwise((u >= low) | (u <= high))


def intervals_meet(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two intervals on the ring share a point."""
    return within_circle(a0, b0, b1) | within_circle(a1, b0, b1) | within_circle(b0, a0, a1) | within_circle(b1, a0, a1)


def fold_angle(degrees: Column) -> Column:
    """An angle of a rectangle's side folded into (-45, 45]."""
    r = F.pmod(degrees, F.lit(90.0))
    return F.when(r > 45, r - 90).otherwise(r)


def grey(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def heading(dx: Column, dy: Column, dz: Column, degrees: Column) -> tuple[Column, Column, Column]:
    """A direction turned about the vertical by a camera's heading."""
    a = F.radians(degrees)
    return dx * F.cos(a) - dy * F.sin(a), dx * F.sin(a) + dy * F.cos(a), dz


def wall_y(x: Column, u: Column, height: int, width: int) -> Column:
    """Where on the floor plane, in pixels about the middle, the wall at x is seen at longitude u: its y."""
    return -(x - width / 2 + 0.5) / F.sin(u) * F.cos(u) + height / 2 - 0.5


def wall_x(y: Column, u: Column, height: int, width: int) -> Column:
    """The x of the wall at y at longitude u."""
    return -(y - height / 2 + 0.5) / F.cos(u) * F.sin(u) + width / 2 - 0.5


def segment_normal(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """The unit normal of the great circle through two directions; null where they are one."""
    n = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    size = F.nullif(norm(*n), F.lit(0.0))
    return n[0] / size, n[1] / size, n[2] / size


def line_at_sides(a: Column, b: Column, c: Column, width: float) -> tuple[Column, Column]:
    """The y of the line a x + b y + c = 0 at x = 0 and at x = width; null for an upright line."""
    b = F.nullif(b, F.lit(0.0))
    return -c / b, -(c + a * width) / b


def within_border(x: Column, y: Column, width: int, height: int, margin: int = 3) -> Column:
    return (x >= margin) & (x < width - margin) & (y >= margin) & (y < height - margin)


def look_at_views() -> list[tuple[float, float]]:
    """(yaw, pitch) in degrees of the crops that cover a sphere: twelve level ones, six up and six down at 45, and the poles."""
    level = [(-180.0 + 30 * k, 0.0) for k in range(12)]
    tilted = [(-180.0 + 60 * k, p) for p in (45.0, -45.0) for k in range(6)]
    return [*level, *tilted, (0.0, 90.0), (0.0, -90.0)]
