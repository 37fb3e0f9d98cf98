"""3-D vectors, rotations and rays as Column expressions: a vector is a tuple of three columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(x * s for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """Length 1; a zero vector stays as it is."""
    n = norm(a)
    return tuple(F.when(n > 0, x / n).otherwise(x) for x in a)


def struct(a: Vec, name: str) -> Column:
    return F.struct(a[0].alias("x"), a[1].alias("y"), a[2].alias("z")).alias(name)


def rotation_of(q: tuple[Column, Column, Column, Column]) -> tuple[Vec, Vec, Vec]:
    """Rows of the rotation of a unit quaternion (x, y, z, w); it is not normalised here."""
    x, y, z, w = q
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def rotate(rows: tuple[Vec, Vec, Vec], p: Vec) -> Vec:
    return tuple(dot(r, p) for r in rows)


def transpose(rows: tuple[Vec, Vec, Vec]) -> tuple[Vec, Vec, Vec]:
    return tuple(tuple(rows[j][i] for j in range(3)) for i in range(3))


def rigid(rows: tuple[Vec, Vec, Vec], t: Vec, p: Vec, c: Column | float = 1.0) -> Vec:
    """c R p + t."""
    return add(scale(rotate(rows, p), c), t)


def compose(a: tuple[Vec, Vec, Vec], b: tuple[Vec, Vec, Vec]) -> tuple[Vec, Vec, Vec]:
    """The rotation that applies b, then a."""
    columns = transpose(b)
    return tuple(tuple(dot(row, c) for c in columns) for row in a)


def inverse_transform(matrix) -> tuple[tuple[Vec, Vec, Vec], Vec]:
    """Rows and shift, as literals, of the inverse of a 4 x 4 transform of numbers."""
    inv = np.linalg.inv(np.asarray(matrix, float).reshape(4, 4))
    return literal_rows(inv), tuple(F.lit(float(inv[i][3])) for i in range(3))


def literal_rows(matrix) -> tuple[Vec, Vec, Vec]:
    """The upper left 3 x 3 of a matrix of numbers as literals."""
    return tuple(tuple(F.lit(float(matrix[i][j])) for j in range(3)) for i in range(3))


def rotation_angle(rows: tuple[Vec, Vec, Vec]) -> Column:
    """Degrees."""
    c = (rows[0][0] + rows[1][1] + rows[2][2] - 1) / 2
    return F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))))


def quaternion_of(rows: tuple[Vec, Vec, Vec]) -> tuple[Column, Column, Column, Column]:
    """(x, y, z, w) with w >= 0, from the largest of the four components so that nothing is divided by about 0."""
    (a, b, c), (d, e, f), (g, h, i) = rows
    squares = {"w": 1 + a + e + i, "x": 1 + a - e - i, "y": 1 - a + e - i, "z": 1 - a - e + i}
    top = F.greatest(*squares.values())
    s = F.sqrt(top) * 2
    by = {
        "w": ((h - f) / s, (c - g) / s, (d - b) / s, s / 4),
        "x": (s / 4, (b + d) / s, (c + g) / s, (h - f) / s),
        "y": ((b + d) / s, s / 4, (f + h) / s, (c - g) / s),
        "z": ((c + g) / s, (f + h) / s, s / 4, (d - b) / s),
    }
    out = []
    for k in range(4):
        one = by["z"][k]
        for name in ("y", "x", "w"):
            one = F.when(squares[name] == top, by[name][k]).otherwise(one)
        out.append(one)
    sign = F.when(out[3] < 0, -1.0).otherwise(1.0)
    return tuple(x * sign for x in out)


def slerp(p: tuple, q: tuple, f: Column) -> tuple:
    """Between unit quaternions, on the shorter way; straight where they nearly agree."""
    d = sum((a * b for a, b in zip(p[1:], q[1:], strict=True)), p[0] * q[0])
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    d = F.least(F.abs(d), F.lit(1.0))
    theta = F.acos(d)
    close = d > 0.9999999
    a = F.when(close, 1 - f).otherwise(F.sin((1 - f) * theta) / F.sin(theta))
    b = F.when(close, f).otherwise(F.sin(f * theta) / F.sin(theta)) * sign
    mixed = [a * x + b * y for x, y in zip(p, q, strict=True)]
    n = F.sqrt(sum((x * x for x in mixed[1:]), mixed[0] * mixed[0]))
    return tuple(x / n for x in mixed)


def pixel_ray(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column, forward: int = -1) -> Vec:
    """The direction of a pixel in its camera; forward -1 looks along -z with y up, 1 along +z with y down."""
    return unit(((u - cx) / fx, (v - cy) / fy * (1 if forward > 0 else -1), F.lit(float(forward))))


def ray_triangle(o: Vec, d: Vec, a: Vec, b: Vec, c: Vec, least: float = 1e-9) -> Column:
    """The distance along a ray to a triangle from either side (Moeller and Trumbore), null for a miss."""
    e1, e2 = sub(b, a), sub(c, a)
    p = cross(d, e2)
    det = dot(e1, p)
    inv = F.when(F.abs(det) > 1e-12, 1 / det)
    s = sub(o, a)
    u = dot(s, p) * inv
    q = cross(s, e1)
    v = dot(d, q) * inv
    t = dot(e2, q) * inv
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (t > least), t)


def face_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    """Unit normal; a degenerate face keeps its zero vector."""
    return unit(cross(sub(b, a), sub(c, a)))


def frustum_points(position: Vec, rows: tuple[Vec, Vec, Vec], depth: float, half_width: float, half_height: float) -> Column:
    """A camera's frustum as an array of points (x, y, z): the apex, then the outline of the far side, each corner after the apex."""
    corners = [(sx * half_width, sy * half_height, depth) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    path = [(0.0, 0.0, 0.0)]
    for k in range(4):
        path += [corners[k], corners[(k + 1) % 4]]
    at = lambda p: rigid(rows, position, tuple(F.lit(float(c)) for c in p))
    return F.array(*[F.struct(*[c.alias(n) for c, n in zip(at(p), "xyz", strict=True)]) for p in path])


def piecewise_linear(x: Column, stops: list[tuple[float, float]]) -> Column:
    """A value between stops (position, value), held at the ends: colour ramps and other lookup curves."""
    out = F.lit(stops[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(x < x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(out)
    return F.when(x <= stops[0][0], F.lit(stops[0][1])).otherwise(out)
