"""Rays against triangles in arrays: what one task does with the rays and triangles that share a crowded cell.

Products of short floats tell which pairs can be hits or are near; what they leave open, by a margin wider than their
rounding, goes by the formulas of vectors.ray_triangle() and near_samples() in doubles. A block holds about BLOCK pairs.

Where only the nearest hit and the number of triangles near a ray are asked for, a ray doesn't meet them all: Places counts whole
squares of centres, and Fronts goes through triangles from the side the ray comes from and stops at its nearest hit.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 17
#: Rounding of a product of short floats, relative to the sum of its terms' amounts; several times what it can be.
ROUNDING = 2e-6
#: Points of a square that is not cut again, and levels of squares at most.
LEAF, LEVELS = 32, 14
#: The level of squares whose triangles make a front; those it shows at first, and twice as many each time to rays that go on.
SQUARES, FRONT = 2, 64


def blocks(rays: int, others: int) -> list[slice]:
    """Slices of rays, each of which makes a block with the others."""
    step = max(1, BLOCK // max(others, 1))
    return [slice(i, min(i + step, rays)) for i in range(0, rays, step)]


def parts(first: int, end: int) -> list[slice]:
    """Slices of a run of rows, short enough for a block of some rays."""
    return [slice(i, min(i + BLOCK // 64, end)) for i in range(first, end, BLOCK // 64)]


def exact_distances(o, d, a, b, c, least: float = 1e-9):
    """As vectors.ray_triangle(), for pairs (three arrays each, of the coordinates); inf for a miss."""
    minus = lambda x, y: [p - q for p, q in zip(x, y, strict=True)]
    dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    cross = lambda x, y: (x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])
    e1, e2 = minus(b, a), minus(c, a)
    p = cross(d, e2)
    det = dot(e1, p)
    inv = np.where(np.abs(det) > 1e-12, 1 / det, np.nan)
    s = minus(o, a)
    u, q = dot(s, p) * inv, cross(s, e1)
    v, t = dot(d, q) * inv, dot(e2, q) * inv
    return np.where((u >= 0) & (v >= 0) & (u + v <= 1) & (t > least), t, np.inf)


def _largest(rows) -> float:
    return float(np.nan_to_num(np.abs(rows).sum(1), posinf=np.inf).max(initial=0.0))


def amid(points):
    """A point amid others; around it products lose least."""
    return np.nan_to_num(np.nanmean(points, 0), posinf=0.0, neginf=0.0)


def moments(rays, at):
    """The six numbers of each ray's line (rows of o and d) around a point, and how large they are at most."""
    o, d = rays[:, :3], rays[:, 3:]
    o = o - at
    o = o - d * ((o * d).sum(1) / (d * d).sum(1))[:, None]
    six = np.hstack([np.cross(o, d), d])
    return six, _largest(six)


def _short(rows):
    return np.ascontiguousarray(rows.T, "float32")


class Triangles:
    """Triangles of a cell (rows of three corners, nine numbers), ready for blocks of rays."""

    def __init__(self, corners, at=None):
        self.columns = [np.ascontiguousarray(c) for c in corners.T]
        a, b, c = corners[:, :3], corners[:, 3:6], corners[:, 6:]
        self.at = amid(a) if at is None else at
        a, e1, e2 = a - self.at, b - a, c - a
        by = [np.cross(e2, e1), np.hstack([e2, np.cross(a, e2)]), -np.hstack([e1, np.cross(a, e1)])]
        self.scale = max(map(_largest, by))
        self.det, self.u, self.v = map(_short, by)

    def hits(self, rays, among=None, six=None, most=None):
        """Pairs that hit, by ray: numbers of rays (rows of o and d) and triangles, and the distances; only those of a mask `among`.

        six, most: what moments() gives for the rays around the same point, where it is at hand.
        """
        if six is None:
            six, most = moments(rays, self.at)
        scale = self.scale * most
        n = self.det.shape[1]
        if scale < 1e15:
            six = six.astype("float32")
            det, u, v = six[:, 3:] @ self.det, six @ self.u, six @ self.v
            u *= det
            v *= det
            det *= det
            det -= u
            det -= v
            np.minimum(u, v, out=u)
            np.minimum(u, det, out=u)
            can = u >= np.float32(-4 * ROUNDING * scale * scale)
        else:
            can = np.ones((len(rays), n), bool)
        if among is not None:
            can &= among
        at = np.flatnonzero(can)
        i, k = np.divmod(at, n)
        ray, mesh = [rays[:, c][i] for c in range(6)], [c[k] for c in self.columns]
        t = exact_distances(ray[:3], ray[3:], mesh[:3], mesh[3:6], mesh[6:])
        hit = np.flatnonzero(t < np.inf)
        return i[hit], k[hit], t[hit]


def nearest(i, t, best):
    """best (a distance for each ray), lowered in place to the distances t of rays i, which ascend."""
    if len(i):
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        at = i[starts]
        best[at] = np.minimum(best[at], np.minimum.reduceat(t, starts))


def near_lines(rays, lo, step, centres, radius: float, n: int):
    """Which centres (columns, x and y) lie within radius of any of the n samples (from lo by step) of each ray (rows)."""
    at = np.nan_to_num(centres.mean(0), posinf=0.0, neginf=0.0)
    x, y, dx, dy, p = rays[:, 0] - at[0], rays[:, 1] - at[1], rays[:, 3], rays[:, 4], centres - at
    flat = dx * dx + dy * dy
    long = np.sqrt(flat)
    one = np.hstack([p, np.ones((len(p), 1))])
    along = np.stack([dx, dy, -(x * dx + y * dy) - lo * flat], 1) / (flat * step)[:, None]
    aside = np.stack([dy, -dx, y * dx - x * dy], 1) / long[:, None]
    width = (step * long)[:, None]
    size = np.abs(one).max(0)
    hair = ROUNDING * ((np.abs(along) @ size)[:, None] * width + (np.abs(aside) @ size)[:, None] + radius)
    hair = (hair * (2 * radius + hair)).astype("float32")
    one = _short(one)
    place, away = along.astype("float32") @ one, aside.astype("float32") @ one
    nearest = np.rint(place)
    np.maximum(nearest, np.float32(0), out=nearest)
    np.minimum(nearest, np.float32(n - 1), out=nearest)
    place -= nearest
    place *= width.astype("float32")
    place *= place
    away *= away
    away += place
    away -= np.float32(radius * radius)
    inside = away <= 0
    np.abs(away, out=away)
    unsure = ~(away > hair)  # also rays that stand still, seen from above
    if unsure.any():
        open_at = np.flatnonzero(unsure)
        i, k = np.divmod(open_at, len(p))
        inside.flat[open_at] = _near_exact(rays[i], lo[i], step[i], centres[k], radius, n)
    return inside


def _near_exact(rays, lo, step, c, radius: float, n: int):
    ox, oy, dx, dy, px, py = rays[:, 0], rays[:, 1], rays[:, 3], rays[:, 4], c[:, 0], c[:, 1]
    flat = dx * dx + dy * dy
    place = (((px - ox) * dx + (py - oy) * dy) / flat - lo) / step
    low = np.clip(np.floor(np.where((flat == 0) | (step == 0), 0.0, place)), 0, n - 1)

    def away(k):
        t = lo + step * k
        return (ox + dx * t - px) ** 2 + (oy + dy * t - py) ** 2

    return np.minimum(away(low), away(np.minimum(low + 1, n - 1))) <= radius * radius


class Lines:
    """Rays (rows of o and d) as n samples each (from lo by step) on lines seen from above, in short floats around a point `at`."""

    def __init__(self, rays, lo, step, n: int, at):
        x, y, dx, dy = rays[:, 0] - at[0], rays[:, 1] - at[1], rays[:, 3], rays[:, 4]
        flat = dx * dx + dy * dy
        long = np.sqrt(flat)
        still = ~(step * long > 0)
        # counted from the sample beside `at`, so that numbers stay small
        place = np.where(still, 0.0, (-(x * dx + y * dy) / flat - lo) / step)
        k = np.clip(np.rint(np.where(np.isfinite(place), place, 0.0)), 0, n - 1)
        t = lo + step * k
        short = lambda a: np.ascontiguousarray(a, "float32")
        self.x, self.y = short(x + dx * t), short(y + dy * t)
        self.ux, self.uy = short(np.where(still, 1.0, dx / long)), short(np.where(still, 0.0, dy / long))
        self.step, self.inverse = short(np.where(still, 0.0, step * long)), short(np.where(still, 0.0, 1 / (step * long)))
        self.first, self.last = short(np.where(still, 0.0, -k)), short(np.where(still, 0.0, n - 1 - k))

    def away(self, i, px, py):
        """Of pairs of a ray (its number) and a point: the squared distance to the ray's nearest sample, that one's number, and how far the point is ahead of it."""
        vx, vy, ux, uy = px - self.x[i], py - self.y[i], self.ux[i], self.uy[i]
        along, aside = ux * vx + uy * vy, uy * vx - ux * vy
        k = np.rint(along * self.inverse[i])
        np.maximum(k, self.first[i], out=k)
        np.minimum(k, self.last[i], out=k)
        along -= k * self.step[i]
        return along * along + aside * aside, k, along


def _runs(first, n):
    """The numbers of runs that begin at `first` and are n long, one run after another."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(first - ends + n, n)


class Places:
    """Points (rows of x and y) in a tree of squares, for counts of those near rays.

    The distance to a ray's samples differs between two points by no more than theirs, so a square far inside counts whole and one
    far outside not at all; only squares at the border are cut, down to a few points.
    """

    def __init__(self, points, radius: float):
        self.radius, low, high = radius, points.min(0), points.max(0)
        self.at = (low + high) / 2
        levels = int(np.clip(np.ceil(np.log2(max(len(points) / LEAF, 1)) / 2) + 3, 2, LEVELS))
        size = max(float((high - low).max()), 1e-300)
        cell = np.minimum((points - low) / size * (1 << levels), (1 << levels) - 1).astype("int64")
        code = np.zeros(len(points), "int64")
        for b in range(levels):
            code |= ((cell[:, 0] >> b) & 1) << (2 * b) | ((cell[:, 1] >> b) & 1) << (2 * b + 1)
        self.order = np.argsort(code, kind="stable")
        code, self.points = code[self.order], points[self.order]
        near = self.points - self.at
        self.x, self.y = (np.ascontiguousarray(c, "float32") for c in near.T)
        # wider than what short floats can lose over the rays that reach these points
        self.hair = 4 * ROUNDING * (2 * float(np.abs(near).max(initial=0.0)) + radius)
        self.levels = []
        for depth in range(levels + 1):
            start = np.flatnonzero(np.diff(code >> (2 * (levels - depth)), prepend=-1))
            ends = np.append(start[1:], len(code))
            lo, hi = np.minimum.reduceat(near, start), np.maximum.reduceat(near, start)
            half = np.hypot(*((hi - lo) / 2).T) + self.hair
            x, y = (np.ascontiguousarray(c, "float32") for c in ((lo + hi) / 2).T)
            inner = np.where(half < radius, (radius - half) ** 2, -1.0).astype("float32")
            level = {"start": start, "n": ends - start, "x": x, "y": y, "half": half.astype("float32"), "inner": inner, "outer": ((radius + half) ** 2).astype("float32")}
            level["leaf"] = (level["n"] <= LEAF) | (depth == levels)
            if self.levels:
                above = self.levels[-1]
                above["first"] = np.searchsorted(start, above["start"])
                above["kids"] = np.diff(np.append(above["first"], len(start)))
            self.levels.append(level)

    def lines(self, rays, lo, step, n: int) -> Lines:
        return Lines(rays, lo, step, n, self.at)

    def touched(self, lines: Lines, level: dict, node: int):
        """Rays that may be near a point of a square."""
        i = slice(None)
        return lines.away(i, level["x"][node], level["y"][node])[0] <= level["outer"][node]

    def counts(self, rays, lo, step, n: int):
        """For each ray (rows of o and d, samples from lo by step) how many points lie within radius of any of its n samples."""
        total = np.zeros(len(rays), "int64")
        root = self.levels[0]
        reach = np.flatnonzero(self.touched(self.lines(rays, lo, step, n), root, 0))
        most = max(16, int(2 * BLOCK / np.sqrt(len(self.points))))
        for b in range(0, len(reach), most):
            of = reach[b : b + most]
            total[of] = self._counts(rays[of], lo[of], step[of], n)
        return total

    def _counts(self, rays, lo, step, n: int):
        lines, total = self.lines(rays, lo, step, n), np.zeros(len(rays))
        i, node = np.arange(len(rays)), np.zeros(len(rays), "int64")
        add = lambda at, weights: np.add(total, np.bincount(at, weights, len(total)), out=total)
        for level in self.levels:
            d2, k, along = lines.away(i, level["x"][node], level["y"][node])
            inside = d2 <= level["inner"][node]
            add(i[inside], level["n"][node[inside]])
            open_at = np.flatnonzero((d2 <= level["outer"][node]) & ~inside)
            leaf = level["leaf"][node[open_at]]
            at = open_at[leaf]
            if len(at):
                add(i[at], self._of_leaves(rays, lo, step, n, lines, level, i[at], node[at], k[at], along[at]))
            open_at = open_at[~leaf]
            if not len(open_at):
                break
            kids = level["kids"][node[open_at]]
            i, node = np.repeat(i[open_at], kids), _runs(level["first"][node[open_at]], kids)
        return total

    def _of_leaves(self, rays, lo, step, n: int, lines: Lines, level: dict, i, node, k, along):
        """For pairs of a ray and a square how many of the square's points are near."""
        half, far = level["half"][node], lines.step[i] / 2
        # where another sample is the nearest one of some of the points
        mixed = ((k < lines.last[i]) & (along + half >= far)) | ((k > lines.first[i]) & (half - along >= far))
        out = np.zeros(len(i), "int64")
        r2 = np.float32(self.radius * self.radius)
        hair = np.float32(2 * self.radius * self.hair + self.hair * self.hair)
        for kind in (False, True):
            at = np.flatnonzero(mixed == kind)
            if not len(at):
                continue
            m, ray = level["n"][node[at]], i[at]
            p = _runs(level["start"][node[at]], m)
            if kind:
                d2 = lines.away(np.repeat(ray, m), self.x[p], self.y[p])[0]
            else:
                ahead = k[at] * lines.step[ray]
                dx, dy = self.x[p], self.y[p]
                dx -= np.repeat(lines.x[ray] + lines.ux[ray] * ahead, m)
                dy -= np.repeat(lines.y[ray] + lines.uy[ray] * ahead, m)
                dx *= dx
                dy *= dy
                d2 = dx
                d2 += dy
            d2 -= r2
            near = d2 <= 0
            np.abs(d2, out=d2)
            unsure = np.flatnonzero(~(d2 > hair))
            if len(unsure):
                own = np.repeat(ray, m)[unsure]
                near[unsure] = _near_exact(rays[own], lo[own], step[own], self.points[p[unsure]], self.radius, n)
            out[at] = np.add.reduceat(near, np.cumsum(m) - m, dtype="int64")
        return out


class Fronts:
    """Triangles of a square, of one kind, from the side where rays come from: from the top for rays that go down, else from the bottom."""

    def __init__(self, corners, centres, down: bool):
        z = corners[:, 2::3]
        end = z.max(1) if down else z.min(1)
        normal = np.cross(corners[:, 3:6] - corners[:, :3], corners[:, 6:] - corners[:, :3])
        sides = np.abs(corners[:, 3:] - np.hstack([corners[:, :3]] * 2)).max(1)
        # a triangle without extent may seem hit anywhere, so it comes first
        thin = ~(np.sqrt((normal * normal).sum(1)) > 1e-6 * sides * sides) | ~np.isfinite(end)
        end = np.where(thin, np.inf if down else -np.inf, end)
        order = np.argsort(-end if down else end, kind="stable")
        self.corners, self.centres, self.ends = corners[order], centres[order], end[order]
        self.slack = 1e-6 * (1 + float(np.abs(z[np.isfinite(z)]).max(initial=0.0)))
        self.down, self.meshes = down, {}
        self.cuts, step = [0], FRONT
        while self.cuts[-1] < len(corners):
            self.cuts.append(min(self.cuts[-1] + step, len(corners)))
            step = min(2 * step, BLOCK // 64)

    def lower(self, of, rays, lo, step, radius: float, n: int, best, six, most, at):
        """best (a distance for each ray), lowered in place for the rays `of` to that of the first hit among triangles near them.

        six, most: moments() of all rays around the point `at`.
        """
        for first, end in zip(self.cuts, self.cuts[1:], strict=False):
            o, d = rays[of, 2], rays[of, 5]
            limit = self.ends[first] + (self.slack if self.down else -self.slack)
            # where the ray comes to the first of those left; a level ray may meet any of them
            t = (limit - o) / d
            of = of[~(t * (1 - 1e-9) > best[of]) | (np.abs(d) < 1e-9)]
            if not len(of):
                return
            if first not in self.meshes:
                self.meshes[first] = Triangles(self.corners[first:end], at)
            for b in blocks(len(of), end - first):
                own = of[b]
                i, k, t = self.meshes[first].hits(rays[own], None, six[own], most)
                less = np.flatnonzero(t < best[own[i]])
                i, k, t = i[less], k[less] + first, t[less]
                whose = own[i]
                near = _near_exact(rays[whose], lo[whose], step[whose], self.centres[k], radius, n)
                lowest = best[own]
                nearest(i[near], t[near], lowest)
                best[own] = lowest


def first_hits(places: Places, rays, lo, step, n: int, corners, kinds):
    """For each ray the kind and the distance of its nearest hit among triangles near it, of the least kind that it hits; inf for a miss.

    corners, kinds: of the triangles whose centres are the points of `places`, in their order there.
    """
    best, kind = np.full(len(rays), np.inf), np.full(len(rays), np.inf)
    lines, level = places.lines(rays, lo, step, n), places.levels[min(SQUARES, len(places.levels) - 1)]
    near = [np.flatnonzero(places.touched(lines, level, k)) for k in range(len(level["n"]))]
    goes_down, at = rays[:, 5] < 0, amid(corners[:, :3])
    six, most = moments(rays, at)
    six = six.astype("float32")
    for one in np.unique(kinds):
        # a full square is the likeliest to have a hit close by, which spares work in the others
        for k in np.argsort(-level["n"], kind="stable"):
            of = near[k][kind[near[k]] >= one]
            if not len(of):
                continue
            square = slice(level["start"][k], level["start"][k] + level["n"][k])
            mine = kinds[square] == one
            if not mine.any():
                continue
            for down in (True, False):
                way = of[goes_down[of] == down]
                if len(way):
                    Fronts(corners[square][mine], places.points[square][mine], down).lower(way, rays, lo, step, places.radius, n, best, six, most, at)
        kind[np.isinf(kind) & np.isfinite(best)] = one
    return kind, best
