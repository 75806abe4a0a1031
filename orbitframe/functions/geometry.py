"""Geometry as Column expressions: nothing leaves whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A vector is a triple of columns.
Vec = tuple[Column, Column, Column]
#: Images to look at in a skewed cell.
SHIFTS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def vec(prefix: str = "", suffix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{n}{suffix}") for n in "xyz")


def const(*v: float) -> Vec:
    return tuple(F.lit(float(x)) for x in v)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(p * k for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return reduce(lambda s, t: s + t, (p * q for p, q in zip(a, b, strict=True)))


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def dist(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def mic_ortho(d: Vec, box: Vec) -> Vec:
    """Minimum image in a rectangular cell; half boxes go to the even number of boxes."""
    return tuple(p - length * F.rint(p / length) for p, length in zip(d, box, strict=True))


def mic_dist(a: Vec, b: Vec, box: Vec) -> Column:
    return norm(mic_ortho(sub(a, b), box))


def cell_matrix(lengths: Vec, angles: Vec) -> tuple[Vec, Vec, Vec]:
    """The cell's edge vectors from its lengths and its angles in degrees."""
    a, b, c = lengths
    cos = [F.cos(F.radians(x)) for x in angles]
    sin_gamma = F.sin(F.radians(angles[2]))
    cx, cy = c * cos[1], c * (cos[0] - cos[1] * cos[2]) / sin_gamma
    cz = F.sqrt(F.greatest(F.lit(0.0), c * c - cx * cx - cy * cy))
    zero = F.lit(0.0)
    return (a, zero, zero), (b * cos[2], b * sin_gamma, zero), (cx, cy, cz)


def determinant(h: tuple[Vec, Vec, Vec]) -> Column:
    return dot(h[0], cross(h[1], h[2]))


def to_fractional(r: Vec, h: tuple[Vec, Vec, Vec]) -> Vec:
    det = determinant(h)
    return tuple(dot(r, cross(h[(i + 1) % 3], h[(i + 2) % 3])) / det for i in range(3))


def to_cartesian(s: Vec, h: tuple[Vec, Vec, Vec]) -> Vec:
    return tuple(s[0] * h[0][k] + s[1] * h[1][k] + s[2] * h[2][k] for k in range(3))


def clamp(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def angle(a: Vec, b: Vec, c: Vec) -> Column:
    """Degrees at b; 0 where an arm has no length."""
    u, v = sub(a, b), sub(c, b)
    size = norm(u) * norm(v)
    return F.when(size > 1e-12, F.degrees(F.acos(clamp(dot(u, v) / size)))).otherwise(F.lit(0.0))


def dihedral(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Degrees from -180 to 180 about b-c; 0 where it is undefined."""
    u, v, w = sub(b, a), sub(c, b), sub(d, c)
    n1, n2 = cross(u, v), cross(v, w)
    # (u x v) x (v x w) is v times u (v x w), so its share along v needs no third cross product.
    y, x = norm(v) * dot(u, n2), dot(n1, n2)
    return F.when((F.abs(x) < 1e-14) & (F.abs(y) < 1e-14), F.lit(0.0)).otherwise(F.degrees(F.atan2(y, x)))


def plane_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    n = cross(sub(b, a), sub(c, a))
    size = norm(n)
    return scale(n, 1 / F.when(size > 1e-12, size).otherwise(F.lit(1.0)))


def normal_angle(n: Vec, m: Vec) -> Column:
    """The acute angle between two unit normals, in degrees."""
    return F.degrees(F.acos(clamp(F.abs(dot(n, m)))))


def box_bounds(centre_a: Vec, half_a: Vec, centre_b: Vec, half_b: Vec, box: Vec | None = None) -> tuple[Column, Column]:
    """Least and greatest possible distance between points of two boxes; with a cell, under the minimum image."""
    low, high = [], []
    for k in range(3):
        d = centre_a[k] - centre_b[k]
        d = F.abs(d - box[k] * F.rint(d / box[k])) if box else F.abs(d)
        both = half_a[k] + half_b[k]
        low.append(F.greatest(F.lit(0.0), d - both))
        high.append(F.least(d + both, box[k] / 2) if box else d + both)
    return norm(tuple(low)), norm(tuple(high))


#: The seven directions of a 14-sided bounding volume.
DIRECTIONS = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 1.0), (1.0, 1.0, -1.0), (1.0, -1.0, 1.0), (-1.0, 1.0, 1.0)]


def projections(r: Vec) -> list[Column]:
    """Lengths along the seven unit directions."""
    return [dot(r, const(*(c / sum(map(abs, v)) ** 0.5 for c in v))) for v in DIRECTIONS]


def kdop_bounds(min_a: Column, max_a: Column, min_b: Column, max_b: Column) -> tuple[Column, Column]:
    """From arrays of seven projections: the gap along the axes together, or along one diagonal; the span along the axes."""

    def at(c: Column, i: int) -> Column:
        return F.get(c, F.lit(i))

    gaps = [F.greatest(F.lit(0.0), at(min_a, i) - at(max_b, i), at(min_b, i) - at(max_a, i)) for i in range(7)]
    spans = [F.greatest(at(max_a, i) - at(min_b, i), at(max_b, i) - at(min_a, i)) for i in range(3)]
    return F.greatest(norm(tuple(gaps[:3])), *gaps[3:]), norm(tuple(spans))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value written and computed once, by way of a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbers(*columns: Column) -> Column:
    return F.array(*columns)


def _entries(c: Column, n: int) -> list[Column]:
    return [F.get(c, F.lit(i)) for i in range(n)]


def _rows(c: Column) -> tuple[Vec, Vec, Vec]:
    e = _entries(c, 9)
    return tuple(e[:3]), tuple(e[3:6]), tuple(e[6:])


def _images() -> Column:
    return F.array(*[F.array(*map(F.lit, map(float, v))) for v in SHIFTS])


def mic_triclinic(d: Vec, h: tuple[Vec, Vec, Vec]) -> Column:
    """Length of the shortest of the 27 images around the rounded fractional displacement."""

    def shortest(near: Column, cell: Column) -> Column:
        def length(v: Column) -> Column:
            place = add(tuple(_entries(near, 3)), tuple(_entries(v, 3)))
            return let(_numbers(*to_cartesian(place, _rows(cell))), lambda r: norm(tuple(_entries(r, 3))))

        return F.array_min(F.transform(_images(), length))

    def body(x: Column) -> Column:
        s = to_fractional(tuple(_entries(x["d"], 3)), _rows(x["h"]))
        return let(_numbers(*s), lambda f: let(F.transform(f, lambda p: p - F.rint(p)), lambda near: shortest(near, x["h"])))

    return let(F.struct(_numbers(*d).alias("d"), _numbers(*h[0], *h[1], *h[2]).alias("h")), body)


def box_bounds_triclinic(centre_a: Vec, half_a: Vec, centre_b: Vec, half_b: Vec, h: tuple[Vec, Vec, Vec]) -> tuple[Column, Column]:
    """Least of the bounds over the 27 images of the second box."""

    def body(x: Column) -> Column:
        def bounds(v: Column) -> Column:
            return let(_numbers(*to_cartesian(tuple(_entries(v, 3)), _rows(x["h"]))), lambda r: F.array(*box_bounds(*(tuple(_entries(x[n], 3)) for n in ("ca", "ha")), add(tuple(_entries(x["cb"], 3)), tuple(_entries(r, 3))), tuple(_entries(x["hb"], 3)))))

        found = F.transform(_images(), bounds)
        return let(found, lambda f: F.array(F.array_min(F.transform(f, lambda p: F.get(p, F.lit(0)))), F.array_min(F.transform(f, lambda p: F.get(p, F.lit(1))))))

    given = {"ca": centre_a, "ha": half_a, "cb": centre_b, "hb": half_b, "h": (*h[0], *h[1], *h[2])}
    low, high = _entries(let(F.struct(*[_numbers(*c).alias(n) for n, c in given.items()]), body), 2)
    return low, high


def kdop_bounds_periodic(min_a: Column, max_a: Column, min_b: Column, max_b: Column, h: tuple[Vec, Vec, Vec]) -> tuple[Column, Column]:
    """Least of both bounds over the images of the second volume: the one next to the first volume's centre, and its 26 neighbours."""

    def centre(low: Column, high: Column) -> Vec:
        return tuple((F.get(low, F.lit(i)) + F.get(high, F.lit(i))) / 2 for i in range(3))

    def over_images(x: Column, near: Column) -> Column:
        def shift(v: Column) -> Column:
            place = tuple(F.get(near, F.lit(i)) + F.get(v, F.lit(i)) for i in range(3))
            return let(_numbers(*to_cartesian(place, _rows(x["h"]))), lambda r: F.array(*projections(tuple(_entries(r, 3)))))

        def bounds(by: Column) -> Column:
            low, high = (F.zip_with(x[n], by, lambda p, s: p - s) for n in ("lb", "hb"))
            return let(F.struct(low.alias("l"), high.alias("h")), lambda m: F.array(*kdop_bounds(x["la"], x["ha"], m["l"], m["h"])))

        found = F.transform(F.transform(_images(), shift), bounds)
        # Functions of one parameter: a second one would be taken for the index.
        return let(found, lambda f: F.array(F.array_min(F.transform(f, lambda p: F.get(p, F.lit(0)))), F.array_min(F.transform(f, lambda p: F.get(p, F.lit(1))))))

    def body(x: Column) -> Column:
        s = to_fractional(sub(centre(x["lb"], x["hb"]), centre(x["la"], x["ha"])), _rows(x["h"]))
        return let(_numbers(*map(F.rint, s)), lambda near: over_images(x, near))

    given = F.struct(min_a.alias("la"), max_a.alias("ha"), min_b.alias("lb"), max_b.alias("hb"), _numbers(*h[0], *h[1], *h[2]).alias("h"))
    low, high = _entries(let(given, body), 2)
    return low, F.greatest(low, high)


def kdop_contains(low: Column, high: Column, point: list[Column], tolerance: float = 1e-9) -> Column:
    """Whether a point, by its seven projections, lies in all half spaces."""
    return any_of([(p >= F.get(low, F.lit(i)) - tolerance) & (p <= F.get(high, F.lit(i)) + tolerance) for i, p in enumerate(point)], lambda a, b: a & b)


def aabb_volume(low: Column, high: Column) -> Column:
    """Volume of the box around a volume given by arrays of projections, of which the first three are the axes."""
    sides = [F.greatest(F.lit(0.0), F.get(high, F.lit(i)) - F.get(low, F.lit(i))) for i in range(3)]
    return sides[0] * sides[1] * sides[2]


def singular_values(cell: Column) -> Column:
    """[greatest, least] singular value of a matrix given as nine numbers: the greatest from the trigonometric root of its Gram matrix's
    cubic, the least from the determinant and the second, which loses no digits where it is small."""

    def of_gram(c: Column, q: list[Column]) -> Column:
        xx, yy, zz, xy, xz, yz = q
        m = (xx + yy + zz) / 3
        spread = F.sqrt(((xx - m) ** 2 + (yy - m) ** 2 + (zz - m) ** 2 + 2 * (xy**2 + xz**2 + yz**2)) / 6)
        return let(_numbers(m, spread), lambda t: of_shape(c, q, *_entries(t, 2)))

    def of_shape(c: Column, q: list[Column], m: Column, spread: Column) -> Column:
        k = F.when(spread > 1e-12, spread).otherwise(1.0)
        x, y, z, xy, xz, yz = [(v - m) / k for v in q[:3]] + [v / k for v in q[3:]]
        phi = F.acos(clamp((x * (y * z - yz * yz) - xy * (xy * z - yz * xz) + xz * (xy * yz - y * xz)) / 2)) / 3
        return let(phi, lambda p: of_roots(c, m, m + 2 * spread * F.cos(p), m + 2 * spread * F.cos(p + 2 * math.pi / 3)))

    def of_roots(c: Column, m: Column, one: Column, three: Column) -> Column:
        pair = _numbers(F.sqrt(one), F.sqrt(F.greatest(F.lit(0.0), 3 * m - one - three)))
        return let(pair, lambda t: F.array(F.get(t, F.lit(0)), F.abs(determinant(_rows(c))) / (F.get(t, F.lit(0)) * F.get(t, F.lit(1)))))

    def body(c: Column) -> Column:
        h = _rows(c)
        return let(_numbers(*[dot(h[i], h[j]) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))]), lambda q: of_gram(c, _entries(q, 6)))

    return let(cell, body)


def cell_checks(h: tuple[Vec, Vec, Vec]) -> dict[str, Column]:
    """volume, condition, rectangular, reduced, and the status: DEGENERATE by determinant, SINGULAR by condition, NOT_REDUCED for a
    skewed cell whose 27 images need not hold the nearest one, else OK."""
    checks = "volume condition rectangular reduced status".split()

    def body(c: Column) -> Column:
        m = _rows(c)
        volume = determinant(m)
        off = [m[i][j] for i in range(3) for j in range(3) if i != j]
        rectangular = any_of([F.abs(x) <= 1e-6 for x in off], lambda a, b: a & b)
        reduced = (F.abs(m[1][0]) <= m[0][0] / 2 + 1e-6) & (F.abs(m[2][0]) <= m[0][0] / 2 + 1e-6) & (F.abs(m[2][1]) <= m[1][1] / 2 + 1e-6)
        bad = ~F.coalesce(volume > 1e-12, F.lit(False)) | F.isnan(volume)
        condition = F.when(~bad, let(singular_values(c), lambda t: F.get(t, F.lit(0)) / F.get(t, F.lit(1))))
        status = lambda k: F.when(bad, "DEGENERATE").when(k.isNull() | (k > 1e12), "SINGULAR").when(~rectangular & ~reduced, "NOT_REDUCED").otherwise("OK")
        return let(F.struct(condition.alias("k")), lambda k: F.struct(*[v.alias(n) for n, v in zip(checks, (volume, k["k"], rectangular, reduced, status(k["k"])), strict=True)]))

    found = let(_numbers(*h[0], *h[1], *h[2]), body)
    return {n: found[n] for n in checks}


def r6(c: Column) -> Column:
    """Six decimals, without negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def any_of(columns: list[Column], both: Callable[[Column, Column], Column] = lambda a, b: a | b) -> Column:
    return reduce(both, columns)
