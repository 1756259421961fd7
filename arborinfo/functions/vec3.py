"""Three-dimensional geometry on struct<x, y, z> columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    """A vector of three Columns."""

    x: Column
    y: Column
    z: Column

    def __add__(self, o):
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o):
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def scale(self, k: Column):
        return Vec(self.x * k, self.y * k, self.z * k)

    def dot(self, o) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o):
        return Vec(
            self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x
        )

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self):
        n = self.norm()
        return Vec(self.x / n, self.y / n, self.z / n)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))


def vec(point: Column | str) -> Vec:
    p = F.col(point) if isinstance(point, str) else point
    return Vec(p["x"], p["y"], p["z"])


def distance(a: Vec, b: Vec) -> Column:
    return (a - b).norm()


def turn_angle(a: Vec, b: Vec, c: Vec) -> Column:
    """Angle between the steps a-b and b-c: pi minus the angle at b; 0 without two steps."""
    u, v = b - a, c - b
    # Adding zero turns a negative zero into zero, whose angle would be pi.
    return F.atan2(u.cross(v).norm(), u.dot(v) + 0.0)


def dihedral(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Torsion of four points; 0 where it is undefined."""
    u, v, w = b - a, c - b, d - c
    n1, n2 = u.cross(v), v.cross(w)
    return F.atan2(u.dot(n2) * v.norm() + 0.0, n1.dot(n2) + 0.0)


def decompose(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """struct<length, angle, dihedral> that places d after a, b, c."""
    return F.struct(
        distance(c, d).alias("length"),
        turn_angle(b, c, d).alias("angle"),
        dihedral(a, b, c, d).alias("dihedral"),
    )


def place(a: Vec, b: Vec, c: Vec, length: Column, angle: Column, torsion: Column) -> Vec:
    """The point at the given internal coordinates after a, b, c; inverse of ``decompose``."""
    along = (c - b).unit()
    normal = (b - a).cross(c - b).unit()
    side = normal.cross(along)
    return c + (
        along.scale(F.cos(angle))
        + side.scale(F.sin(angle) * F.cos(torsion))
        + normal.scale(F.sin(angle) * F.sin(torsion))
    ).scale(length)


def axes(a: Vec, b: Vec, c: Vec, unit: bool = True) -> tuple[Vec, Vec, Vec]:
    """The frame of three points: the step b-c, the in-plane normal to it, the plane normal."""
    e1 = c - b
    e3 = e1.cross(b - a)
    e2 = e3.cross(e1)
    return (e1.unit(), e2.unit(), e3.unit()) if unit else (e1, e2, e3)


def align_rigid(point: Vec, mobile: tuple[Vec, Vec, Vec], ref: tuple[Vec, Vec, Vec]) -> Vec:
    """Move ``point`` with the rigid motion that takes the mobile frame to the reference one.

    Frames of unit axes are orthonormal, so the inverse is the transpose.
    """
    p = point - mobile[0]
    out = ref[0]
    for m, r in zip(axes(*mobile), axes(*ref)):
        out = out + r.scale(p.dot(m))
    return out
