"""Vectors, unit quaternions (w, x, y, z), similarity transforms and camera projection as Columns.

A vector is a list of three Columns and a quaternion one of four, so that everything stays in generated code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def columns(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def dot(a: Vector, b: Vector) -> Column:
    return _sum(x * y for x, y in zip(a, b, strict=True))


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> list[Column]:
    """a over its length; nulls for the zero vector."""
    n = norm(a)
    return [F.when(n > 0, x / n) for x in a]


def minus(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def plus(a: Vector, b: Vector) -> list[Column]:
    return [x + y for x, y in zip(a, b, strict=True)]


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def clipped(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def angle_between(a: Vector, b: Vector) -> Column:
    """The angle of two rays in radians; null where one has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.acos(clipped(dot(a, b) / F.when(n > 0, n))))


def q_product(a: Vector, b: Vector) -> list[Column]:
    w, v = a[0] * b[0] - dot(a[1:], b[1:]), cross(a[1:], b[1:])
    return [w, *(a[0] * y + b[0] * x + c for x, y, c in zip(a[1:], b[1:], v, strict=True))]


def q_conjugate(q: Vector) -> list[Column]:
    return [q[0], *(-x for x in q[1:])]


def q_inverse(q: Vector) -> list[Column]:
    n = dot(q, q)
    return [F.when(n > 0, x / n) for x in q_conjugate(q)]


def q_rotate(q: Vector, v: Vector) -> list[Column]:
    """v turned by the unit quaternion q: v + 2 w (u x v) + 2 u x (u x v)."""
    t = [2 * x for x in cross(q[1:], v)]
    return [x + q[0] * y + z for x, y, z in zip(v, t, cross(q[1:], t), strict=True)]


def q_angle(a: Vector, b: Vector) -> Column:
    """The angle in radians that turns one unit quaternion into the other; q and -q are the same rotation."""
    return 2 * F.acos(clipped(F.abs(dot(a, b)), 0.0))


def q_from_axis_angle(axis: Vector, angle: Column) -> list[Column]:
    return [F.cos(angle / 2), *(x * F.sin(angle / 2) for x in unit(axis))]


def q_slerp(a: Vector, b: Vector, t: Column) -> list[Column]:
    """The rotation at share t of the shorter way from a to b; linear, then unit, where both are nearly the same."""
    d = dot(a, b)
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    theta = F.acos(clipped(F.abs(d), 0.0))
    s = F.sin(theta)
    close = s < 1e-9
    wa = F.when(close, 1 - t).otherwise(F.sin((1 - t) * theta) / F.when(~close, s))
    wb = sign * F.when(close, t).otherwise(F.sin(t * theta) / F.when(~close, s))
    return unit([wa * x + wb * y for x, y in zip(a, b, strict=True)])


def camera_centre(q: Vector, t: Vector) -> list[Column]:
    """Where the camera is that sees a world point x at R x + t."""
    return [-x for x in q_rotate(q_conjugate(q), t)]


@dataclass(frozen=True)
class Similarity:
    """x -> scale * (rotation x) + translation; the rotation is a unit quaternion (w, x, y, z)."""

    rotation: tuple[float, float, float, float] = (1.0, 0.0, 0.0, 0.0)
    translation: tuple[float, float, float] = (0.0, 0.0, 0.0)
    scale: float = 1.0

    def __post_init__(self):
        if not self.scale > 0:
            raise ValueError("the scale must be above 0")

    def _q(self) -> list[Column]:
        return [F.lit(float(x)) for x in self.rotation]

    def apply(self, v: Vector, w: Column | None = None) -> list[Column]:
        """Points where w is 1 or None; directions, which are only turned, where w is 0."""
        turned = q_rotate(self._q(), v)
        moved = [x * self.scale + float(t) for x, t in zip(turned, self.translation, strict=True)]
        return moved if w is None else [F.when(w == 0, a).otherwise(b) for a, b in zip(turned, moved, strict=True)]

    def apply_pose(self, q: Vector, t: Vector) -> tuple[list[Column], list[Column]]:
        """The pose (world to camera) of the same camera in the new world."""
        turned = q_product(q, q_conjugate(self._q()))
        centre = self.apply(camera_centre(q, t))
        return turned, [-x for x in q_rotate(turned, centre)]

    def _turn(self, v):
        import numpy as np

        u, v = np.array(self.rotation[1:]), np.array(v, float)
        s = 2 * np.cross(u, v)
        return v + self.rotation[0] * s + np.cross(u, s)

    def point(self, v) -> tuple[float, ...]:
        return tuple((self.scale * self._turn(v) + self.translation).tolist())

    def after(self, first: Similarity) -> Similarity:
        """The transform that does first, then this one."""
        (aw, ax, ay, az), (bw, bx, by, bz) = self.rotation, first.rotation
        q = (aw * bw - ax * bx - ay * by - az * bz, aw * bx + bw * ax + ay * bz - az * by, aw * by + bw * ay + az * bx - ax * bz, aw * bz + bw * az + ax * by - ay * bx)
        return Similarity(q, self.point(first.translation), self.scale * first.scale)

    def inverse(self) -> Similarity:
        q = (self.rotation[0], *(-x for x in self.rotation[1:]))
        back = Similarity(q)
        return Similarity(q, tuple(-x / self.scale for x in back.point(self.translation)), 1 / self.scale)


def polar(x: Column, y: Column, centre_x: Column | float = 0.0, centre_y: Column | float = 0.0) -> tuple[Column, Column]:
    """(angle in (-pi, pi], radius) around a centre."""
    return F.atan2(y - centre_y, x - centre_x), F.hypot(x - centre_x, y - centre_y)


#: Parameters of the camera models, in their public order.
MODELS = {
    "SIMPLE_PINHOLE": ("f", "cx", "cy"), "PINHOLE": ("fx", "fy", "cx", "cy"), "SIMPLE_RADIAL": ("f", "cx", "cy", "k1"), "RADIAL": ("f", "cx", "cy", "k1", "k2"),
    "OPENCV": ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2"), "OPENCV_FISHEYE": ("fx", "fy", "cx", "cy", "k1", "k2", "k3", "k4"),
}


def _parameter(params: Column, *names: str) -> Column:
    return F.coalesce(*[params[n] for n in names], F.lit(0.0))


def distorted(model: str, params: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Where a point of the image plane at depth 1 comes to lie under the model's distortion; params is a map by name."""
    if model not in MODELS:
        raise ValueError(f"no camera model {model}")
    k = [_parameter(params, f"k{i}") for i in (1, 2, 3, 4)]
    if model == "OPENCV_FISHEYE":
        r = F.hypot(x, y)
        t = F.atan(r)
        t2 = t * t
        scaled = F.when(r > 1e-12, t * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3])))) / F.when(r > 1e-12, r)).otherwise(1.0)
        return x * scaled, y * scaled
    r2 = x * x + y * y
    radial = 1 + r2 * (k[0] + r2 * k[1])
    p1, p2 = _parameter(params, "p1"), _parameter(params, "p2")
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def projected(model: str, params: Column, point: Vector) -> tuple[Column, Column]:
    """Pixel of a point in camera coordinates; nulls behind the camera."""
    z = F.when(point[2] > 0, point[2])
    x, y = distorted(model, params, point[0] / z, point[1] / z)
    return x * _parameter(params, "fx", "f") + _parameter(params, "cx"), y * _parameter(params, "fy", "f") + _parameter(params, "cy")


def unprojected(model: str, params: Column, u: Column, v: Column, steps: int = 8) -> list[Column]:
    """The unit ray of a pixel. Distortion is undone by `steps` fixed-point steps, each a larger expression; none for pinholes."""
    x0, y0 = (u - _parameter(params, "cx")) / _parameter(params, "fx", "f"), (v - _parameter(params, "cy")) / _parameter(params, "fy", "f")
    if "PINHOLE" in model:
        return unit([x0, y0, F.lit(1.0)])
    # the state is carried in a struct through an aggregate, so the expression stays small
    start = F.struct(x0.alias("x"), y0.alias("y"))

    def step(s, _):
        dx, dy = distorted(model, params, s["x"], s["y"])
        return F.struct((s["x"] + x0 - dx).alias("x"), (s["y"] + y0 - dy).alias("y"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return unit([end["x"], end["y"], F.lit(1.0)])


def affine_size(shape: Column) -> Column:
    """The mean length of the two columns of a 2x2 shape given as array (a, b, c, d), row by row."""
    a, b, c, d = (shape[i] for i in range(4))
    return (F.hypot(a, c) + F.hypot(b, d)) / 2


def squared_distance_of_bytes(a: Column, b: Column) -> Column:
    """The squared L2 distance of two arrays of small integers, summed in integers; arrays of other lengths have none."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long")))
    return F.when(F.size(a) == F.size(b), F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + x))


#: The constants of the public SplitMix64 generator; fixed values, as signed longs.
GOLDEN, MIX_A, MIX_B = (x - (1 << 64) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def splitmix64(state: Column) -> Column:
    """The output of a SplitMix64 generator for a state (the state of step k is seed + k * GOLDEN, wrapping), as a signed long.

    Products wrap: they are made of 32-bit halves, of which none overflows a decimal.
    """

    big = lambda k, kind="decimal(38,0)": F.lit(str(k)).cast(kind)
    modulo = lambda c: F.pmod(c.cast("decimal(38,0)"), big(1 << 64))

    def wrapped(c: Column) -> Column:
        m = modulo(c)
        return F.when(m >= big(1 << 63), m - big(1 << 64)).otherwise(m).cast("long")

    def times(a: Column, k: int) -> Column:
        whole = big(k % (1 << 64), "decimal(20,0)")
        low, high = a.bitwiseAND(F.lit(0x7FFFFFFF)).cast("decimal(10,0)"), F.shiftrightunsigned(a, 31).cast("decimal(11,0)")
        # (high * 2^31 + low) * k modulo 2^64; no product has more than 38 digits
        h = modulo(high * whole)
        for part in (1 << 15, 1 << 16):
            h = modulo(h.cast("decimal(20,0)") * big(part, "decimal(6,0)"))
        return wrapped(h + (low * whole).cast("decimal(38,0)"))

    z = wrapped(state.cast("decimal(38,0)") + big(GOLDEN))
    z = times(z.bitwiseXOR(F.shiftrightunsigned(z, 30)), MIX_A)
    z = times(z.bitwiseXOR(F.shiftrightunsigned(z, 27)), MIX_B)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))
