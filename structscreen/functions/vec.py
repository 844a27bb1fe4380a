"""Vector algebra on triples of columns.

A vector is a tuple of three Columns.  Formulas that use an intermediate vector several
times hold it with ``let``, so that each part is computed once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def vec(prefix: str = "", suffix: str = "") -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}{a}{suffix}") for a in AXES)


def with_vec(df: DataFrame, prefix: str, v) -> DataFrame:
    return df.withColumns({f"{prefix}{a}": c for a, c in zip(AXES, v)})


def sub(a, b):
    return tuple(p - q for p, q in zip(a, b))


def add(a, b):
    return tuple(p + q for p, q in zip(a, b))


def scale(a, k):
    return tuple(p * k for p in a)


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b):
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def norm2(a) -> Column:
    return dot(a, a)


def norm(a) -> Column:
    return F.sqrt(norm2(a))


def dist2(a, b) -> Column:
    return norm2(sub(a, b))


def dist(a, b) -> Column:
    return F.sqrt(dist2(a, b))


def unit(a, eps: float = 1e-8):
    """a / sqrt(|a|^2 + eps); missing or NaN components become 0."""
    size = F.sqrt(norm2(a) + F.lit(eps))
    return tuple(F.coalesce(F.nanvl(c / size, F.lit(0.0)), F.lit(0.0)) for c in a)


def dihedral(a, b, c, d) -> Column:
    """Signed dihedral angle of four points in radians, in (-pi, pi]."""
    b1, b2, b3 = sub(b, a), sub(c, b), sub(d, c)
    n2 = cross(b2, b3)
    return F.atan2(norm(b2) * dot(b1, n2), dot(cross(b1, b2), n2))


def let(values, body) -> Column:
    """Name intermediate vectors inside one expression.

    ``body`` gets the values as they come out of a one-element array, so each is computed
    once however often the formula uses it, and the optimizer cannot expand it when it
    moves a filter through the projection.
    """
    names = [f"v{i}" for i in range(len(values))]
    held = F.struct(*[F.struct(*[c.alias(a) for a, c in zip(AXES, v)]).alias(n) for n, v in zip(names, values)])
    return F.transform(
        F.array(held), lambda h: body(*[tuple(h[n][a] for a in AXES) for n in names])
    )[0]


def as_struct(v) -> Column:
    return F.struct(*[c.alias(a) for a, c in zip(AXES, v)])


def _exact_unit(v):
    size = norm(v)
    return tuple(F.try_divide(c, size) for c in v)


def with_virtual_cb(df: DataFrame, out: str, n: str, ca: str, c: str, length, angle, torsion):
    """Place a fourth point by bond length, bond angle and dihedral after C, N, CA."""
    vn, vca, vc = vec(n), vec(ca), vec(c)
    along, side, up = (
        length * math.cos(angle), length * math.sin(angle) * math.cos(torsion), -length * math.sin(angle) * math.sin(torsion),
    )

    def place(bc, normal):
        parts = (scale(bc, F.lit(along)), scale(cross(normal, bc), F.lit(side)), scale(normal, F.lit(up)))
        return as_struct(add(parts[0], add(parts[1], parts[2])))

    shift = let(
        [_exact_unit(sub(vn, vca))],
        lambda bc: let([cross(sub(vn, vc), bc)], lambda n0: let([bc, _exact_unit(n0)], place)),
    )
    df = df.withColumn("__cb", shift)
    return with_vec(df, out, tuple(F.col(ca + a) + F.col("__cb")[a] for a in AXES)).drop("__cb")


def with_local_frame(df: DataFrame, n: str, ca: str, c: str, out=("e1_", "e2_", "e3_")):
    """Orthonormal frame at CA: e1 towards C, e2 in the N side of the plane, e3 normal.

    ``unit`` leaves e1 a little short of one, so the part along it is taken with its own length; else e2 leans
    towards e1 where N is nearly in line with CA and C.
    """
    v1, v2 = sub(vec(c), vec(ca)), sub(vec(n), vec(ca))

    def second(e1):
        along = F.coalesce(F.try_divide(dot(e1, v2), norm2(e1)), F.lit(0.0))
        return let([unit(sub(v2, scale(e1, along)))], lambda e2: F.struct(
            as_struct(e1).alias("a"), as_struct(e2).alias("b"), as_struct(cross(e1, e2)).alias("c")
        ))

    df = df.withColumn("__frame", let([unit(v1)], second))
    for name, part in zip(out, ("a", "b", "c")):
        df = with_vec(df, name, tuple(F.col("__frame")[part][a] for a in AXES))
    return df.drop("__frame")


def to_local(point, origin, frame):
    """Coordinates of a point in a local frame given as three unit vectors."""
    d = sub(point, origin)
    return tuple(dot(d, e) for e in frame)


def from_local(point, origin, frame):
    moved = add(scale(frame[0], point[0]), add(scale(frame[1], point[1]), scale(frame[2], point[2])))
    return add(origin, moved)


def with_side_chain_direction(df: DataFrame, out: str, n: str, ca: str, c: str) -> DataFrame:
    """Approximate side-chain direction: -sqrt(1/3) bisector - sqrt(2/3) normal."""
    df = with_vec(df, "__c_", unit(sub(vec(c), vec(ca))))
    df = with_vec(df, "__n_", unit(sub(vec(n), vec(ca))))
    df = with_vec(df, "__b_", unit(add(vec("__c_"), vec("__n_"))))
    df = with_vec(df, "__p_", unit(cross(vec("__c_"), vec("__n_"))))
    direction = add(
        scale(vec("__b_"), F.lit(-math.sqrt(1 / 3))), scale(vec("__p_"), F.lit(-math.sqrt(2 / 3)))
    )
    df = with_vec(df, out, direction)
    return df.drop(*[f"{p}{a}" for p in ("__c_", "__n_", "__b_", "__p_") for a in AXES])


def rotate_about(point, axis, angle: Column):
    """Rodrigues rotation of a vector about a unit axis."""
    c, s = F.cos(angle), F.sin(angle)
    k = dot(axis, point) * (F.lit(1.0) - c)
    turned = cross(axis, point)
    return tuple(p * c + t * s + a * k for p, t, a in zip(point, turned, axis))


def row_times_matrix(v, r: Column):
    """v . R for a row-major array column of nine doubles."""
    return tuple(v[0] * r[j] + v[1] * r[3 + j] + v[2] * r[6 + j] for j in range(3))


def matrix_times_column(r: Column, v):
    """R . v for a row-major array column of nine doubles."""
    return tuple(r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3))


def matrix_from_quaternion(w, x, y, z) -> Column:
    """Row-major rotation matrix of a (not necessarily unit) quaternion."""
    s = F.lit(2.0) / (w * w + x * x + y * y + z * z)
    one = F.lit(1.0)
    return F.array(
        one - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
        s * (x * y + z * w), one - s * (x * x + z * z), s * (y * z - x * w),
        s * (x * z - y * w), s * (y * z + x * w), one - s * (x * x + y * y),
    )


def matrix_from_axis_angle(v) -> Column:
    """Row-major rotation matrix of a rotation vector (axis times angle).

    R = cos a I + (sin a / a) [v]x + ((1 - cos a) / a^2) v v^T, with both quotients by
    half-angle sines, which lose nothing near zero; at zero they are 1 and 1/2.
    """
    angle = norm(v)
    none = angle == 0
    safe = F.when(none, F.lit(1.0)).otherwise(angle)
    turn = F.when(none, F.lit(1.0)).otherwise(F.sin(safe) / safe)
    half = F.when(none, F.lit(0.5)).otherwise(F.sin(safe / 2) / safe)
    spread = F.when(none, F.lit(0.5)).otherwise(F.lit(2.0) * half * half)
    c = F.cos(angle)
    x, y, z = v
    return F.array(
        c + spread * x * x, spread * x * y - turn * z, spread * x * z + turn * y,
        spread * y * x + turn * z, c + spread * y * y, spread * y * z - turn * x,
        spread * z * x - turn * y, spread * z * y + turn * x, c + spread * z * z,
    )


def radial_basis(value: Column, v_min: float, v_max: float, n: int = 16) -> Column:
    step = (v_max - v_min) / (n - 1)
    width = (v_max - v_min) / n
    centres = F.array(*[F.lit(v_min + i * step) for i in range(n)])
    return F.transform(centres, lambda c: F.exp(-F.pow((value - c) / F.lit(width), F.lit(2.0))))


def gaussian_smearing(value: Column, start=0.0, stop=5.0, n: int = 50) -> Column:
    step = (stop - start) / (n - 1)
    centres = F.array(*[F.lit(start + i * step) for i in range(n)])
    coeff = -0.5 / step**2
    return F.transform(centres, lambda c: F.exp(F.lit(coeff) * F.pow(value - c, F.lit(2.0))))


def relative_position(delta: Column, n: int = 16) -> Column:
    """cos then sin of the offset at n/2 geometric frequencies."""
    freqs = [math.exp(-i * math.log(10000.0) / n) for i in range(0, n, 2)]
    return F.array(*[F.cos(delta * f) for f in freqs], *[F.sin(delta * f) for f in freqs])


def distance_decay(d: Column, start=6.0, width=10.0) -> Column:
    return F.exp(-F.greatest((d - F.lit(start)) / F.lit(width), F.lit(0.0)))
