"""Scalar geometry as Column expressions: camera models, poses, epipolar and reprojection measures, robust weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Camera models, their numeric ids and the order of their parameters.
CAMERA_MODELS = {
    "SIMPLE_PINHOLE": (0, ("f", "cx", "cy")),
    "PINHOLE": (1, ("fx", "fy", "cx", "cy")),
    "SIMPLE_RADIAL": (2, ("f", "cx", "cy", "k")),
    "RADIAL": (3, ("f", "cx", "cy", "k1", "k2")),
    "OPENCV": (4, ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2")),
    "OPENCV_FISHEYE": (5, ("fx", "fy", "cx", "cy", "k1", "k2", "k3", "k4")),
}
DEPTH_EPS = 1e-9


def by_model(model: Column, value) -> Column:
    """value(name, order of parameters) for the row's model; null for an unknown one."""
    out = None
    for name, (_, order) in CAMERA_MODELS.items():
        v = value(name, order)
        out = F.when(model == name, v) if out is None else out.when(model == name, v)
    return out


def param(model: Column, params: Column, *names: str) -> Column:
    """The first of names that the model has, else 0; null where the array is too short."""

    def of(_, order):
        at = next((order.index(n) for n in names if n in order), None)
        return F.lit(0.0) if at is None else F.get(params, F.lit(at))

    return by_model(model, of)


def model_id(model: Column) -> Column:
    return by_model(model, lambda name, _: F.lit(CAMERA_MODELS[name][0]))


def params_valid(model: Column, params: Column) -> Column:
    return F.coalesce(by_model(model, lambda _, order: F.size(params) == len(order)), F.lit(False))


def focal_lengths(model: Column, params: Column) -> tuple[Column, Column]:
    return param(model, params, "fx", "f"), param(model, params, "fy", "f")


def principal_point(model: Column, params: Column) -> tuple[Column, Column]:
    return param(model, params, "cx"), param(model, params, "cy")


def opencv_distortion(model: Column, params: Column) -> Column:
    """[k1, k2, p1, p2, k3, k4], zero where the model has no such term."""
    return F.array(*(param(model, params, *n) for n in (("k1", "k"), ("k2",), ("p1",), ("p2",), ("k3",), ("k4",))))


def default_params(model: str, width: Column, height: Column) -> Column:
    """First guess: focal length 1.2 times the longer side, principal point in the centre, no distortion."""
    f = F.greatest(width, height) * 1.2
    value = {"f": f, "fx": f, "fy": f, "cx": width / 2.0, "cy": height / 2.0}
    return F.array(*(value.get(n, F.lit(0.0)).cast("double") for n in CAMERA_MODELS[model][1]))


def rotation(q: tuple[Column, Column, Column, Column]) -> list[list[Column]]:
    """3 x 3 rotation of a quaternion (w, x, y, z), normalised."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    w, x, y, z = (c / n for c in q)
    return [
        [1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - w * z), 2.0 * (x * z + w * y)],
        [2.0 * (x * y + w * z), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - w * x)],
        [2.0 * (x * z - w * y), 2.0 * (y * z + w * x), 1.0 - 2.0 * (x * x + y * y)],
    ]


def transform(q, t, p) -> list[Column]:
    """World to camera: R p + t."""
    r = rotation(q)
    return [r[i][0] * p[0] + r[i][1] * p[1] + r[i][2] * p[2] + t[i] for i in range(3)]


def camera_center(q, t) -> list[Column]:
    """-R' t."""
    r = rotation(q)
    return [-(r[0][i] * t[0] + r[1][i] * t[1] + r[2][i] * t[2]) for i in range(3)]


def nerf_c2w(q, t) -> list[list[Column]]:
    """Camera to world, its second and third axes turned round; 3 rows of 4."""
    r, c = rotation(q), camera_center(q, t)
    return [[r[0][i], -r[1][i], -r[2][i], c[i]] for i in range(3)]


def reprojection_error_normalized(pc, u: Column, v: Column) -> Column:
    """Distance in normalised units; null at or behind the camera."""
    return F.when(pc[2] > DEPTH_EPS, F.sqrt((pc[0] / pc[2] - u) ** 2 + (pc[1] / pc[2] - v) ** 2))


def triangulation_angle(c1, c2, p) -> Column:
    """Radians between the rays from two centres to a point."""
    a, b = [p[i] - c1[i] for i in range(3)], [p[i] - c2[i] for i in range(3)]
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    n = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2]) * F.sqrt(b[0] * b[0] + b[1] * b[1] + b[2] * b[2])
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot / n)))


def upper_median(values: Column) -> Column:
    """sorted[n div 2] of an array, nulls left out; null for an empty one."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.get(s, (F.size(s) / 2).cast("int"))


def glob_regex(pattern: Column) -> Column:
    """Anchored regular expression of a glob with * and ?."""
    escaped = F.regexp_replace(pattern, r"([.\\+^$(){}\[\]|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def trailing_number(name: Column) -> Column:
    d = F.regexp_extract(name, "([0-9]+)$", 1)
    return F.when(d != "", d.cast("long"))


def leading_camera_number(stem: Column) -> Column:
    d = F.regexp_extract(F.lower(stem), "^cam(?:era)?([0-9]+)", 1)
    return F.when(d != "", d.cast("long"))


def is_image_file(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)).isin("jpg", "jpeg", "png")


def rotate_code(code: Column) -> Column:
    """A 4 x 4 bit code turned by 90 degrees: bit (row, column) moves to (column, 3 - row)."""
    out = F.lit(0).cast("int")
    for r in range(4):
        for c in range(4):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(code, r * 4 + c).bitwiseAND(F.lit(1)), c * 4 + 3 - r))
    return out
