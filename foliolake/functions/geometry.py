"""Rectangles, matrices, rotations and permissions as columns. A rectangle is a struct (min_x, min_y, max_x, max_y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("min_x", "min_y", "max_x", "max_y")


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The corners in either order."""
    return F.struct(F.least(x0, x1).alias("min_x"), F.least(y0, y1).alias("min_y"), F.greatest(x0, x1).alias("max_x"), F.greatest(y0, y1).alias("max_y"))


def width(r: Column) -> Column:
    return r["max_x"] - r["min_x"]


def height(r: Column) -> Column:
    return r["max_y"] - r["min_y"]


def intersects(a: Column, b: Column) -> Column:
    """Touching counts."""
    return (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"]) & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])


def union(r: Column) -> Column:
    """Aggregate: the box around all rectangles of a group."""
    return F.struct(F.min(r["min_x"]).alias("min_x"), F.min(r["min_y"]).alias("min_y"), F.max(r["max_x"]).alias("max_x"), F.max(r["max_y"]).alias("max_y"))


def iou(a: Column, b: Column) -> Column:
    w = F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"])
    h = F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"])
    both = width(a) * height(a) + width(b) * height(b) - w * h
    return F.when((w > 0) & (h > 0) & (both > 0), w * h / both).otherwise(0.0)


def centroid_distance(a: Column, b: Column) -> Column:
    dx = (a["min_x"] + a["max_x"] - b["min_x"] - b["max_x"]) / 2
    dy = (a["min_y"] + a["max_y"] - b["min_y"] - b["max_y"]) / 2
    return F.sqrt(dx * dx + dy * dy)


def centre_inside(inner: Column, outer: Column, slack: float = 0.0) -> Column:
    x, y = (inner["min_x"] + inner["max_x"]) / 2, (inner["min_y"] + inner["max_y"]) / 2
    return x.between(outer["min_x"] - slack, outer["max_x"] + slack) & y.between(outer["min_y"] - slack, outer["max_y"] + slack)


def matrix(*six: Column) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip(six, "abcdef")))


def multiply(m: Column, n: Column) -> Column:
    """The matrix that applies ``m`` first."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"], m["c"] * n["a"] + m["d"] * n["c"], m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"], m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def transform(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def inverse(m: Column) -> Column:
    """Null where there is none."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    back = matrix(m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det, (m["c"] * m["f"] - m["d"] * m["e"]) / det, (m["b"] * m["e"] - m["a"] * m["f"]) / det)
    return F.when(F.abs(det) > 1e-12, back)


def normal_rotation(degrees: Column) -> Column:
    """The nearest of 0, 90, 180 and 270; halves go up."""
    r = F.pmod(degrees, F.lit(360))
    return F.when((r < 45) | (r >= 315), 0).when(r < 135, 90).when(r < 225, 180).otherwise(270)


def rgb_from_gray(g: Column) -> Column:
    return F.array(g, g, g)


def rgb_from_cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.array(*((1 - x) * (1 - k) for x in (c, m, y)))


#: The bit of each permission, from 0, and the bits that are always set.
PERMISSION_BITS = {"print": 2, "modify": 3, "copy": 4, "annotate": 5, "fill": 8, "accessibility": 9, "assemble": 10, "print_high": 11}
RESERVED = 0xFFFFF0C0


def permission(p: Column, name: str) -> Column:
    return p.cast("int").bitwiseAND(F.lit(1 << PERMISSION_BITS[name])) != 0


def allows(p: Column, action: str) -> Column:
    """Whether ``/P`` lets a user do something; some actions follow from either or need both of two bits."""
    one = lambda n: permission(p, n)
    return {
        "print": lambda: one("print"), "copy": lambda: one("copy"), "modify": lambda: one("modify"), "annotate": lambda: one("annotate"),
        "fill": lambda: one("fill") | one("annotate"), "assemble": lambda: one("assemble") | one("modify"), "create_field": lambda: one("modify") & one("annotate"),
        "everything": lambda: one("print") & one("copy") & one("modify") & one("annotate") & one("fill") & one("assemble"),
    }[action]()


def permission_value(**allowed: Column) -> Column:
    """``/P`` for boolean columns by permission name; those not named are clear."""
    out = F.lit(RESERVED - (1 << 32)).cast("int")
    for name, col in allowed.items():
        out = out.bitwiseOR(F.when(col, F.lit(1 << PERMISSION_BITS[name])).otherwise(F.lit(0)))
    return out


#: Ready-made sets.
READ_ONLY = ("print", "accessibility", "print_high")
FORMS_ONLY = ("print", "fill", "accessibility", "print_high")


def permission_preset(names) -> int:
    value = RESERVED
    for n in names:
        value |= 1 << PERMISSION_BITS[n]
    return value - (1 << 32)
