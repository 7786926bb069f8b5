"""Plane geometry as Column expressions: distances, lines, triangles, circles, extents, affine maps, equality with a tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import col


def distance2(x1, y1, x2, y2) -> Column:
    """Square of the Euclidean distance."""
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    return dx * dx + dy * dy


def along(x, y, x1, y1, x2, y2) -> Column:
    """Share of a segment at which a point's foot falls, 0 to 1; 0 on a segment without length."""
    t = ((col(x) - col(x1)) * (col(x2) - col(x1)) + (col(y) - col(y1)) * (col(y2) - col(y1))) / F.nullif(distance2(x1, y1, x2, y2), F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def segment_distance(x, y, x1, y1, x2, y2) -> Column:
    """Distance of a point to the nearest point of a segment."""
    t = along(x, y, x1, y1, x2, y2)
    return F.sqrt(distance2(x, y, col(x1) + (col(x2) - col(x1)) * t, col(y1) + (col(y2) - col(y1)) * t))


def line_distance(x, y, line: Column) -> Column:
    """Distance of a point to a line (array of struct x, y); null without points."""
    ends = F.transform(F.sequence(F.lit(0), F.greatest(F.size(line) - 2, F.lit(0))), lambda i: F.struct(F.get(line, i).alias("a"), F.coalesce(F.get(line, i + 1), F.get(line, i)).alias("b")))
    return F.array_min(F.transform(ends, lambda e: segment_distance(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))


def slope(x1, y1, x2, y2) -> Column:
    """Slope and intercept of the line through two points; nulls if it is vertical."""
    m = (col(y2) - col(y1)) / F.nullif(col(x2) - col(x1), F.lit(0.0))
    return F.struct(m.alias("slope"), (col(y1) - m * col(x1)).alias("intercept"))


def point_at(x1, y1, x2, y2, distance) -> Column:
    """The point so far from the first towards the second; the first if they are equal."""
    t = F.coalesce(col(distance) / F.nullif(F.sqrt(distance2(x1, y1, x2, y2)), F.lit(0.0)), F.lit(0.0))
    return F.struct((col(x1) + (col(x2) - col(x1)) * t).alias("x"), (col(y1) + (col(y2) - col(y1)) * t).alias("y"))


def triangle_area(x1, y1, x2, y2, x3, y3) -> Column:
    return F.abs((col(x2) - col(x1)) * (col(y3) - col(y1)) - (col(x3) - col(x1)) * (col(y2) - col(y1))) / 2


def triangle_centre(x1, y1, x2, y2, x3, y3) -> Column:
    return F.struct(((col(x1) + col(x2) + col(x3)) / 3).alias("x"), ((col(y1) + col(y2) + col(y3)) / 3).alias("y"))


def circle_of(x1, y1, x2, y2, x3, y3) -> Column:
    """Centre and radius of the circle through three points; nulls if they are in line."""
    bx, by, cx, cy = col(x2) - col(x1), col(y2) - col(y1), col(x3) - col(x1), col(y3) - col(y1)
    d = F.nullif((bx * cy - by * cx) * 2, F.lit(0.0))
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
    return F.struct((col(x1) + ux).alias("x"), (col(y1) + uy).alias("y"), F.sqrt(ux * ux + uy * uy).alias("radius"))


def circle_contains(circle: Column, x, y) -> Column:
    return distance2(circle["x"], circle["y"], x, y) <= circle["radius"] * circle["radius"]


def extent_area(min_x, min_y, max_x, max_y) -> Column:
    return (col(max_x) - col(min_x)) * (col(max_y) - col(min_y))


def extent_common(a: Column, b: Column) -> Column:
    """The common part of two extents (struct min_x, min_y, max_x, max_y); null where they do not meet."""
    x0, y0, x1, y1 = F.greatest(a["min_x"], b["min_x"]), F.greatest(a["min_y"], b["min_y"]), F.least(a["max_x"], b["max_x"]), F.least(a["max_y"], b["max_y"])
    return F.when((x0 <= x1) & (y0 <= y1), F.struct(x0.alias("min_x"), y0.alias("min_y"), x1.alias("max_x"), y1.alias("max_y")))


def extent_scaled(e: Column, factor: float) -> Column:
    """An extent grown or shrunk about its centre."""
    grow = lambda low, high: (e[high] - e[low]) * ((factor - 1) / 2)
    dx, dy = grow("min_x", "max_x"), grow("min_y", "max_y")
    return F.struct((e["min_x"] - dx).alias("min_x"), (e["min_y"] - dy).alias("min_y"), (e["max_x"] + dx).alias("max_x"), (e["max_y"] + dy).alias("max_y"))


def nearly(a, b, tolerance: float = 1e-6) -> Column:
    """Equal within a tolerance; nan and infinities equal themselves."""
    same = F.abs(col(a) - col(b)) < tolerance
    return (col(a) == col(b)) | F.coalesce(same, F.lit(False))


def affine(x, y, matrix: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """x, y under (a, b, c, d, e, f): a + b x + c y, d + e x + f y, the order of raster geotransforms."""
    a, b, c, d, e, f = matrix
    return F.lit(a) + col(x) * b + col(y) * c, F.lit(d) + col(x) * e + col(y) * f


def affine_inverse(matrix: tuple[float, float, float, float, float, float]) -> tuple[float, float, float, float, float, float]:
    """The map back; an error if there is none."""
    a, b, c, d, e, f = matrix
    det = b * f - c * e
    if det == 0:
        raise ValueError("the matrix has no inverse")
    return ((c * d - a * f) / det, f / det, -c / det, (a * e - b * d) / det, -e / det, b / det)
