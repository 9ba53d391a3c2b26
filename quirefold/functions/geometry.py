"""Geometry of points, boxes and polylines as Column expressions.

A polygon is ARRAY<STRUCT<x, y>>. All functions take and give Columns and stay within built-in functions. Distances and
sides follow image coordinates (y grows downwards).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def points(text: Column) -> Column:
    """"x,y x,y" to an array of points."""
    part = lambda q, k: F.element_at(F.split(q, ","), k).cast("int")
    return F.transform(F.split(F.trim(text), r"\s+"), lambda q: F.struct(part(q, 1).alias("x"), part(q, 2).alias("y")))


def point_text(pts: Column) -> Column:
    """Points to "x,y x,y", coordinates rounded half to even."""
    whole = lambda v: F.bround(v.cast("double")).cast("int").cast("string")
    return F.array_join(F.transform(pts, lambda p: F.concat(whole(p["x"]), F.lit(","), whole(p["y"]))), " ")


def moved(pts: Column, x, y) -> Column:
    """Points with x and y replaced by functions of the old point."""
    return F.transform(pts, lambda p: F.struct(x(p).alias("x"), y(p).alias("y")))


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The four corners of a box, from the top left against the clock's direction on paper (down first)."""
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(corner(x, y), corner(x, y + h), corner(x + w, y + h), corner(x + w, y))


def scaled(pts: Column, out_h: Column, out_w: Column, h: Column, w: Column) -> Column:
    """To another page size, by (out - 1) / (in - 1), in single precision."""
    by = lambda v, o, i: (v * ((o - 1) / (i - 1))).cast("float")
    return moved(pts, lambda p: by(p["x"], out_w, w), lambda p: by(p["y"], out_h, h))


def normalised(pts: Column, h: Column, w: Column) -> Column:
    """By (size - 1), in single precision."""
    return moved(pts, lambda p: (p["x"] / (w - 1)).cast("float"), lambda p: (p["y"] / (h - 1)).cast("float"))


def box(pts: Column) -> Column:
    """Least and greatest x and y as struct (x0, y0, x1, y1)."""
    of = lambda f, k: f(F.transform(pts, lambda p: p[k]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def centre_box(b: Column) -> Column:
    """A box as struct (cx, cy, w, h)."""
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("cx"), ((b["y0"] + b["y1"]) / 2).alias("cy"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"))


def twice_area(pts: Column) -> Column:
    """Twice the signed area of the closed polygon (shoelace)."""
    n = F.size(pts)
    following = F.concat(F.slice(pts, 2, F.greatest(n - 1, F.lit(0))), F.slice(pts, 1, 1))
    terms = F.zip_with(pts, following, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def resized(pts: Column, new_h: Column, new_w: Column, h: Column, w: Column) -> Column:
    """As images are resized: by new / old."""
    return moved(pts, lambda p: p["x"] * new_w / w, lambda p: p["y"] * new_h / h)


def flipped_x(pts: Column, w: Column) -> Column:
    return moved(pts, lambda p: w - p["x"], lambda p: p["y"])


def flipped_y(pts: Column, h: Column) -> Column:
    return moved(pts, lambda p: p["x"], lambda p: h - p["y"])


def affine(pts: Column, m: tuple[tuple[float, float, float], tuple[float, float, float]]) -> Column:
    """By a 2 x 3 matrix."""
    (a, b, c), (d, e, f) = m
    return moved(pts, lambda p: p["x"] * a + p["y"] * b + c, lambda p: p["x"] * d + p["y"] * e + f)


def turned(pts: Column, quarter: Column, h: Column, w: Column) -> Column:
    """By 0, 1, 2 or 3 quarter turns against the clock; half a turn gives (w - x, h - y)."""
    pick = lambda p, zero, one, two, three: F.when(quarter == 0, zero).when(quarter == 1, one).when(quarter == 2, two).otherwise(three)
    return moved(pts, lambda p: pick(p, p["x"], p["y"], w - p["x"], h - p["y"]), lambda p: pick(p, p["y"], w - p["x"], h - p["y"], p["x"]))


def shifted(pts: Column, dx: Column, dy: Column) -> Column:
    """Padding adds, cropping takes away, the offset."""
    return moved(pts, lambda p: p["x"] + dx, lambda p: p["y"] + dy)


def cross(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cross product of a->p and a->b; its sign is the side."""
    return (px - ax) * (by - ay) - (py - ay) * (bx - ax)


def along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Dot product of a->p and a->b; within (0, |a->b|^2) the foot of p is within the segment."""
    return (px - ax) * (bx - ax) + (py - ay) * (by - ay)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment: from the line if the foot is within, else from the nearer end."""
    length = ((bx - ax) * (bx - ax) + (by - ay) * (by - ay)).cast("double")
    dot = along(px, py, ax, ay, bx, by)
    root = lambda x, y: F.sqrt((x * x + y * y).cast("double"))
    return F.when(dot <= 0, root(px - ax, py - ay)).when(dot >= length, root(px - bx, py - by)).otherwise(F.abs(cross(px, py, ax, ay, bx, by)).cast("double") / F.sqrt(length))


def rectangles_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether boxes (x, y, w, h) overlap or touch; an empty one meets nothing."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    return (aw > 0) & (ah > 0) & (bw > 0) & (bh > 0) & (ax <= bx + bw) & (bx <= ax + aw) & (ay <= by + bh) & (by <= ay + ah)


def _sized(h: Column, w: Column, scale: Column, most: int | None) -> tuple[Column, Column]:
    h, w = h * scale, w * scale
    if most and most > 0:
        top = F.greatest(h, w)
        more = F.when(top > most, F.lit(float(most)) / top).otherwise(F.lit(1.0))
        h, w = h * more, w * more
    return F.floor(h + 0.5).cast("int"), F.floor(w + 0.5).cast("int")


def size_by_scale(h: Column, w: Column, scale: float, most: int | None = None, dpi: Column | None = None, target_dpi: int | None = None) -> tuple[Column, Column]:
    """(height, width) by a factor, towards a resolution where both are known, and down to the greatest edge."""
    by = F.lit(float(scale))
    if dpi is not None and target_dpi is not None:
        by = F.when(dpi.isNotNull(), by * target_dpi / dpi).otherwise(by)
    return _sized(h.cast("double"), w.cast("double"), by, most)


def size_by_edge(h: Column, w: Column, edge: int, longest: bool, most: int | None = None) -> tuple[Column, Column]:
    """(height, width) such that the longest or shortest edge is so long; 0 or less: unchanged."""
    if edge <= 0:
        return h.cast("int"), w.cast("int")
    of = F.greatest(h, w) if longest else F.least(h, w)
    return _sized(h.cast("double"), w.cast("double"), F.lit(float(edge)) / of, most)


def colour_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Squared distance of RGB colours, weighted by the mean of red."""
    mean = (a[0] + b[0]) / 2
    sq = lambda k: (a[k] - b[k]) * (a[k] - b[k])
    return (F.lit(2) + mean / 256) * sq(0) + sq(1) * 4 + (F.lit(2) - (F.lit(255) - mean) / 256) * sq(2)


def packed_id(n: Column) -> Column:
    """A whole number as three digits to base 256, the least first."""
    return F.struct((n % 256).alias("r"), (F.floor(n / 256) % 256).alias("g"), (F.floor(n / 65536) % 256).alias("b"))


def rounded_up(v: Column) -> Column:
    """Halves away from below."""
    return F.floor(v + 0.5)


def rescaled(v: Column, lo: Column, hi: Column, to_lo: float = 0.0, to_hi: float = 1.0) -> Column:
    return (v - lo) * (to_hi - to_lo) / (hi - lo) + to_lo
