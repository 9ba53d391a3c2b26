"""Runs of shapes, and ids and lists of a page's shapes. A run is (y, x0, x1), both ends included.

Discs are runs by Column expressions, polygons by a scanline in numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def discs(points: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(keys, y, x0, x1) of the discs around points (x, y)."""
    reach = F.floor(F.sqrt((F.lit(radius * radius) - F.col("dy") * F.col("dy")).cast("double"))).cast("long")
    rows = points.select(*keys, "x", "y", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("dy"))
    return rows.select(*keys, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") - reach).alias("x0"), (F.col("x") + reach).alias("x1"))


def polygon_runs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """(y, x0, x1) of a filled polygon, its outline included (even-odd rule within)."""
    out: dict[int, list[tuple[float, float]]] = {}
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    for row in range(int(y.min()), int(y.max()) + 1):
        spans = []
        up = (np.minimum(y, y2) <= row) & (np.maximum(y, y2) > row)
        cuts = np.sort(x[up] + (row - y[up]) * (x2[up] - x[up]) / (y2[up] - y[up]))
        spans += list(zip(cuts[::2], cuts[1::2]))
        on = (np.minimum(y, y2) <= row) & (np.maximum(y, y2) >= row)
        for a, b, c, d in zip(x[on], y[on], x2[on], y2[on]):  # the outline itself
            if b == d:
                spans.append((min(a, c), max(a, c)))
            else:
                lo, hi = sorted((max(row - 0.5, min(b, d)), min(row + 0.5, max(b, d))))
                ends = [a + (t - b) * (c - a) / (d - b) for t in (lo, hi)]
                spans.append((min(ends), max(ends)))
        out[row] = spans
    runs = []
    for row, spans in out.items():
        now = None
        for a, b in sorted((int(np.ceil(a - 0.5)), int(np.floor(b + 0.5))) for a, b in spans):
            if now and a <= now[1] + 1:
                now[1] = max(now[1], b)
            else:
                if now:
                    runs.append((row, *now))
                now = [a, b]
        if now:
            runs.append((row, *now))
    return runs


def panoptic_ids(shapes: DataFrame, page: str, tag: str, place: str) -> DataFrame:
    """(page, place, id): ids from 1 in paint order, that of tags and then of the document."""
    w = Window.partitionBy(page).orderBy(tag, place)
    return shapes.select(page, place, F.row_number().over(w).cast("long").alias("id"))


def instances_json(regions: DataFrame, classes: DataFrame) -> DataFrame:
    """(page_id, instances): boxes, categories and outlines of a page's regions as one JSON list, in document order."""
    r = regions.join(F.broadcast(classes.select(F.col("name").alias("rtype"), "class_id")), "rtype")
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "w", "h"))
    one = F.struct("seq", F.struct(F.array(x, y, x + w, y + h).alias("bbox"), F.lit(0).alias("bbox_mode"), (F.col("class_id") - 1).alias("category_id"), F.array(F.array(x, y, x, y + h, x + w, y + h, x + w, y)).alias("segmentation"), F.lit(False).alias("iscrowd")).alias("i"))
    all_of = F.sort_array(F.collect_list(one))
    return r.groupBy("page_id").agg(F.to_json(F.transform(all_of, lambda s: s["i"])).alias("instances"))
