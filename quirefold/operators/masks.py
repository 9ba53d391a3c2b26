"""Label masks of pages: shapes painted in order, and the converters from page tables to masks, instances and panoptic ids.

A mask is a row (page_id, h, w, runs, overlap, empty): runs are structs (y, x0, x1, v), both ends included, of all cells
that are not 0. It is far smaller than its cells, and one page's dense array is all that a task holds at a time. Shapes
are rows (page_id, h, w, tag, place, kind, size, v, pts) with whole points (kind: fill, stroke, sides, disc, ends, or ended, a stroke with its ends): of a page they are painted by tag, then by
place, so that overlaps do not depend on anything else; a later one wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.operators.raster import polygon_runs
from quirefold.sources import pagexml

_RUN = pa.struct([("y", pa.int32()), ("x0", pa.int32()), ("x1", pa.int32()), ("v", pa.int32())])
MASK = "h int, w int, runs array<struct<y:int,x0:int,x1:int,v:int>>, overlap boolean, empty boolean"
# The classes of the two sides of a baseline, and of a baseline and its ends.
TOP, BOTTOM = 1, 2
LINE, END = 1, 2


def runs_of(mask: np.ndarray) -> np.ndarray:
    """(y, x0, x1, v) rows of the cells that are not 0, a maximal run of equal ones each."""
    h, w = mask.shape
    if not mask.any():
        return np.zeros((0, 4), np.int32)
    begins = np.ones((h, w), bool)
    begins[:, 1:] = mask[:, 1:] != mask[:, :-1]
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], h * w) - 1
    v = mask.ravel()[at]
    keep = v != 0
    return np.stack([at[keep] // w, at[keep] % w, ends[keep] % w, v[keep]], axis=1).astype(np.int32)


def dense(runs: np.ndarray, h: int, w: int) -> np.ndarray:
    """The cells of runs (y, x0, x1, v)."""
    out = np.zeros(h * w, np.int32)
    if len(runs):
        size = runs[:, 2] - runs[:, 1] + 1
        at = np.repeat(runs[:, 0].astype(np.int64) * w + runs[:, 1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[at] = np.repeat(runs[:, 3], size)
    return out.reshape(h, w)


def stroke(pts: np.ndarray, size: float, h: int, w: int, square: bool = False) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(y, x, covered, above) of a thick line: cells within size / 2 of it, from row y and column x on, and which of them are above.

    above: on the left of the nearest segment (the first of equally near ones) or on it, y growing downwards. With square
    ends, what is nearest to the first or last segment and not beside it is left out, unless the line is shorter than 2.
    """
    half = size / 2
    x0, y0 = (max(0, int(np.floor(v - half))) for v in pts.min(axis=0))
    x1, y1 = int(min(w - 1, np.ceil(pts[:, 0].max() + half))), int(min(h - 1, np.ceil(pts[:, 1].max() + half)))
    if x1 < x0 or y1 < y0:
        return 0, 0, np.zeros((0, 0), bool), np.zeros((0, 0), bool)
    near = np.full((y1 - y0 + 1, x1 - x0 + 1), np.inf)
    above, beyond = np.zeros(near.shape, bool), np.zeros(near.shape, bool)
    a, b = pts[:-1].astype(float), pts[1:].astype(float)
    length = ((b - a) ** 2).sum(axis=1)
    real = np.flatnonzero(length > 0)
    for k in real if len(real) else [0]:
        (ax, ay), (bx, by) = a[k], b[k]
        u0, v0 = (max(0, int(np.floor(min(p, q) - half)) - o) for p, q, o in ((ax, bx, x0), (ay, by, y0)))
        u1, v1 = (int(np.ceil(max(p, q) + half)) - o + 1 for p, q, o in ((ax, bx, x0), (ay, by, y0)))
        part = np.s_[v0 : max(v1, 0), u0 : max(u1, 0)]
        if not near[part].size:
            continue
        y, x = np.ogrid[v0 : v0 + near[part].shape[0], u0 : u0 + near[part].shape[1]]
        px, py = x + x0 - ax, y + y0 - ay
        dot = px * (bx - ax) + py * (by - ay)
        t = np.clip(dot / length[k], 0, 1) if length[k] else 0 * dot
        d = (px - t * (bx - ax)) ** 2 + (py - t * (by - ay)) ** 2
        better = d < near[part]
        near[part] = np.where(better, d, near[part])
        above[part] = np.where(better, px * (by - ay) - py * (bx - ax) >= 0, above[part])
        off = (dot <= 0) & (k == real[:1]).any() | (dot >= length[k]) & (k == real[-1:]).any()
        beyond[part] = np.where(better, off, beyond[part])
    covered = near <= half * half
    if square and np.sqrt(length).sum() >= 2:
        covered &= ~beyond
    return y0, x0, covered, above


#: Lines whose box has at most so many cells are drawn once for all places: cells depend on whole points relative to each other alone.
STAMP = 1 << 13


@lru_cache(maxsize=512)
def _line_stamp(points: bytes, size: float, square: bool) -> tuple[int, int, np.ndarray, np.ndarray]:
    """`stroke` of points (the least x and y are 0) far from any edge, y and x relative to theirs."""
    pad = int(np.ceil(size / 2)) + 1
    pts = np.frombuffer(points, np.int64).reshape(-1, 2) + pad
    far = pts.max(axis=0) + pad
    y, x, covered, above = stroke(pts, size, int(far[1]) + 1, int(far[0]) + 1, square)
    return y - pad, x - pad, covered, above


@lru_cache(maxsize=64)
def _disc_stamp(r: int) -> np.ndarray:
    reach = np.array([int(np.sqrt(r * r - dy * dy)) for dy in range(-r, r + 1)])
    return np.abs(np.arange(-r, r + 1)) <= reach[:, None]


def _within(y: int, x: int, part: np.ndarray, h: int, w: int) -> tuple[slice, slice, slice, slice]:
    """Rows and columns, of a mask and of a part at (y, x), that lie on the mask."""
    y0, y1, x0, x1 = max(y, 0), max(min(y + part.shape[0], h), 0), max(x, 0), max(min(x + part.shape[1], w), 0)
    return slice(y0, y1), slice(x0, x1), slice(y0 - y, max(y1 - y, 0)), slice(x0 - x, max(x1 - x, 0))


def _disc(mask: np.ndarray, r: int, v: int, at: np.ndarray) -> None:
    stamp = _disc_stamp(r)
    rows, columns, i, j = _within(int(at[1]) - r, int(at[0]) - r, stamp, *mask.shape)
    mask[rows, columns][stamp[i, j]] = v


def paint(mask: np.ndarray, kind: str, size: float, v: int, pts: np.ndarray, square: bool = False) -> bool:
    """Paints one shape; whether it covers cells that were painted before (of lines only)."""
    h, w = mask.shape
    if kind == "ended":  # a line, then its ends
        met = paint(mask, "stroke", size, v, pts, square)
        paint(mask, "ends", size, END, pts)
        return met
    if kind == "ends":
        _disc(mask, int(size), v, pts[0])
        _disc(mask, int(size), v, pts[-1])
        return False
    if kind == "fill":
        (x0, y0), (x1, y1) = pts.min(axis=0), pts.max(axis=0)
        if len(pts) == 4 and ((pts[:, 0] == x0) | (pts[:, 0] == x1)).all() and ((pts[:, 1] == y0) | (pts[:, 1] == y1)).all() and ((pts != np.roll(pts, 1, axis=0)).sum(axis=1) == 1).all():
            if x1 >= 0 and y1 >= 0:  # an upright box
                mask[max(y0, 0) : y1 + 1, max(x0, 0) : x1 + 1] = v
            return False
        for y, x0, x1 in polygon_runs(pts[:, 0].astype(float), pts[:, 1].astype(float)):
            if 0 <= y < h and x1 >= 0:
                mask[y, max(x0, 0) : x1 + 1] = v
        return False
    if kind == "disc":
        _disc(mask, int(size), v, pts[0])
        return False
    low = pts.min(axis=0)
    if np.prod(pts.max(axis=0) - low + size + 4) <= STAMP:
        y, x, covered, above = _line_stamp((pts - low).tobytes(), size, square)
        y, x = y + int(low[1]), x + int(low[0])
        rows, columns, i, j = _within(y, x, covered, h, w)
        y, x, covered, above = rows.start, columns.start, covered[i, j], above[i, j]
    else:
        y, x, covered, above = stroke(pts, size, h, w, square)
    if not covered.size:
        return False
    part = mask[y : y + covered.shape[0], x : x + covered.shape[1]]
    met = bool(part[covered].any())
    part[covered] = np.where(above, TOP, BOTTOM)[covered] if kind == "sides" else v
    return met


def tasks(of: DataFrame) -> int:
    """How many tasks share the pages: a page's work is large for its bytes, so that partitions must not be merged by their size."""
    spark = of.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def painted(shapes: DataFrame, *more: str, square: bool = False, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, more, MASK) of shapes; a page whose shapes are all null has an empty mask.

    With pages (page_id, h, w) there is a row for each of these, also without shapes. They are dealt along with the shapes:
    masks are far larger than these, and are not shuffled for it.
    """
    keys = ["page_id", *more]
    kinds = ", ".join(f"{k} {shapes.schema[k].dataType.simpleString()}" for k in keys)
    rows = shapes.select(*keys, "h", "w", "kind", "size", "v", "pts", "tag", "place")
    if pages is not None:
        of = {"page_id": F.col("page_id"), "h": F.col("h").cast("int"), "w": F.col("w").cast("int"), "kind": F.lit("page")}
        rows = rows.union(pages.select(*[of.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]))
    dealt = rows.repartition(tasks(shapes), *keys).sortWithinPartitions(*keys, "tag", "place").drop("tag", "place")
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mask, met, marks, done, held, types = None, None, False, [], [], 0, None

        def close() -> None:
            """The page at hand is done; it has a row for each time that pages name it."""
            nonlocal held
            runs = np.zeros((0, 4), np.int32) if mask is None else runs_of(mask)
            for k in range(max(len(marks), 1)):
                done.append((now, marks[k] if mask is None else mask.shape, runs, met))
                held += len(runs)

        def flush() -> pa.RecordBatch:
            nonlocal held
            ids, sizes, runs, flags = zip(*done)
            at = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            flat = np.concatenate(runs)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(4)], fields=list(_RUN)))
            columns = [pa.array([i[k] for i in ids], types[k]) for k in range(n)] + [pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1)]
            out = pa.RecordBatch.from_arrays([*columns, lists, pa.array(flags), pa.array([not len(r) for r in runs])], names=[*keys, "h", "w", "runs", "overlap", "empty"])
            done.clear()
            held = 0
            return out

        for batch in batches:
            types = types or [batch.schema.field(k).type for k in range(n)]
            ids, (h, w, kind, size, v) = [batch.column(k).to_pylist() for k in range(n)], (batch.column(n + k).to_pylist() for k in range(5))
            column = batch.column(n + 5)
            begin, whole = column.offsets.to_numpy(), np.stack([column.values.field(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1) if len(column.values) else np.zeros((0, 2), np.int64)
            for k in range(batch.num_rows):
                me = tuple(i[k] for i in ids)
                if me != now:
                    if now is not None:
                        close()
                        if held > 1 << 16 or len(done) >= 1024:
                            yield flush()
                    now, mask, met, marks = me, None, False, []
                if kind[k] == "page":
                    marks.append((h[k], w[k]))
                    continue
                if mask is None:
                    mask = np.zeros((h[k], w[k]), np.int32)
                pts = whole[begin[k] : begin[k + 1]]
                if len(pts):
                    met |= paint(mask, kind[k], size[k], v[k], pts.astype(np.int64), square)
        if now is not None:
            close()
        if done:
            yield flush()

    return dealt.mapInArrow(run, f"{kinds}, {MASK}")


def run_rows(masks: DataFrame, *more: str) -> DataFrame:
    """(page_id, more, y, x0, x1, v) of every run."""
    return masks.select("page_id", *more, F.explode("runs").alias("r")).select("page_id", *more, "r.*")


def cells_by_value(masks: DataFrame, *more: str) -> DataFrame:
    """(page_id, more, v, n): how many cells each value has."""
    return run_rows(masks, *more).groupBy("page_id", *more, "v").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))


# --- converters ---


@dataclass
class Layout:
    """The tables of pages: pages (page_id, page_h, page_w), regions (page_id, place, tag, rtype, pts), lines (page_id, place, pts), baselines (page_id, place, pts) and baselines with a class (page_id, tag, place, class_id, pts)."""

    pages: DataFrame
    regions: DataFrame
    lines: DataFrame
    baselines: DataFrame
    class_baselines: DataFrame
    classes: DataFrame

    @classmethod
    def read(cls, documents: DataFrame, classes: DataFrame, column: str = "xml") -> Layout:
        """The tables of page XML documents (page_id, column). classes: (name, class_id)."""
        of = pagexml.elements(documents, column)
        return cls(pagexml.pages_of(of).filter("error IS NULL"), pagexml.regions_of(of), pagexml.lines_of(of), pagexml.baselines_of(of), pagexml.class_baselines(of, classes), classes)

    def typed(self) -> DataFrame:
        """Regions of known type with three points at least, and class_id."""
        known = self.classes.select(F.col("name").alias("rtype"), "class_id")
        return self.regions.join(F.broadcast(known), "rtype").filter(F.size("pts") >= 3)


def scaled(of: DataFrame, layout: Layout, sizes: DataFrame | None) -> DataFrame:
    """With h, w of the mask (a page's own size if there are no sizes (page_id, h, w)) and pts in it, in single precision."""
    pages = layout.pages.select("page_id", F.col("page_h").alias("_h"), F.col("page_w").alias("_w"))
    to = pages.join(sizes.select("page_id", "h", "w"), "page_id") if sizes is not None else pages.withColumn("h", F.col("_h")).withColumn("w", F.col("_w"))
    out = of.drop("page_h", "page_w").join(to, "page_id")
    return out.withColumn("pts", G.scaled(F.col("pts"), F.col("h"), F.col("w"), F.col("_h"), F.col("_w"))).withColumn("h", F.col("h").cast("int")).withColumn("w", F.col("w").cast("int")).drop("_h", "_w")


def whole(pts: Column) -> Column:
    """Points rounded half to even."""
    return F.transform(pts, lambda p: F.struct(F.bround(p["x"].cast("double")).cast("int").alias("x"), F.bround(p["y"].cast("double")).cast("int").alias("y")))


def _shapes(of: DataFrame, kind: str, size: float, v: Column, pts: Column | None = None, tag: Column | None = None, step: int = 0) -> DataFrame:
    order = F.struct(F.col("place").cast("long").alias("place"), F.lit(step).alias("step"))
    return of.select("page_id", "h", "w", (F.lit("") if tag is None else tag).alias("tag"), order.alias("place"), F.lit(kind).alias("kind"), F.lit(float(size)).alias("size"), v.cast("int").alias("v"), whole(F.col("pts") if pts is None else pts).alias("pts"))


def _ends(of: DataFrame, size: float, v: int, first: bool = True, last: bool = True, step: int = 0) -> DataFrame:
    ends = [F.slice("pts", 1, 1)] * first + [F.slice("pts", -1, 1)] * last
    parts = [_shapes(of, "disc", size, F.lit(v), p, step=step + k) for k, p in enumerate(ends)]
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def _regions(layout: Layout, sizes, width: int) -> DataFrame:
    return _shapes(scaled(layout.typed(), layout, sizes), "fill", 0, F.col("class_id"), tag=F.col("tag"))


def _lines(layout: Layout, sizes, width: int) -> DataFrame:
    return _shapes(scaled(layout.lines, layout, sizes), "fill", 0, F.lit(1))


def _baselines(layout: Layout, sizes, width: int) -> DataFrame:
    return _shapes(scaled(layout.baselines, layout, sizes), "stroke", width, F.lit(LINE))


def _class_baselines(layout: Layout, sizes, width: int) -> DataFrame:
    return _shapes(scaled(layout.class_baselines, layout, sizes), "stroke", width, F.col("class_id"), tag=F.col("tag"))


def _sides(layout: Layout, sizes, width: int) -> DataFrame:
    return _shapes(scaled(layout.baselines, layout, sizes), "sides", width, F.lit(TOP))


def _baselines_with_ends(layout: Layout, sizes, width: int) -> DataFrame:
    """As `_baseline_separators`, in one row a baseline."""
    return _shapes(scaled(layout.baselines, layout, sizes), "ended", width, F.lit(LINE))


def _both_ends(layout: Layout, sizes, width: int) -> DataFrame:
    return _shapes(scaled(layout.baselines, layout, sizes), "ends", width, F.lit(1))


def _baseline_separators(layout: Layout, sizes, width: int) -> DataFrame:
    of = scaled(layout.baselines, layout, sizes)
    return _shapes(of, "stroke", width, F.lit(LINE)).union(_ends(of, width, END, step=1))


def _all_ends(first: bool, last: bool):
    return lambda layout, sizes, width: _ends(scaled(layout.baselines, layout, sizes), width, 1, first, last)


Shapes = Callable[[Layout, DataFrame | None, int], DataFrame]
#: What is painted in each mode.
MODES: dict[str, Shapes] = {
    "region": _regions, "baseline": _baselines, "class_baseline": _class_baselines, "text_line": _lines, "top_bottom": _sides,
    "start": _all_ends(True, False), "end": _all_ends(False, True), "separator": _all_ends(True, True), "baseline_separator": _baseline_separators,
}
#: Where a shape needs no number or plane of its own, what goes by several rows a baseline there goes by one.
TOGETHER: dict[str, Shapes] = MODES | {"separator": _both_ends, "baseline_separator": _baselines_with_ends}
OUTPUTS: dict[str, Callable[..., DataFrame]] = {}


def output(name: str):
    """Registers a kind of output: a function of (layout, mode, sizes, width, square)."""

    def add(f):
        OUTPUTS[name] = f
        return f

    return add


def converted(layout: Layout, name: str, mode: str, sizes: DataFrame | None = None, width: int = 5, square: bool = False) -> DataFrame:
    """One output of pages in one mode."""
    if name not in OUTPUTS:
        raise NotImplementedError(f"unknown output: {name}")
    if mode not in MODES:
        raise NotImplementedError(f"unknown mode: {mode}")
    return OUTPUTS[name](layout, mode, sizes, width, square)


def _pages(layout: Layout, sizes: DataFrame | None) -> DataFrame:
    """(page_id, h, w) of every mask."""
    return sizes if sizes is not None else layout.pages.select("page_id", F.col("page_h").alias("h"), F.col("page_w").alias("w"))


@output("sem_seg")
def sem_seg(layout: Layout, mode: str, sizes: DataFrame | None, width: int, square: bool) -> DataFrame:
    """(page_id, MASK): one class a cell; `overlap` tells of lines that meet, `empty` of a page without any shape."""
    return painted(TOGETHER[mode](layout, sizes, width), square=square, pages=_pages(layout, sizes))


@output("binary_seg")
def binary_seg(layout: Layout, mode: str, sizes: DataFrame | None, width: int, square: bool) -> DataFrame:
    """(page_id, plane, MASK): a plane of its own, from 0, for each class that a page has, so that none hides another."""
    shapes = MODES[mode](layout, sizes, width)
    return painted(shapes.withColumn("plane", F.col("v") - 1).withColumn("v", F.lit(1)), "plane", square=square)


def _numbered(shapes: DataFrame) -> DataFrame:
    """With the shape's id on its page, from 1 in the order of painting."""
    from pyspark.sql import Window

    return shapes.withColumn("id", F.row_number().over(Window.partitionBy("page_id").orderBy("tag", "place")))


def _category(mode: str) -> Column:
    return F.col("v") - 1 if mode in ("region", "class_baseline") else F.lit(0)


@output("panoptic")
def panoptic(layout: Layout, mode: str, sizes: DataFrame | None, width: int, square: bool) -> DataFrame:
    """(page_id, MASK) in which each shape's cells hold its id, from 1 in the order of painting; see `segments`."""
    shapes = _numbered(MODES[mode](layout, sizes, width))
    return painted(shapes.withColumn("v", F.col("id")), square=square, pages=_pages(layout, sizes))


@output("segments")
def segments(layout: Layout, mode: str, sizes: DataFrame | None, width: int, square: bool) -> DataFrame:
    """(page_id, id, category_id, iscrowd) of the panoptic shapes, also of those that others hide."""
    return _numbered(MODES[mode](layout, sizes, width)).select("page_id", "id", _category(mode).cast("int").alias("category_id"), F.lit(False).alias("iscrowd"))


@output("instances")
def instances(layout: Layout, mode: str, sizes: DataFrame | None, width: int, square: bool) -> DataFrame:
    """(page_id, id, category_id, bbox, bbox_mode, segmentation, keypoints, iscrowd) of each shape: its points, or the outline of a line's cells."""
    shape = MODES[mode]
    if mode in ("region", "text_line"):
        of = scaled(layout.typed() if mode == "region" else layout.lines, layout, sizes)
        order = {"tag": F.col("tag"), "v": F.col("class_id")} if mode == "region" else {"tag": F.lit(""), "v": F.lit(1)}
        each = _numbered(of.select("page_id", order["tag"].alias("tag"), "place", order["v"].alias("v"), "pts"))
        flat = F.flatten(F.transform("pts", lambda p: F.array(p["x"], p["y"])))
        box = G.box(F.col("pts"))
        got = each.select("page_id", "id", _category(mode).cast("int").alias("category_id"), F.array(*[box[k].cast("float") for k in ("x0", "y0", "x1", "y1")]).alias("bbox"), F.array(flat).alias("segmentation"))
    else:
        masks = painted(_numbered(shape(layout, sizes, width)).withColumn("v", F.col("v").cast("int")), "id", "v", square=square).filter("NOT empty")
        got = outlined(masks.select("page_id", F.col("id").cast("long").alias("id"), _category(mode).cast("int").alias("category_id"), "h", "w", "runs"))
    return got.select("page_id", F.col("id").cast("int").alias("id"), "category_id", "bbox", F.lit(0).alias("bbox_mode"), "segmentation", F.array().cast("array<float>").alias("keypoints"), F.lit(False).alias("iscrowd"))


def outlined(masks: DataFrame) -> DataFrame:
    """(page_id, id, category_id, bbox, segmentation) of masks (page_id, id, category_id, h, w, runs): the outline of each component."""
    from quirefold.operators.vectorize import labelled, outline

    kind = masks.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes, rings = [], []
            for r in batch.column(5).to_pylist():
                cells = np.array([(x["y"], x["x0"], x["x1"], 1) for x in r], np.int64)
                y0, x0 = cells[:, 0].min(), cells[:, 1].min()
                small = dense(cells - [y0, x0, x0, 0], int(cells[:, 0].max() - y0 + 1), int(cells[:, 2].max() - x0 + 1))
                marks, n = labelled(small)
                rings.append([(outline(marks == k) + [x0, y0]).astype(float).ravel().tolist() for k in range(1, n + 1)])
                boxes.append([float(x0), float(y0), float(cells[:, 2].max()), float(cells[:, 0].max())])
            floats = pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(boxes, floats), pa.array(rings, pa.list_(floats))], names=["page_id", "id", "category_id", "bbox", "segmentation"])

    return masks.mapInArrow(run, f"page_id {kind}, id long, category_id int, bbox array<float>, segmentation array<array<float>>")


@output("yolo_detection")
def yolo_detection(layout: Layout, mode: str, sizes: DataFrame | None, width: int, square: bool) -> DataFrame:
    """(page_id, id, category_id, cx, cy, box_w, box_h) of regions, by the mask's size less one."""
    of = scaled(layout.typed(), layout, sizes)
    norm = G.normalised(F.col("pts"), F.col("h"), F.col("w"))
    each = _numbered(of.select("page_id", "tag", "place", (F.col("class_id") - 1).alias("category_id"), G.centre_box(G.box(norm)).alias("b")))
    return each.select("page_id", "id", "category_id", "b.cx", "b.cy", F.col("b.w").alias("box_w"), F.col("b.h").alias("box_h"))


@output("yolo_segmentation")
def yolo_segmentation(layout: Layout, mode: str, sizes: DataFrame | None, width: int, square: bool) -> DataFrame:
    """(page_id, id, category_id, pts) of regions, by the mask's size less one."""
    of = scaled(layout.typed(), layout, sizes)
    each = of.select("page_id", "tag", "place", (F.col("class_id") - 1).alias("category_id"), G.normalised(F.col("pts"), F.col("h"), F.col("w")).alias("pts"))
    return _numbered(each).select("page_id", "id", "category_id", "pts")
