"""Queries of the operators on page XML, masks, predictions and comparisons, over all pages of the carrier tables.

Two carriers: "crowded" pages hold each order's lines as regions that may overlap, at a tenth of their size; "ruled" pages,
300 x 100 cells, hold them in rows of their own, so that SQL can tell what becomes of each region by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.operators import evaluate as E
from quirefold.operators import extract as X
from quirefold.operators import jobs, taxonomy
from quirefold.operators import masks as M
from quirefold.plans.catalog import _CORNERS, _P, _R, query
from quirefold.sources import carriers as S
from quirefold.sources import pagexml

WIDTH, RULED_H, RULED_W, RATIO = 5, 300, 100, 0.01
NAMES = ["heading", "marginalia", "paragraph"]


def _classes(spark):
    return taxonomy.classes(spark, NAMES)


def _tag():
    return F.when(F.col("rtype") == "marginalia", "ImageRegion").otherwise("TextRegion")


def _layout(spark, pages, boxes):
    """A layout of pages (page_id, page_h, page_w) and boxes (page_id, seq, rtype, x, y, w, h): each is a region and, two cells smaller, its text line, with a baseline from left to right near its foot."""
    i = lambda c: F.col(c).cast("int")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    b = boxes.withColumn("tag", _tag()).withColumn("place", F.col("seq").cast("int"))
    regions = b.select("page_id", "place", "tag", "rtype", G.rectangle(i("x"), i("y"), i("w"), i("h")).alias("pts"))
    lines = b.select("page_id", "place", G.rectangle(i("x") + 2, i("y") + 2, i("w") - 4, i("h") - 2).alias("pts"))
    foot = i("y") + i("h") - 1
    under = b.select("page_id", "place", "tag", "rtype", F.array(point(i("x"), foot), point(i("x") + i("w"), foot)).alias("pts"))
    classes = _classes(spark)
    known = classes.select(F.col("name").alias("rtype"), "class_id")
    return M.Layout(pages, regions, lines, under.drop("tag", "rtype"), under.join(F.broadcast(known), "rtype").drop("rtype"), classes)


def _crowded(spark, sf_dir):
    """The layout and the sizes of its masks, a tenth of the pages'."""
    pages = S.page(spark, sf_dir).select("page_id", F.col("h").alias("page_h"), F.col("w").alias("page_w"))
    sizes = pages.select("page_id", F.floor(F.col("page_h") / 10).cast("int").alias("h"), F.floor(F.col("page_w") / 10).cast("int").alias("w"))
    return _layout(spark, pages, S.region(spark, sf_dir)), sizes


def _ruled_boxes(spark, sf_dir):
    return S.region(spark, sf_dir).select("page_id", "seq", "rtype", (F.col("x") % 60).alias("x"), ((F.col("seq") - 1) * 14 + 2).alias("y"), (F.col("w") - 20) % 20 + 8, ((F.col("h") - 10) / 5).cast("int") % 5 + 4).toDF("page_id", "seq", "rtype", "x", "y", "w", "h")


def _ruled(spark, sf_dir):
    boxes = _ruled_boxes(spark, sf_dir)
    pages = S.page(spark, sf_dir).select("page_id", F.lit(RULED_H).alias("page_h"), F.lit(RULED_W).alias("page_w"))
    return _layout(spark, pages, boxes)


# The same in SQL: crowded corners in cells of the mask, and ruled boxes.
_A = "CAST(round_even(CAST({0} * ((floor({1} / 10) - 1)::DOUBLE / ({1} - 1)) AS FLOAT), 0) AS BIGINT)"
_AX, _AY = (lambda e: _A.format(f"({e})", "p.w")), (lambda e: _A.format(f"({e})", "p.h"))
_CLASS = "CASE rtype WHEN 'heading' THEN 1 WHEN 'marginalia' THEN 2 WHEN 'paragraph' THEN 3 END"
_ORD = "CASE WHEN rtype = 'marginalia' THEN 0 ELSE 1000 END + seq"
_CROWD = f"{_R}, {_P}, a AS (SELECT r.page_id, seq, rtype, CAST({_CLASS} AS INT) AS cls, {_ORD} AS ord, CAST(floor(p.h / 10) AS BIGINT) AS ph, CAST(floor(p.w / 10) AS BIGINT) AS pw, {_AX('x')} AS x0, {_AX('x + r.w')} AS x1, {_AY('y')} AS y0, {_AY('y + r.h')} AS y1, {_AX('x + 2')} AS lx0, {_AX('x + r.w - 2')} AS lx1, {_AY('y + 2')} AS ly0, {_AY('y + r.h')} AS ly1, {_AY('y + r.h - 1')} AS ft FROM region_ r JOIN page_ p USING (page_id))"
_RULE = f"{_R}, b AS (SELECT page_id, seq, rtype, CAST({_CLASS} AS INT) AS cls, x % 60 AS x0, (seq - 1) * 14 + 2 AS y0, x % 60 + (w - 20) % 20 + 8 AS x1, (seq - 1) * 14 + 2 + CAST((h - 10) / 5 AS INT) % 5 + 4 AS y1 FROM region_)"
# Runs (page_id, ord, v, y, x0, x1) of boxes, of lines 5 wide, and of discs of radius 5.
_BOX_RUNS = "SELECT page_id, {ord} AS ord, {v} AS v, unnest(range({y0}, {y1} + 1)) AS y, {x0} AS x0, {x1} AS x1, pw, ph FROM a"
_LINE_RUNS = "SELECT page_id, {ord} AS ord, {v} AS v, ft + dy AS y, x0 - CASE WHEN abs(dy) = 2 THEN 1 ELSE 2 END AS x0, x1 + CASE WHEN abs(dy) = 2 THEN 1 ELSE 2 END AS x1, pw, ph FROM (SELECT *, unnest(range(-2, 3)) AS dy FROM a)"
_DISC_RUNS = "SELECT page_id, {ord} AS ord, {v} AS v, ft + dy AS y, {x} - CAST(floor(sqrt(CAST(25 - dy * dy AS DOUBLE))) AS BIGINT) AS x0, {x} + CAST(floor(sqrt(CAST(25 - dy * dy AS DOUBLE))) AS BIGINT) AS x1, pw, ph FROM (SELECT *, unnest(range(-5, 6)) AS dy FROM a)"


def _cells(runs: str, where: str = "") -> str:
    """Cells of runs with the value of the last painted."""
    return f"WITH {_CROWD}, r AS ({runs}), c AS (SELECT page_id, ord, v, y, unnest(range(greatest(x0, 0), least(x1, pw - 1) + 1)) AS x FROM r WHERE y >= 0 AND y < ph), k AS (SELECT page_id, y, x, arg_max(v, ord) AS v, count(*) AS n FROM c GROUP BY page_id, y, x)"


def _per_value(runs: str) -> str:
    return f"{_cells(runs)} SELECT page_id, CAST(v AS INT) AS v, count(*) AS n FROM k GROUP BY page_id, v"


def _mode(name: str, mode: str, sql: str):
    """A query of the cells that each value has on each page, in one mode."""

    def run(spark, sf_dir):
        layout, sizes = _crowded(spark, sf_dir)
        return M.cells_by_value(M.converted(layout, "sem_seg", mode, sizes, WIDTH))

    run.__doc__ = f"Cells of each value on each page, mode {mode}."
    return query(name, sql)(run)


def _line(v: str = "1", order: str = "seq") -> str:
    return _LINE_RUNS.format(ord=order, v=v)


_mode("r02_fill", "region", _per_value(_BOX_RUNS.format(ord="ord", v="cls", x0="x0", x1="x1", y0="y0", y1="y1") + " WHERE cls IS NOT NULL"))
_mode("r04_class_baseline_seg", "class_baseline", _per_value(_line("cls", "ord") + " WHERE cls IS NOT NULL"))
_mode("r05_text_line_seg", "text_line", _per_value(_BOX_RUNS.format(ord="seq", v="1", x0="lx0", x1="lx1", y0="ly0", y1="ly1")))
_mode("r06_top_bottom_seg", "top_bottom", _per_value(_line("CASE WHEN dy <= 0 THEN 1 ELSE 2 END")))
_mode("r07_start_seg", "start", _per_value(_DISC_RUNS.format(ord="seq", v="1", x="x0")))
_mode("r07_end_seg", "end", _per_value(_DISC_RUNS.format(ord="seq", v="1", x="x1")))
_mode("r08_separator_seg", "separator", _per_value(_DISC_RUNS.format(ord="seq", v="1", x="x0") + " UNION ALL " + _DISC_RUNS.format(ord="seq", v="1", x="x1")))
_mode("r09_baseline_separator_seg", "baseline_separator", _per_value(_line("1", "seq * 3") + " UNION ALL " + _DISC_RUNS.format(ord="seq * 3 + 1", v="2", x="x0") + " UNION ALL " + _DISC_RUNS.format(ord="seq * 3 + 2", v="2", x="x1")))


@query("r03_baseline_seg", f"{_cells(_line())}, g AS (SELECT page_id, count(*) AS n, max(n) > 1 AS overlap FROM k GROUP BY page_id) SELECT p.page_id, coalesce(g.n, 0) AS n, coalesce(g.overlap, FALSE) AS overlap, g.n IS NULL AS empty FROM page_ p LEFT JOIN g ON g.page_id = p.page_id")
def r03(spark, sf_dir):
    """Cells under baselines of every page, and whether lines meet or there are none (R03, R15)."""
    layout, sizes = _crowded(spark, sf_dir)
    m = M.converted(layout, "sem_seg", "baseline", sizes, WIDTH)
    n = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["x1"] - r["x0"] + 1)
    return m.select("page_id", n.alias("n"), "overlap", "empty")


@query("r10_binary_planes", f"WITH {_CROWD}, r AS ({_BOX_RUNS.format(ord='ord', v='cls', x0='x0', x1='x1', y0='y0', y1='y1')} WHERE cls IS NOT NULL), c AS (SELECT DISTINCT page_id, v, y, unnest(range(x0, x1 + 1)) AS x FROM r) SELECT page_id, CAST(v - 1 AS INT) AS plane, 1 AS v, count(*) AS n FROM c GROUP BY page_id, v")
def r10(spark, sf_dir):
    """Cells of each class in a plane of its own."""
    layout, sizes = _crowded(spark, sf_dir)
    return M.cells_by_value(M.converted(layout, "binary_seg", "region", sizes, WIDTH), "plane")


@query("r11_region_instances", f"WITH {_R}, {_P} SELECT r.page_id, CAST(row_number() OVER (PARTITION BY r.page_id ORDER BY {_ORD}) AS INT) AS id, CAST({_CLASS} AS INT) - 1 AS category_id, " + ", ".join(f"CAST({v} * ((floor({s} / 10) - 1)::DOUBLE / ({s} - 1)) AS FLOAT) AS {n}" for n, v, s in (("x0", "x", "p.w"), ("y0", "y", "p.h"), ("x1", "(x + r.w)", "p.w"), ("y1", "(y + r.h)", "p.h"))) + " FROM region_ r JOIN page_ p USING (page_id) WHERE rtype IS NOT NULL")
def r11(spark, sf_dir):
    """Boxes of the region instances."""
    layout, sizes = _crowded(spark, sf_dir)
    i = M.converted(layout, "instances", "region", sizes, WIDTH)
    return i.select("page_id", "id", "category_id", *[F.col("bbox")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("r11_baseline_instances", f"WITH {_CROWD} SELECT page_id, CAST(seq AS INT) AS id, CAST(greatest(x0 - 2, 0) AS FLOAT) AS x0, CAST(ft - 2 AS FLOAT) AS y0, CAST(x1 + 2 AS FLOAT) AS x1, CAST(ft + 2 AS FLOAT) AS y1, 1 AS n_outlines FROM a")
def r11_lines(spark, sf_dir):
    """Boxes of the outlines of baselines, a line's cells each by itself."""
    layout, sizes = _crowded(spark, sf_dir)
    i = M.converted(layout, "instances", "baseline", sizes, WIDTH)
    return i.select("page_id", "id", *[F.col("bbox")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))], F.size("segmentation").alias("n_outlines"))


@query("r12_panoptic", f"WITH {_CROWD}, i AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS id FROM a WHERE cls IS NOT NULL), c AS (SELECT page_id, id, y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT page_id, id, x0, x1, unnest(range(y0, y1 + 1)) AS y FROM i)), k AS (SELECT page_id, max(id) AS id FROM c GROUP BY page_id, y, x), n AS (SELECT page_id, id, count(*) AS n FROM k GROUP BY page_id, id) SELECT i.page_id, CAST(i.id AS INT) AS id, CAST(cls - 1 AS INT) AS category_id, coalesce(n, 0) AS n, CAST(i.id % 256 AS INT) AS r, CAST(i.id // 256 % 256 AS INT) AS g, 0 AS b FROM i LEFT JOIN n USING (page_id, id)")
def r12(spark, sf_dir):
    """Panoptic segments with the cells that are left of each, and their colours."""
    layout, sizes = _crowded(spark, sf_dir)
    cells = M.cells_by_value(M.converted(layout, "panoptic", "region", sizes, WIDTH)).select("page_id", F.col("v").alias("id"), "n")
    of = M.converted(layout, "segments", "region", sizes, WIDTH).join(cells, ["page_id", "id"], "left")
    c = G.packed_id(F.col("id"))
    return of.select("page_id", "id", "category_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *[c[k].cast("int").alias(k) for k in ("r", "g", "b")])


@query("r13_yolo_segmentation", f"WITH {_R}, {_P} SELECT r.page_id, CAST(row_number() OVER (PARTITION BY r.page_id ORDER BY {_ORD}) AS INT) AS id, CAST({_CLASS} AS INT) - 1 AS category_id, round(CAST(CAST(x * ((floor(p.w / 10) - 1)::DOUBLE / (p.w - 1)) AS FLOAT) / (floor(p.w / 10) - 1) AS FLOAT), 5) AS x0 FROM region_ r JOIN page_ p USING (page_id) WHERE rtype IS NOT NULL")
def r13(spark, sf_dir):
    layout, sizes = _crowded(spark, sf_dir)
    y = M.converted(layout, "yolo_segmentation", "region", sizes, WIDTH)
    return y.select("page_id", "id", "category_id", F.round(F.col("pts")[0]["x"], 5).alias("x0"))


# --- page XML ---


def _documents(spark, sf_dir):
    """Page XML of ruled pages: regions of two names, their lines with baselines and texts, and a label of confidence on most pages."""
    boxes = _ruled_boxes(spark, sf_dir).withColumn("tag", _tag())
    i = lambda c: F.col(c).cast("int")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    pages = S.page(spark, sf_dir).select("page_id", F.lit(RULED_W).alias("w"), F.lit(RULED_H).alias("h"))
    regions = boxes.select("page_id", "seq", "tag", "rtype", G.rectangle(i("x"), i("y"), i("w"), i("h")).alias("pts"))
    foot = i("y") + i("h") - 1
    lines = boxes.select("page_id", "seq", F.lit(1).alias("line"), G.rectangle(i("x") + 2, i("y") + 2, i("w") - 4, i("h") - 2).alias("pts"), F.array(point(i("x"), foot), point(i("x") + i("w"), foot)).alias("baseline"), F.when(F.col("seq") % 3 != 0, F.concat(F.lit('<&"'), F.col("seq").cast("string"))).alias("text"))
    labels = pages.select("page_id", F.array(F.struct(F.lit("confidence").alias("type"), ((F.col("page_id") % 100) / 100).cast("string").alias("value"))).alias("labels"))
    return pagexml.written(pages, regions, lines, labels)


@query("s13_page_elements", f"WITH {_RULE} SELECT page_id, CASE WHEN rtype = 'marginalia' THEN 'ImageRegion' ELSE 'TextRegion' END AS tag, 'region_' || seq AS region_id, rtype, CAST(seq AS INT) AS reading_order, x0 || ',' || y0 || ' ' || x0 || ',' || y1 || ' ' || x1 || ',' || y1 || ' ' || x1 || ',' || y0 AS points FROM b")
def s13(spark, sf_dir):
    """Regions of any name, written as page XML and read again."""
    r = pagexml.regions_of(pagexml.elements(_documents(spark, sf_dir)))
    return r.select("page_id", "tag", "region_id", "rtype", "reading_order", G.point_text(F.col("pts")).alias("points"))


@query("p10_class_baselines", f"WITH {_RULE} SELECT page_id, cls AS class_id, x0 || ',' || (y1 - 1) || ' ' || x1 || ',' || (y1 - 1) AS points FROM b WHERE cls IS NOT NULL")
def p10(spark, sf_dir):
    """Baselines within regions of known type."""
    b = pagexml.class_baselines(pagexml.elements(_documents(spark, sf_dir)), _classes(spark))
    return b.select("page_id", "class_id", G.point_text(F.col("pts")).alias("points"))


@query("p11_text_lines", f"WITH {_RULE} SELECT page_id, 'line_' || seq || '_1' AS line_id, (x0 + 2) || ',' || (y0 + 2) || ' ' || (x0 + 2) || ',' || y1 || ' ' || (x1 - 2) || ',' || y1 || ' ' || (x1 - 2) || ',' || (y0 + 2) AS points, CASE WHEN seq % 3 <> 0 THEN '<&\"' || seq ELSE '' END AS text FROM b")
def p11(spark, sf_dir):
    """Text lines with their texts (P11, P13)."""
    line = pagexml.lines_of(pagexml.elements(_documents(spark, sf_dir)))
    return line.select("page_id", "line_id", G.point_text(F.col("pts")).alias("points"), "text")


@query("p14_page_transcription", f"WITH {_RULE} SELECT page_id, 'region_' || seq || '_line_' || seq || '_1' AS key, CASE WHEN seq % 3 <> 0 THEN '<&\"' || seq ELSE '' END AS text FROM b WHERE rtype IS DISTINCT FROM 'marginalia'")
def p14(spark, sf_dir):
    return pagexml.transcriptions(pagexml.elements(_documents(spark, sf_dir)))


@query("p15_page_metadata", "SELECT o_orderkey AS page_id, CAST((o_orderkey % 100) / 100.0 AS DOUBLE) AS confidence, 300 AS page_h, 100 AS page_w, o_orderkey || '.jpg' AS image FROM orders")
def p15(spark, sf_dir):
    """Each page's size, picture and labelled confidence, out of its document."""
    of = pagexml.elements(_documents(spark, sf_dir))
    return pagexml.pages_of(of).join(pagexml.confidences(of), "page_id").select("page_id", "confidence", "page_h", "page_w", "image")


@query("e14_page_confidence", "SELECT round(avg((o_orderkey % 100) / 100.0), 6) AS mean, round(stddev_pop((o_orderkey % 100) / 100.0), 6) AS std, count(*) AS n FROM orders")
def e14(spark, sf_dir):
    """Mean and deviation of the confidence that the documents tell; a document without one is an error."""
    c = E.confidence(pagexml.confidences(pagexml.elements(_documents(spark, sf_dir))))
    return c.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("d08_document_states", f"WITH {_R} SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 11 = 0 THEN 'broken' WHEN bool_or(seq IS NOT NULL AND rtype IS NULL) THEN 'untyped' ELSE 'good' END AS state FROM orders LEFT JOIN region_ ON page_id = o_orderkey GROUP BY o_orderkey")
def d08(spark, sf_dir):
    """Documents that cannot be read (each eleventh is cut short), that have regions without a type, and good ones."""
    cut = F.when(F.col("page_id") % 11 == 0, F.substring("xml", 1, 400)).otherwise(F.col("xml"))
    return pagexml.checked(pagexml.elements(_documents(spark, sf_dir).withColumn("xml", cut)))


@query("d16_yolo_layout", "SELECT page_id, part, '/set/images/' || part || '/' || page_id || '.png' AS image_dst, '/set/labels/' || part || '/' || page_id || '.txt' AS label_dst FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'val' ELSE 'train' END AS part FROM pages)")
def d16(spark, sf_dir):
    p = S.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit(".png")).alias("image"), F.when(F.col("page_id") % 5 == 0, "val").otherwise("train").alias("part"))
    return jobs.yolo_layout(p, "/set/")


# --- masks to shapes ---


def _ruled_masks(spark, sf_dir, mode: str):
    return M.converted(_ruled(spark, sf_dir), "sem_seg", mode, None, WIDTH)


@query("v03_contours", f"WITH {_RULE} SELECT page_id, cls AS class_id, (2 * x0) || ',' || (3 * y0) || ' ' || (2 * x0) || ',' || (3 * y1) || ' ' || (2 * x1) || ',' || (3 * y1) || ' ' || (2 * x1) || ',' || (3 * y0) AS points FROM b WHERE cls IS NOT NULL AND (x1 - x0) * (y1 - y0) >= 60")
def v03(spark, sf_dir):
    """Outer borders of the regions of every page's mask, without small ones, scaled to a page twice as wide and thrice as high."""
    m = _ruled_masks(spark, sf_dir, "region").withColumn("page_h", F.lit(3 * RULED_H)).withColumn("page_w", F.lit(2 * RULED_W))
    return X.polygons(m, 60, to=("page_h", "page_w")).select("page_id", "class_id", "points")


@query("v05_mask_components", f"WITH {_RULE} SELECT page_id, cls AS class_id, CAST(x0 AS INT) AS x, CAST(y0 AS INT) AS y, CAST(x1 - x0 + 1 AS INT) AS w, CAST(y1 - y0 + 1 AS INT) AS h, CAST((x1 - x0 + 1) * (y1 - y0 + 1) AS BIGINT) AS area, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy FROM b WHERE cls IS NOT NULL")
def v05(spark, sf_dir):
    """The components of every page's mask with their boxes."""
    return X.components(_ruled_masks(spark, sf_dir, "region")).drop("piece")


_ROUND = "CAST(round_even({0}, 0) AS BIGINT)"


@query("v06_baselines", f"WITH {_RULE} SELECT page_id, (x0 - 2) || ',' || (y1 - 1) || ' ' || (x1 + 2) || ',' || (y1 - 1) AS points, CAST(x0 - 2 AS INT) AS x, CAST(y1 - 1 AS INT) AS y, CAST(x1 - x0 + 5 AS INT) AS w, 1 AS h FROM (SELECT page_id, y1, x0 + CASE WHEN x0 < 2 THEN 2 - x0 ELSE 0 END AS x0, x1 FROM b) WHERE x1 - x0 + 4 >= 15")
def v06(spark, sf_dir):
    """Baselines of the thick lines of every page's mask, and the boxes of their text lines (V04, V06)."""
    return X.baselines(_ruled_masks(spark, sf_dir, "baseline")).select("page_id", "points", "x", "y", "w", "h")


@query("v09_top_bottom", f"WITH {_RULE} SELECT page_id, CAST(sum(2 * (x1 + 2 - greatest(x0 - 2, 0) + 1)) AS BIGINT) AS n FROM b GROUP BY page_id")
def v09(spark, sf_dir):
    """Cells between the tops and bottoms of every page's lines."""
    m = _ruled_masks(spark, sf_dir, "top_bottom")
    return X._each_page(m, lambda cells: [(int(X.middle(cells).sum()),)], "n long").filter("n > 0")


@query("v11_side_baselines", f"WITH {_RULE} SELECT page_id, greatest(x0 - 2, 0) || ',' || {_ROUND.format('y1 - 0.5')} || ' ' || (x1 + 2) || ',' || {_ROUND.format('y1 - 0.5')} AS points FROM b WHERE x1 + 2 - greatest(x0 - 2, 0) >= 15")
def v11(spark, sf_dir):
    """Baselines of every page's tops and bottoms."""
    return X.baselines(_ruled_masks(spark, sf_dir, "top_bottom"), "top_bottom").select("page_id", "points")


@query("v10_orientation", "SELECT o_orderkey AS page_id, CAST([0, 90, 180, 270][o_orderkey % 4 + 1] AS INT) AS angle FROM orders")
def v10(spark, sf_dir):
    """By which angle each page's one line, which runs right, down, left or up, is to be turned so that its top is above."""
    p = S.page(spark, sf_dir).select("page_id", F.lit(60).alias("page_h"), F.lit(60).alias("page_w"))
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    ends = ((at(15, 30), at(45, 30)), (at(30, 15), at(30, 45)), (at(45, 30), at(15, 30)), (at(30, 45), at(30, 15)))
    pts = F.array(*[F.array(*e) for e in ends])[(F.col("page_id") % 4).cast("int")]
    line = p.select("page_id", F.lit(1).alias("place"), pts.alias("pts"))
    none = _ruled(spark, sf_dir)
    layout = M.Layout(p, none.regions, none.lines, line, none.class_baselines, none.classes)
    return X.orientations(M.converted(layout, "sem_seg", "top_bottom", None, WIDTH)).select("page_id", "angle")


@query("v13_generated_pages", f"WITH {_RULE} SELECT page_id, CASE cls WHEN 1 THEN 'heading' WHEN 2 THEN 'marginalia' ELSE 'paragraph' END AS rtype, CASE cls WHEN 2 THEN 'ImageRegion' ELSE 'TextRegion' END AS tag, CAST(x0 * 4 AS INT) AS x0, CAST(y0 * 2 AS INT) AS y0, CAST(x1 * 4 AS INT) AS x1, CAST(y1 * 2 AS INT) AS y1, CAST((page_id % 10) / 10.0 AS DOUBLE) AS confidence FROM b WHERE cls IS NOT NULL AND (x1 - x0) * (y1 - y0) >= 10")
def v13(spark, sf_dir):
    """Pages generated from predicted masks, written as XML and read again: regions at the page's size, and its confidence."""
    masks = _ruled_masks(spark, sf_dir, "region").withColumn("confidence", (F.col("page_id") % 10) / 10)
    pages = S.page(spark, sf_dir).select("page_id", F.lit(4 * RULED_W).alias("w"), F.lit(2 * RULED_H).alias("h"))
    xml = X.generated(masks, pages, "region", NAMES, {"marginalia": "ImageRegion"}, config={"MODEL": "m"}, allowed=("MODEL",), run_id="r")
    of = pagexml.elements(xml)
    b = G.box(F.col("pts"))
    r = pagexml.regions_of(of).join(pagexml.confidences(of), "page_id")
    return r.select("page_id", "rtype", "tag", b.alias("b"), "confidence").select("page_id", "rtype", "tag", *[F.col(f"b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")], "confidence")


@query("v13_generated_lines", f"WITH {_RULE} SELECT page_id, greatest(x0 - 2, 0) * 4 || ',' || (y1 - 1) * 2 || ' ' || (x1 + 2) * 4 || ',' || (y1 - 1) * 2 AS points FROM b WHERE (x1 + 2 - greatest(x0 - 2, 0)) * 4 >= 15")
def v13_lines(spark, sf_dir):
    """Baselines generated from predicted masks, written as XML and read again, at the page's size."""
    pages = S.page(spark, sf_dir).select("page_id", F.lit(4 * RULED_W).alias("w"), F.lit(2 * RULED_H).alias("h"))
    xml = X.generated(_ruled_masks(spark, sf_dir, "baseline"), pages, "baseline", [])
    b = pagexml.baselines_of(pagexml.elements(xml))
    ends = F.array(F.element_at("pts", 1), F.element_at("pts", -1))
    return b.select("page_id", G.point_text(ends).alias("points"))


@query("v15_combined", f"WITH {_RULE}, {_P} SELECT p.page_id, CAST(sum(coalesce(x1 - x0, 0)) AS BIGINT) AS width FROM page_ p LEFT JOIN b ON b.page_id = p.page_id GROUP BY p.page_id")
def v15(spark, sf_dir):
    """Three masks of each page as one picture: a line's end less its start, in columns, by the mean place of the discs' cells."""
    import numpy as np
    import pandas as pd

    layout = _ruled(spark, sf_dir)
    wide = M.Layout(layout.pages.withColumn("page_w", F.lit(RULED_W + 20)), *(getattr(layout, k) for k in ("regions", "lines")), layout.baselines.withColumn("pts", G.shifted(F.col("pts"), F.lit(8), F.lit(8))), layout.class_baselines, layout.classes)
    wide.pages = wide.pages.withColumn("page_h", F.lit(RULED_H + 20))
    c = X.combined(*(M.converted(wide, "sem_seg", m, None, 2) for m in ("end", "start", "baseline")))

    def run(batches):
        for b in batches:
            rows = []
            for k, h, w, data in zip(b["page_id"], b["h"], b["w"], b["data"]):
                a = np.frombuffer(data, np.uint8).reshape(h, w, 3) > 0
                # a disc of radius 2 has 13 cells
                rows.append((k, int(round((np.nonzero(a[..., 0])[1].sum() - np.nonzero(a[..., 1])[1].sum()) / 13))))
            yield pd.DataFrame(rows, columns=["page_id", "width"])

    return c.mapInPandas(run, "page_id long, width long")


_Z = "z AS (SELECT vec_id, embedding AS e FROM embeddings), c AS (SELECT vec_id, k, [CAST(e[k] AS DOUBLE), e[16 + k], e[32 + k], e[48 + k]] AS v FROM (SELECT *, unnest(range(1, 17)) AS k FROM z)), p AS (SELECT vec_id, list_position(v, list_max(v)) - 1 AS cls, (1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) - 0.25) / 0.75 AS confidence FROM c)"


@query("v01_classified_masks", f"WITH {_Z} SELECT vec_id AS page_id, CAST(cls AS INT) AS v, count(*) AS n FROM p WHERE cls > 0 GROUP BY vec_id, cls")
def v01(spark, sf_dir):
    """Every vector as 4 x 4 cells of four classes: cells of each class but the background."""
    return M.cells_by_value(X.classified(_logits(spark, sf_dir)))


@query("v02_mask_confidence", f"WITH {_Z} SELECT vec_id AS page_id, round(avg(confidence), 6) AS confidence FROM p GROUP BY vec_id")
def v02(spark, sf_dir):
    """The mean confidence of every vector's cells; enlarging does not change it."""
    big = _logits(spark, sf_dir).withColumn("to_h", F.lit(9)).withColumn("to_w", F.lit(11))
    return X.classified(big, ("to_h", "to_w")).select("page_id", F.round("confidence", 6).alias("confidence"))


def _logits(spark, sf_dir):
    return S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.lit(4).alias("n"), F.lit(4).alias("h"), F.lit(4).alias("w"), F.col("embedding").alias("z"))


# --- comparisons ---

_N = 3  # the border's width on ruled pages: RATIO of the diagonal, rounded


def _both(spark, sf_dir):
    """Masks of ruled pages, predicted (one cell off, and headings taken for paragraphs on every third page) and true."""
    truth = _ruled(spark, sf_dir)
    boxes = _ruled_boxes(spark, sf_dir).withColumn("x", F.col("x") + 1).withColumn("y", F.col("y") + 1)
    boxes = boxes.withColumn("rtype", F.when((F.col("rtype") == "heading") & (F.col("page_id") % 3 == 0), "paragraph").otherwise(F.col("rtype")))
    return _layout(spark, truth.pages, boxes), truth


_PAIR = f"{_RULE}, q AS (SELECT *, CASE WHEN cls = 1 AND page_id % 3 = 0 THEN 3 ELSE cls END AS pc FROM b WHERE cls IS NOT NULL)"
_AREA = "greatest(0, ({x1}) - ({x0}) + 1) * greatest(0, ({y1}) - ({y0}) + 1)"


def _overlap(a: int, b: int) -> str:
    """Cells that a true box and its prediction share, each less so many cells all around."""
    return _AREA.format(x0=f"greatest(x0 + {a}, x0 + 1 + {b})", x1=f"least(x1 - {a}, x1 + 1 - {b})", y0=f"greatest(y0 + {a}, y0 + 1 + {b})", y1=f"least(y1 - {a}, y1 + 1 - {b})") + f" * CASE WHEN x1 - x0 >= {2 * max(a, b)} AND y1 - y0 >= {2 * max(a, b)} THEN 1 ELSE 0 END"


_FULL = _AREA.format(x0="x0", x1="x1", y0="y0", y1="y1")
_INNER = _AREA.format(x0=f"x0 + {_N}", x1=f"x1 - {_N}", y0=f"y0 + {_N}", y1=f"y1 - {_N}")
_M = f"{_PAIR}, met AS (SELECT pc AS pred, cls AS gt, CAST(sum({_overlap(0, 0)}) AS BIGINT) AS n FROM q GROUP BY ALL), m AS (SELECT pred, gt, n FROM met UNION ALL SELECT pc, 0, CAST(sum({_FULL} - ({_overlap(0, 0)})) AS BIGINT) FROM q GROUP BY pc UNION ALL SELECT 0, cls, CAST(sum({_FULL} - ({_overlap(0, 0)})) AS BIGINT) FROM q GROUP BY cls UNION ALL SELECT 0, 0, (SELECT count(*) * {RULED_H * RULED_W} FROM orders) - (SELECT CAST(sum(2 * ({_FULL}) - ({_overlap(0, 0)})) AS BIGINT) FROM q))"
_EDGE = f"(({_overlap(0, 0)}) - ({_overlap(_N, 0)}) - ({_overlap(0, _N)}) + ({_overlap(_N, _N)}))"
_RIM = f"(({_FULL}) - ({_INNER}))"


@query("e12_mask_confusion", f"WITH {_M} SELECT CAST(pred AS INT) AS pred, CAST(gt AS INT) AS gt, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY pred, gt")
def e12_matrix(spark, sf_dir):
    """The confusion of all cells of all pages."""
    pred, truth = (M.converted(x, "sem_seg", "region", None, WIDTH) for x in _both(spark, sf_dir))
    return E.confusion(E.mask_confusion(pred, truth, 4))


_S = "s AS (SELECT c AS cls, coalesce(sum(n) FILTER (gt = c AND pred = c), 0) AS tp, coalesce(sum(n) FILTER (gt = c), 0) AS pos_gt, coalesce(sum(n) FILTER (pred = c), 0) AS pos_pred FROM (SELECT unnest([0, 1, 2, 3]) AS c), m GROUP BY c), k AS (SELECT cls, pos_gt, CASE WHEN pos_gt > 0 THEN 100.0::DOUBLE * tp / pos_gt END AS acc, CASE WHEN pos_gt > 0 THEN 100.0::DOUBLE * tp / (pos_gt + pos_pred - tp) END AS iou FROM s)"


@query("e12_xml_comparison", f"WITH {_M}, {_S} SELECT CAST(cls AS INT) AS cls, round(acc, 6) AS acc, round(iou, 6) AS iou, round((SELECT avg(iou) FROM k), 6) AS miou FROM k")
def e12(spark, sf_dir):
    """Two sets of page XML documents, converted to masks of regions and compared from end to end."""
    pred, truth = _both(spark, sf_dir)
    to = [pagexml.written(x.pages.select("page_id", F.col("page_h").alias("h"), F.col("page_w").alias("w")), x.regions.select("page_id", F.col("place").alias("seq"), "tag", "rtype", "pts")) for x in (pred, truth)]
    got = E.compared_pages(*to, _classes(spark), "region", WIDTH, 4)
    return got.select("cls", *[F.round(c, 6).alias(c) for c in ("acc", "iou", "miou")])


@query("e08_border_iou", f"WITH {_PAIR}, t AS (SELECT c AS cls, coalesce(sum({_EDGE}) FILTER (cls = c AND pc = c), 0) AS tp, coalesce(sum({_RIM}) FILTER (cls = c), 0) AS pos_gt, coalesce(sum({_RIM}) FILTER (pc = c), 0) AS pos_pred FROM (SELECT unnest([1, 2, 3]) AS c), q GROUP BY c) SELECT CAST(cls AS INT) AS cls, round(CASE WHEN pos_gt + pos_pred - tp > 0 THEN 100.0::DOUBLE * tp / (pos_gt + pos_pred - tp) END, 6) AS border_iou FROM t")
def e08(spark, sf_dir):
    """Intersection over union of the borders of each class."""
    pred, truth = (M.converted(x, "sem_seg", "region", None, WIDTH) for x in _both(spark, sf_dir))
    matrix = E.confusion(E.mask_confusion(pred, truth, 4, ratio=RATIO))
    return E.border_scores(E.support(matrix, 4)).filter("cls > 0").select("cls", F.round("border_iou", 6).alias("border_iou"))


@query("e07_boundary", f"WITH {_RULE} SELECT page_id, cls AS v, CAST(sum({_RIM}) AS BIGINT) AS n FROM b WHERE cls IS NOT NULL GROUP BY page_id, cls")
def e07(spark, sf_dir):
    """Cells of the borders of every page's regions, by class."""
    import numpy as np

    def kernel(cells):
        n = np.bincount(E.border(cells, RATIO).ravel())
        return [(v, int(n[v])) for v in np.flatnonzero(n[1:]) + 1]

    return X._each_page(_ruled_masks(spark, sf_dir, "region"), kernel, "v int, n long")


@query("e09_min_iou", f"WITH {_M}, {_S}, t AS (SELECT c AS cls, coalesce(sum({_EDGE}) FILTER (cls = c AND pc = c), 0) AS tp, coalesce(sum({_RIM}) FILTER (cls = c), 0) AS pos_gt, coalesce(sum({_RIM}) FILTER (pc = c), 0) AS pos_pred FROM (SELECT unnest([1, 2, 3]) AS c), q GROUP BY c) SELECT CAST(k.cls AS INT) AS cls, round(least(iou, CASE WHEN t.pos_gt + t.pos_pred - t.tp > 0 THEN 100.0::DOUBLE * t.tp / (t.pos_gt + t.pos_pred - t.tp) END), 6) AS least_iou FROM k JOIN t ON t.cls = k.cls")
def e09(spark, sf_dir):
    """The lesser of each class's two intersections over union (E09, E17)."""
    pred, truth = (M.converted(x, "sem_seg", "region", None, WIDTH) for x in _both(spark, sf_dir))
    return E.compared(pred, truth, 4, ratio=RATIO).filter("cls > 0").select("cls", F.round("least_iou", 6).alias("least_iou"))


@query("e10_multilabel", "WITH p AS (SELECT vec_id, label, unnest(range(10)) AS plane, embedding FROM embeddings) SELECT CAST(plane AS INT) AS plane, CASE WHEN embedding[plane + 1] > 0 THEN 1 ELSE 0 END AS pred, CASE WHEN label = plane THEN 1 ELSE 0 END AS gt, count(*) AS n FROM p GROUP BY ALL")
def e10(spark, sf_dir):
    """Per plane, whether the sigmoid of its logit is over one half against whether it is the label."""
    of = E.above_half(S.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("z")), 10)
    return E.confusion(of.select("plane", "pred", (F.col("label") == F.col("plane")).cast("int").alias("gt")), "plane")


@query("e11_ordered_pairs", "SELECT '/a/' || page_id || '.png' AS \"left\", '/b/page/' || page_id || '.xml' AS \"right\" FROM pages")
def e11(spark, sf_dir):
    """Two sets of paths, paired by stem; one without a partner would be an error."""
    name = lambda a, z: S.table(spark, sf_dir, "pages").select(F.concat(F.lit(a), F.col("page_id").cast("string"), F.lit(z)).alias("path"))
    return E.in_order(name("/a/", ".png"), name("/b/page/", ".xml"), "path")


@query("e13_printed", "SELECT event_type, printf('%.2f', avg(value)) AS mean FROM events GROUP BY event_type")
def e13(spark, sf_dir):
    return E.printed(S.table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean")), 2)
