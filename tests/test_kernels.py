"""Kernels on masks: the golden polygons, and brute force."""

import numpy as np
import pytest

from quirefold.operators import extract, masks, raster, vectorize


def polygons(classes, least=10, boxed=(), size=100):
    h, w = classes.shape
    return [(c, " ".join(f"{x},{y}" for x, y in p)) for c, p in vectorize.mask_polygons(classes, least, frozenset(boxed), (size / w, size / h))]


def columns(*limits):
    """A 10 x 10 mask: class k + 1 from column limits[k] on."""
    return np.tile(sum((np.arange(10) >= a).astype(int) for a in limits), (10, 1))


HEXAGON = np.array([[2 <= y <= 6 and {2: (4, 5), 3: (3, 6), 4: (2, 7), 5: (3, 6), 6: (4, 5)}[y][0] <= x <= {2: (4, 5), 3: (3, 6), 4: (2, 7), 5: (3, 6), 6: (4, 5)}[y][1] for x in range(10)] for y in range(10)]).astype(int)


def test_one_type():
    assert polygons(columns(5)) == [(1, "50,0 50,90 90,90 90,0")]


def test_two_types():
    assert polygons(columns(2, 5)) == [(1, "20,0 20,90 40,90 40,0"), (2, "50,0 50,90 90,90 90,0")]


def test_hexagon():
    assert polygons(HEXAGON) == [(1, "40,20 20,40 40,60 50,60 70,40 50,20")]


def test_rectangle_has_four_whole_points():
    (_, text), = polygons(HEXAGON, boxed=[1])
    assert text.count(",") == 4 and "." not in text


def test_only_boxed_class_is_rectangle():
    both = np.zeros((20, 10), int)
    both[:10], both[10:] = HEXAGON, HEXAGON * 2
    got = dict(polygons(both, boxed=[1]))
    assert got[1].count(",") == 4 and got[2].count(",") == 6


def test_too_small():
    small = np.zeros((10, 10), int)
    small[:2, :2] = 1
    assert polygons(small) == []


def flooded(mask):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                out[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out, n


@pytest.mark.parametrize("seed", range(20))
def test_components(seed):
    mask = np.random.default_rng(seed).random((15, 17)) < 0.3 + 0.02 * seed
    got, n = vectorize.labelled(mask)
    want, m = flooded(mask)
    assert n == m and (got == want).all()


@pytest.mark.parametrize("seed", range(10))
def test_outline_surrounds(seed):
    mask = np.random.default_rng(seed).random((12, 12)) < 0.6
    labels, n = vectorize.labelled(mask)
    for k in range(1, n + 1):
        one = labels == k
        ring = vectorize.outline(one)
        y, x = np.nonzero(one)
        assert ring[:, 0].min() == x.min() and ring[:, 0].max() == x.max() and ring[:, 1].min() == y.min() and ring[:, 1].max() == y.max()
        assert one[ring[:, 1], ring[:, 0]].all()


def test_least_rectangle_of_turned_square():
    c = vectorize.least_rectangle(np.array([[0, 2], [2, 0], [4, 2], [2, 4]]))
    assert vectorize.ring_area(c) == pytest.approx(8)


def test_simplified_keeps_ends_and_corners():
    line = np.array([[0, 0], [1, 0.1], [2, 0], [3, 5], [4, 0]])
    assert vectorize.simplified(line, 1, False).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]


def test_polygon_runs_of_triangle():
    runs = raster.polygon_runs(np.array([0.0, 4, 0]), np.array([0.0, 4, 4]))
    assert [(y, a) for y, a, _ in runs] == [(y, 0) for y in range(5)]
    assert [b for _, _, b in runs] == sorted(b for _, _, b in runs) and runs[-1][2] == 4


@pytest.mark.parametrize("seed", range(5))
def test_stroke_against_distance(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 30, 4).astype(float), rng.integers(0, 30, 4).astype(float)
    x, y = x + 5, y + 5  # nothing is cut off by the edge
    top, left, covered, _ = masks.stroke(np.stack([x, y], axis=1), 5, 60, 60)
    got = {(int(a) + left, int(b) + top) for b, a in np.argwhere(covered)}
    for a in range(0, 41):
        for b in range(0, 41):
            d = min(np.hypot(a - (x[k] + t * (x[k + 1] - x[k])), b - (y[k] + t * (y[k + 1] - y[k]))) for k in range(3) for t in [np.clip(((a - x[k]) * (x[k + 1] - x[k]) + (b - y[k]) * (y[k + 1] - y[k])) / max((x[k + 1] - x[k]) ** 2 + (y[k + 1] - y[k]) ** 2, 1e-12), 0, 1)])
            if abs(d - 2.5) > 1e-6:
                assert ((a, b) in got) == (d < 2.5)


@pytest.mark.parametrize("seed", range(3))
def test_runs_and_cells_are_the_same(seed):
    rng = np.random.default_rng(seed)
    mask = rng.integers(0, 4, (17, 23)) * (rng.random((17, 23)) < 0.5)
    runs = masks.runs_of(mask)
    assert (masks.dense(runs, 17, 23) == mask).all()
    assert all((mask[y, a : b + 1] == v).all() and (a == 0 or mask[y, a - 1] != v) and (b == 22 or mask[y, b + 1] != v) for y, a, b, v in runs)


def test_square_ends_of_a_line():
    round_one = masks.stroke(np.array([[10, 10], [30, 10]]), 5, 40, 60)[2].sum()
    y, x, cells, above = masks.stroke(np.array([[10, 10], [30, 10]]), 5, 40, 60, square=True)
    assert cells.sum() == 5 * 19 and round_one > 5 * 21 - 1
    assert (above[cells].sum(), (~above)[cells].sum()) == (3 * 19, 2 * 19)


@pytest.mark.parametrize("seed", range(6))
def test_boxes_hang_together_as_all_pairs_do(seed):
    rng = np.random.default_rng(seed)
    boxes = [(k, *(int(v) for v in (rng.integers(0, 60), rng.integers(0, 60), rng.integers(0, 12), rng.integers(0, 12)))) for k in range(60)]
    boxes += [(100 + k, 5, 5, 10 + k % 3, 10 + k % 2) for k in range(40)]
    root = {b[0]: b[0] for b in boxes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, (a, ax, ay, aw, ah) in enumerate(boxes):
        for b, bx, by, bw, bh in boxes[:i]:
            if min(aw, ah, bw, bh) > 0 and ax <= bx + bw and bx <= ax + aw and ay <= by + bh and by <= ay + ah:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert vectorize.hanging_together(boxes) == {v: find(v) for v in root}


def test_piled_boxes_are_compared_once():
    import time

    began = time.perf_counter()
    got = vectorize.hanging_together([(k, 3, 4, 50, 60) for k in range(100_000)])
    assert set(got.values()) == {0} and time.perf_counter() - began < 10


@pytest.mark.parametrize("h, w", [(3, 4), (7, 5), (12, 16)])
def test_enlarged_probabilities(h, w):
    """Bilinear weights, cell by cell."""
    rng = np.random.default_rng(1)
    z = rng.normal(size=(3, 3, 4)) * 3
    p = np.exp(z) / np.exp(z).sum(axis=0)
    want = np.zeros((h, w), int)
    for i in range(h):
        for j in range(w):
            y, x = min(max((i + 0.5) * 3 / h - 0.5, 0), 2), min(max((j + 0.5) * 4 / w - 0.5, 0), 3)
            a, b = int(y), int(x)
            c, d = min(a + 1, 2), min(b + 1, 3)
            v = (p[:, a, b] * (1 - (x - b)) + p[:, a, d] * (x - b)) * (1 - (y - a)) + (p[:, c, b] * (1 - (x - b)) + p[:, c, d] * (x - b)) * (y - a)
            want[i, j] = v.argmax()
    got, confidence = extract.classes_and_confidence(z, h, w)
    assert (got == want).all() and confidence == pytest.approx(((p.max(axis=0) - 1 / 3) / (2 / 3)).mean())


def test_merged_lines_are_told():
    cells = np.zeros((9, 40), bool)
    cells[1:3], cells[6:8], cells[:, :3] = True, True, True
    (line, merged), = extract.line_baselines(cells, 15, 50)
    assert merged and len(line) >= 2
    (line, merged), = extract.line_baselines(cells[:4], 15, 50)
    assert not merged and line[-1].tolist() == [39, 1.5]
    assert list(extract.line_baselines(cells[:4, :10], 15, 50)) == []


def test_no_baselines_of_other_modes():
    with pytest.raises(NotImplementedError):
        list(extract.page_baselines(np.zeros((2, 2), int), "region"))


@pytest.mark.parametrize("box", [[(3, 4), (3, 9), (12, 9), (12, 4)], [(-5, -2), (6, -2), (6, 3), (-5, 3)], [(15, 15), (15, 30), (40, 30), (40, 15)], [(-9, -9), (-9, -3), (-2, -3), (-2, -9)]])
def test_upright_boxes_are_filled_as_polygons_are(box):
    one, two = np.zeros((20, 25), np.int32), np.zeros((20, 25), np.int32)
    pts = np.array(box)
    masks.paint(one, "fill", 0, 1, pts)
    for y, a, b in raster.polygon_runs(pts[:, 0].astype(float), pts[:, 1].astype(float)):
        if 0 <= y < 20 and b >= 0:
            two[y, max(a, 0) : b + 1] = 1
    assert (one == two).all()


@pytest.mark.parametrize("seed", range(8))
def test_lines_and_discs_are_drawn_alike_at_any_place(seed):
    rng = np.random.default_rng(seed)
    h, w = 40, 60
    for _ in range(40):
        pts, size, square = rng.integers(-25, 70, (rng.integers(2, 5), 2)), float(rng.integers(1, 9)), bool(rng.integers(2))
        kind = ["stroke", "sides"][rng.integers(2)]
        got, want = np.zeros((h, w), np.int32), np.zeros((h, w), np.int32)
        masks.paint(got, kind, size, 1, pts, square)
        y, x, covered, above = masks.stroke(pts, size, h, w, square)
        part = want[y : y + covered.shape[0], x : x + covered.shape[1]]
        part[covered] = np.where(above, masks.TOP, masks.BOTTOM)[covered] if kind == "sides" else 1
        assert (got == want).all()
        cy, cx, r = int(pts[0][1]), int(pts[0][0]), int(size)
        yy, xx = np.mgrid[:h, :w]
        got[:] = 0
        masks.paint(got, "disc", size, 1, pts)
        assert (got == ((yy - cy) ** 2 + (xx - cx) ** 2 <= r * r)).all()


@pytest.mark.parametrize("mode", ["baseline_separator", "separator"])
def test_a_baseline_with_its_ends_is_one_row(spark, mode):
    """Masks are not joined after they are painted, and what makes a mask has a row a baseline and page at most."""
    from pyspark.sql import functions as F

    point = "array<struct<x:int,y:int>>"
    lines = [(1, 1, [(3, 8), (30, 8)]), (1, 2, [(25, 9), (38, 14)]), (2, 1, [(-4, 1), (60, 1)]), (2, 2, None)]
    baselines = spark.createDataFrame(lines, f"page_id long, place int, pts {point}")
    pages = spark.createDataFrame([(1, 20, 40), (2, 20, 40), (3, 20, 40), (3, 20, 40)], "page_id long, page_h int, page_w int")
    layout = masks.Layout(pages.distinct(), baselines, baselines, baselines, baselines, None)
    assert masks.TOGETHER[mode](layout, None, 5).count() == 4
    whole = masks.converted(layout, "sem_seg", mode)
    above = whole._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "Join" not in above
    got = {r.page_id: r for r in whole.collect()}
    want = {r.page_id: r for r in masks.painted(masks.MODES[mode](layout, None, 5)).collect()}
    assert set(got) == {1, 2, 3} and got[3].empty and (got[3].h, got[3].w) == (20, 40)
    assert all(got[k] == want[k] for k in want)
    # a page that is named twice keeps both rows, and one without a name its own
    again = masks.painted(masks.TOGETHER[mode](layout, None, 5), pages=pages.union(pages.filter("page_id = 2")).union(pages.limit(1).withColumn("page_id", F.lit(None).cast("long"))).withColumnsRenamed({"page_h": "h", "page_w": "w"}))
    assert sorted((r.page_id or 0) for r in again.collect()) == [0, 1, 2, 2, 3, 3]


def test_box_of_a_line_at_the_upper_edge_stays_on_the_mask(spark):
    lines = spark.createDataFrame([(1, 1, [(5, 1), (20, 1)])], "page_id long, place int, pts array<struct<x:int,y:int>>")
    layout = masks.Layout(spark.createDataFrame([(1, 30, 40)], "page_id long, page_h int, page_w int"), lines, lines, lines, lines, None)
    (row,) = masks.converted(layout, "instances", "baseline").collect()
    assert row.bbox == [3, 0, 22, 3] and len(row.segmentation) == 1
