"""Properties and edge cases of the layout operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import pagetext as T
from quirefold.operators import datasets, evaluate, model, taxonomy
from quirefold.sources import pagexml, paths, rasters
from quirefold.streaming import ledger


def one(spark, *cols):
    return spark.range(1).select(*cols).head()


def test_points_round_trip(spark):
    text = "1,2 -3,4 50,60"
    assert one(spark, G.point_text(G.points(F.lit(text))).alias("t")).t == text


def test_points_round_half_to_even(spark):
    pts = F.array(F.struct(F.lit(0.5).alias("x"), F.lit(1.5).alias("y")), F.struct(F.lit(2.5).alias("x"), F.lit(-2.5).alias("y")))
    assert one(spark, G.point_text(pts).alias("t")).t == "0,2 2,-2"


def test_flips_and_turns_undo(spark):
    p = G.points(F.lit("1,2 30,40"))
    h, w = F.lit(100), F.lit(200)
    twice = G.turned(G.turned(p, F.lit(2), h, w), F.lit(2), h, w)
    there = G.turned(G.turned(p, F.lit(1), h, w), F.lit(3), w, h)
    for got in (G.flipped_x(G.flipped_x(p, w), w), G.flipped_y(G.flipped_y(p, h), h), twice, there, G.shifted(G.shifted(p, F.lit(7), F.lit(9)), F.lit(-7), F.lit(-9))):
        assert one(spark, G.point_text(got).alias("t")).t == "1,2 30,40"


def test_longest_edge_keeps_the_ratio(spark):
    h, w = G.size_by_edge(F.lit(100), F.lit(200), 50, True)
    assert tuple(one(spark, h.alias("h"), w.alias("w"))) == (25, 50)


def test_greedy_type(spark):
    texts = {"structure {type:a;foo:b;}": "a;foo:b", "readingOrder {index:3;} structure {type:x;}": "x", "none": None}
    for text, want in texts.items():
        assert one(spark, T.region_type(F.lit(text)).alias("t")).t == want
    assert one(spark, T.reading_order(F.lit("readingOrder {index:3;}")).alias("t")).t == 3


def test_scores_of_equal_masks_are_full(spark):
    pairs = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "pred int, gt int")
    t = evaluate.totals(evaluate.class_scores(evaluate.support(evaluate.confusion(pairs), 3))).head()
    assert tuple(t) == (100.0, 100.0, 100.0, 100.0)


def test_iou_is_symmetric(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0), (1, 1)], "pred int, gt int")
    iou = lambda d: sorted(r.iou for r in evaluate.class_scores(evaluate.support(evaluate.confusion(d), 2)).collect())
    assert iou(pairs) == iou(pairs.select(F.col("gt").alias("pred"), F.col("pred").alias("gt")))


def test_empty_matrix_scores_null(spark):
    pairs = spark.createDataFrame([], "pred int, gt int")
    assert [r.iou for r in evaluate.class_scores(evaluate.support(evaluate.confusion(pairs), 2)).collect()] == [None, None]


def test_best_row_is_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 7.0), (4, None)], "place long, m double")
    assert evaluate.best_row(rows, "m", "place").head().place == 2
    assert evaluate.best_row(rows, "m", "place", highest=False).head().place == 1


def test_merge_spec_is_checked():
    with pytest.raises(ValueError):
        taxonomy.checked([("a", "b")], ["c"])
    with pytest.raises(ValueError):
        taxonomy.checked([("a", "b"), ("b", "c")], ["a", "b"])
    with pytest.raises(ValueError):
        taxonomy.checked([("a", "b"), ("c", "b")], ["a", "c"])
    assert taxonomy.parsed_merges("a:b,c d:e") == [("a", "b"), ("a", "c"), ("d", "e")]


def test_two_classes_are_black_and_white(spark):
    ids = spark.createDataFrame([("background", 0), ("x", 1)], "name string, class_id int")
    assert [(r.r, r.g, r.b) for r in taxonomy.coloured(ids).orderBy("class_id").collect()] == [(0, 0, 0), (255, 255, 255)]


@pytest.mark.parametrize("n", [1, 7, 100])
def test_split_parts_are_exact_and_disjoint(spark, n):
    got = datasets.split(spark.range(n), "id", {"a": 8, "b": 1, "c": 1}).groupBy("part").count().collect()
    want = dict(zip("abc", [b - a for a, b in zip([0, *[x for _, x in datasets.bounds(n, {"a": 8, "b": 1, "c": 1})]], [x for _, x in datasets.bounds(n, {"a": 8, "b": 1, "c": 1})])]))
    assert {r.part: r["count"] for r in got} == {k: v for k, v in want.items() if v}


def test_pages_are_written_and_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, 100, 200)], "page_id long, w long, h long")
    regions = spark.createDataFrame([(1, 1, "a<b\"&", "1,2 3,4 5,6"), (1, 2, None, "7,8 9,10 11,12")], "page_id long, seq long, rtype string, p string").withColumn("pts", G.points(F.col("p")))
    pagexml.write(pagexml.written(pages, regions), str(tmp_path / "page"))
    got = pagexml.regions_of(pagexml.elements(pagexml.read(spark, str(tmp_path / "page")))).orderBy("reading_order").collect()
    assert [(r.page_w, r.page_h, r.rtype, r.reading_order, len(r.pts)) for r in got] == [(100, 200, 'a<b"&', 1, 3), (100, 200, None, 2, 3)]
    found = pagexml.points_anywhere(pagexml.read(spark, str(tmp_path / "page")), "xml", "Coords")
    assert sorted(r.points for r in found.collect()) == ["1,2 3,4 5,6", "7,8 9,10 11,12"]


def test_images(spark, tmp_path):
    (tmp_path / "a.ppm").write_bytes(b"P6 2 1 255\n" + bytes(range(6)))
    (tmp_path / "b.pgm").write_bytes(b"broken")
    got = {r.path.rsplit("/")[-1]: (r.h, r.w, r.c) for r in rasters.images(spark, str(tmp_path)).collect()}
    assert got == {"a.ppm": (1, 2, 3), "b.pgm": (None, None, None)}
    assert [r.stem for r in paths.listing(spark, str(tmp_path), [".PPM"]).collect()] == ["a"]


def test_unknown_config_key_is_an_error(spark):
    with pytest.raises(KeyError):
        model.processing_step(spark.range(1), {"a": "1"}, ["b"], F.lit(0.5))
    assert model.processing_step(spark.range(1), {"a": "1", "c": "2"}, ["a"], F.lit(0.5)).head().step.config == {"a": "1"}


def test_open_requests_last_until_now(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    r = spark.createDataFrame([(1, t(0), None, None)], "event_id long, queued_at timestamp_ntz, process_start timestamp_ntz, process_end timestamp_ntz")
    got = ledger.durations(r, F.lit(t(2)).cast("timestamp_ntz")).head()
    assert (got.queue_s, got.process_s, got.total_s) == (120.0, None, 120.0)


def test_windowed_stream(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(t(0), "ok"), (t(1), "error"), (t(10), "ok")], "queued_at timestamp, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("queued_at timestamp, status string").parquet(str(tmp_path / "in"))
    q = ledger.windowed(stream, "5 minutes", "1 minute").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.n, r.n_error) for r in spark.table("w").collect()) == [(1, 0), (2, 1)]


def test_tracked_stream_moves_forward_only(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("a", "queued", t(0)), ("a", "processing", t(1)), ("a", "queued", t(2)), ("a", "finished", t(3)), ("a", "error", t(4))]
    spark.createDataFrame(rows, "identifier string, status string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("identifier string, status string, at timestamp").parquet(str(tmp_path / "in"))
    q = ledger.tracked(stream).writeStream.format("memory").queryName("s").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.identifier, r.status, r.n_changes) for r in spark.table("s").collect()] == [("a", "finished", 3)]
