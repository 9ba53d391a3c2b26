"""Files, paths, preparation jobs, configuration of runs, and samples under transforms."""

import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.operators import augment, evaluate, inference, jobs, masks, pixels, taxonomy
from quirefold.plans import config
from quirefold.sources import pagexml, paths, rasters
from quirefold.streaming import ledger

RNG = np.random.default_rng(0)
IMAGE = RNG.integers(0, 256, (12, 15, 3)).astype(np.uint8)


@pytest.mark.parametrize("suffix, channels", [(".png", 1), (".png", 3), (".png", 4), (".ppm", 3), (".pgm", 1), (".npy", 3)])
def test_pictures_are_written_and_read(suffix, channels):
    a = RNG.integers(0, 256, (7, 9, channels)).astype(np.uint8)
    content = rasters.encoded(a, suffix, dpi=300)
    got, dpi = rasters.decoded(content)
    assert (got == a).all() and dpi == (300 if suffix == ".png" else None)
    assert rasters.header(content)[:2] == (7, 9)
    for cut in (0, 5, 20, len(content) // 2):
        assert rasters.decoded(content[:cut]) is None or suffix != ".png"


@pytest.mark.parametrize("how", range(5))
def test_filtered_rows_of_a_png(how):
    """Each filter of the format, applied here by its definition."""
    import struct
    import zlib

    a = RNG.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    flat, rows = a.reshape(6, 15).astype(int), []
    for y in range(6):
        line = []
        for i in range(15):
            left, up, corner = (flat[y, i - 3] if i >= 3 else 0), (flat[y - 1, i] if y else 0), (flat[y - 1, i - 3] if y and i >= 3 else 0)
            p = left + up - corner
            best = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            line.append((flat[y, i] - (0, left, up, (left + up) // 2, best)[how]) % 256)
        rows.append(bytes([how, *line]))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (rasters.decoded(png)[0] == a).all()


def test_orientation_and_resolution():
    import struct

    a = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    seen = {k: rasters.upright(a, k)[..., 0].tolist() for k in range(1, 9)}
    assert seen[1] == [[0, 1, 2], [3, 4, 5]] and seen[3] == [[5, 4, 3], [2, 1, 0]] and seen[6] == [[3, 0], [4, 1], [5, 2]] and seen[8] == [[2, 5], [1, 4], [0, 3]]
    content = rasters.encoded(a, ".png", 200)
    odd = content.replace(struct.pack(">IIB", 7874, 7874, 1), struct.pack(">IIB", 7874, 7000, 1))
    with pytest.raises(ValueError, match="square"):
        rasters.header(odd)
    assert rasters.decoded(odd) is None
    with pytest.raises(ValueError):
        rasters.encoded(a.astype(float), ".png")
    with pytest.raises(ValueError):
        rasters.encoded(a.astype(int) * 300, ".png")


def test_colour_spaces():
    assert (rasters.coloured(IMAGE, "BGR")[..., ::-1] == IMAGE).all()
    assert (np.abs(rasters.from_yuv(rasters.coloured(IMAGE, "YUV")).astype(int) - IMAGE) <= 1).all()
    assert (rasters.coloured(IMAGE, "L") == pixels.luminance(IMAGE)[..., :1]).all()
    assert rasters.coloured(IMAGE[..., :1], "RGB").shape == (12, 15, 3)


def test_pictures_as_tables(spark, tmp_path):
    of = spark.createDataFrame([("a", 12, 15, 3, bytearray(IMAGE.tobytes())), ("none", None, None, None, None)], "name string, h int, w int, c int, data binary")
    rasters.write(rasters.encoded_rows(of, "name", ".png"), str(tmp_path / "out"), "name", ".png")
    (tmp_path / "out" / "b.ppm").write_bytes(b"broken")
    got = {r.path.rsplit("/")[-1]: r for r in rasters.images(spark, str(tmp_path / "out")).collect()}
    assert bytes(got["a.png"].data) == IMAGE.tobytes() and got["b.ppm"].data is None and len(got) == 2
    heads = {r.path.rsplit("/")[-1]: (r.h, r.w) for r in rasters.headers(spark, str(tmp_path / "out")).collect()}
    assert heads == {"a.png": (12, 15), "b.ppm": (None, None)}


def test_paths(spark, tmp_path):
    for name in ("a10.png", "a9.PNG", "x.txt", "deep/c.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    (tmp_path / "list.txt").write_text("deep\na9.PNG\nmore.txt\n")
    (tmp_path / "more.txt").write_text("a10.png\n")
    names = lambda *p: [r.path.rsplit("/")[-1] for r in paths.scanned(spark, *p).collect()]
    assert names(str(tmp_path), [".png"]) == ["a9.PNG", "a10.png"]
    assert names([tmp_path / "list.txt"], [".png"]) == ["a9.PNG", "a10.png", "c.png"]
    with pytest.raises(FileNotFoundError):
        paths.scanned(spark, str(tmp_path / "gone"), [".png"])
    with pytest.raises(FileNotFoundError):
        paths.scanned(spark, str(tmp_path), [".ppm"], empty_ok=False)
    with pytest.raises(ValueError):
        paths.scanned(spark, str(tmp_path / "a10.png"), [".ppm"])
    (tmp_path / "more.txt").write_text("list.txt\n")
    with pytest.raises(ValueError, match="names itself"):
        paths.scanned(spark, str(tmp_path / "list.txt"), [".png"])
    for bad in ("", [], None):
        with pytest.raises(ValueError):
            paths.cleaned(bad)
    with pytest.raises(TypeError):
        paths.cleaned([1])
    assert paths.unique(str(tmp_path / "new.png")).endswith("new.png")
    assert paths.unique(str(tmp_path / "a10.png")).endswith("a10(1).png")


def test_pairs_and_actions(spark, tmp_path):
    images = spark.createDataFrame([("/d/a1.png",), ("/d/a10.png",), ("/d/b.png",)], "path string")
    pages = spark.createDataFrame([("/d/page/a1.xml",), ("/d/page/a10.xml",), ("/d/page/z.xml",)], "path string")
    assert {r.image: r.xml for r in paths.xml_beside(images, pages).collect()} == {"/d/a1.png": "/d/page/a1.xml", "/d/a10.png": "/d/page/a10.xml", "/d/b.png": None}
    assert {r.xml: r.image for r in paths.image_beside(pages, images).collect()} == {"/d/page/a1.xml": "/d/a1.png", "/d/page/a10.xml": "/d/a10.png", "/d/page/z.xml": None}
    assert [r.path for r in paths.missing(images, images.limit(2)).collect()] == ["/d/b.png"]
    (tmp_path / "one").write_text("1")
    (tmp_path / "two").write_text("2")
    for mode in ("copy", "link", "symlink"):
        of = spark.createDataFrame([(str(tmp_path / "one"), str(tmp_path / "to" / mode), mode)], "src string, dst string, mode string")
        paths.applied(of)
        paths.applied(of.withColumn("src", F.lit(str(tmp_path / "two"))))
        assert (tmp_path / "to" / mode).read_text() == "2" and (tmp_path / "to" / mode).is_symlink() == (mode == "symlink")
    got = paths.paired_copies(spark.createDataFrame([("/d/a.png", "/d/page/a.xml"), ("/d/b.png", None)], "image string, xml string"), "/t/", "link").collect()
    assert sorted(r.dst for r in got) == ["/t/a.png", "/t/b.png", "/t/page/a.xml"]


def documents(spark, n=4, shift=0):
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.lit(60).alias("w"), F.lit(80).alias("h"))
    box = G.rectangle(F.lit(5 + shift), (F.col("page_id") * 3).cast("int"), F.lit(20), F.lit(9))
    regions = pages.select("page_id", F.lit(1).alias("seq"), F.lit("photo").alias("rtype"), F.lit("ImageRegion").alias("tag"), box.alias("pts"))
    return pagexml.written(pages, regions)


def test_preparation_keeps_what_is_there(spark, tmp_path):
    docs, classes = documents(spark), taxonomy.classes(spark, ["photo"])
    images = spark.range(4).select(F.col("id").alias("page_id"), F.format_string("/in/%d.png", "id").alias("path"))
    run = lambda images, docs, mode="region": jobs.prepared(images, docs, classes, str(tmp_path / "set"), mode, ["sem_seg", "instances"], {"mode": "none"})
    assert run(images.filter("page_id < 3"), docs).count() == 3
    assert run(images, docs).count() == 4
    held = spark.read.parquet(str(tmp_path / "set" / "sem_seg"))
    assert sorted(r.page_id for r in held.collect()) == [0, 1, 2, 3]  # none twice
    run(images, docs, "text_line")
    assert spark.read.parquet(str(tmp_path / "set" / "sem_seg")).filter("NOT empty").count() == 0  # another mode: all anew
    half = jobs.prepared(images, docs, classes, str(tmp_path / "half"), "region", ["sem_seg", "segments"], {"mode": "scaling", "scaling": 0.5})
    assert {(r.h, r.w) for r in half.collect()} == {(40, 30)}
    assert jobs.loaded(spark, str(tmp_path / "half"), "segments").count() == 4
    truth = spark.read.parquet(str(tmp_path / "half" / "sem_seg")).select("page_id", "h", "w", "runs")
    assert [r.iou for r in jobs.validated(spark, truth, str(tmp_path / "half"), 2).collect()] == [100.0, 100.0]


def test_preparation_checks_its_input(spark, tmp_path):
    docs, classes = documents(spark), taxonomy.classes(spark, ["photo"])
    images = spark.range(5).select(F.col("id").alias("page_id"), F.lit("x").alias("path"))
    run = lambda images, docs, outputs=("sem_seg",), mode="region": jobs.prepared(images, docs, classes, str(tmp_path / "set"), mode, outputs, {"mode": "none"})
    for bad, told in ((images, "without a document"), (images.filter("page_id < 0"), "0 images"), (images.filter("page_id < 3").union(images.limit(1)), "twice")):
        with pytest.raises(ValueError, match=told):
            run(bad, docs)
    with pytest.raises(ValueError, match="cannot be read"):
        run(images.filter("page_id < 4"), docs.withColumn("xml", F.when(F.col("page_id") == 2, "<broken").otherwise(F.col("xml"))))
    with pytest.raises(NotImplementedError):
        run(images.filter("page_id < 4"), docs, ("pictures",))
    with pytest.raises(NotImplementedError):
        masks.converted(masks.Layout.read(docs, classes), "sem_seg", "unknown")


def test_parts_and_yolo(spark, tmp_path):
    docs, classes = documents(spark), taxonomy.classes(spark, ["photo"])
    images = spark.range(4).select(F.col("id").alias("page_id"), F.format_string("/in/%d.png", "id").alias("path"))
    got = jobs.prepared_parts({"train": (images.filter("page_id < 3"), docs), "val": (images.filter("page_id = 3"), docs)}, classes, str(tmp_path), "region", ["yolo_detection"], {"mode": "none"})
    assert {k: v.count() for k, v in got.items()} == {"train": 3, "val": 1}
    row = jobs.loaded(spark, str(tmp_path / "val"), "yolo_detection").head()
    assert (row.category_id, round(row.cx, 4), round(row.box_w * 59, 3)) == (0, round(15 / 59, 4), 20.0)
    assert jobs.yolo_description("/s", ["train"], ["photo"]) == "path: /s\ntrain: images/train\nnames:\n  0: photo\n"


def test_comparison_of_different_sizes_is_an_error(spark):
    one = masks.converted(masks.Layout.read(documents(spark), taxonomy.classes(spark, ["photo"])), "sem_seg", "region")
    with pytest.raises(Exception, match="masks of"):
        evaluate.mask_confusion(one, one.withColumn("h", F.col("h") + 1), 2).collect()
    with pytest.raises(Exception, match="masks of"):
        evaluate.mask_confusion(one, one.filter("page_id > 0"), 2).collect()


def test_missing_confidence_is_an_error(spark):
    with pytest.raises(Exception, match="no confidence"):
        evaluate.confidence(pagexml.confidences(pagexml.elements(documents(spark)))).collect()
    with pytest.raises(Exception, match="no pair"):
        evaluate.in_order(spark.createDataFrame([("a/x.png",)], "path string"), spark.createDataFrame([("b/y.xml",)], "path string"), "path").collect()


def test_strange_documents():
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    error = lambda text: pagexml.parsed(text)[0][-1]
    assert error(None) and error("") and error("<a") and error("<PcGts/>") and error('<PcGts><Page imageWidth="3"/></PcGts>')
    assert "name space" in error('<PcGts xmlns="a"><Page imageWidth="3" imageHeight="4"><b:TextRegion xmlns:b="b"/></Page></PcGts>')
    got = pagexml.parsed(head + '<PcGts xmlns="a"><Page imageFilename="é" imageWidth="3" imageHeight="4"><TableRegion id="t"><TextRegion id="n"><Coords points="1,2 3,4"/><TextLine><Baseline points="1,1"/></TextLine></TextRegion></TableRegion></Page></PcGts>')
    assert [(r[4], r[5], r[9]) for r in got] == [("Page", None, []), ("TableRegion", "t", []), ("TextRegion", "n", [got[1][3]]), ("TextLine", None, [got[1][3], got[2][3]]), ("Baseline", None, [got[1][3], got[2][3], got[3][3]])]


TRANSFORMS = {
    "resize": lambda: augment.resize(12, 15, 24, 30), "flip": lambda: augment.flip(12, 15, True), "flop": lambda: augment.flip(12, 15, False), "turn": lambda: augment.turn(12, 15, 1), "half": lambda: augment.turn(12, 15, 2),
    "pad": lambda: augment.pad(12, 15, 1, 2, 3, 4), "affine": lambda: augment.affine(np.array([[1.0, 0, 2], [0, 1, -1]])), "all": lambda: augment.composed([augment.flip(12, 15, True), augment.turn(12, 15, 3), augment.pad(15, 12, 1, 1, 1, 1)]),
}


@pytest.mark.parametrize("name", TRANSFORMS)
def test_points_follow_and_come_back(name):
    t = TRANSFORMS[name]()
    p = np.array([[3.0, 4.0], [10.0, 7.0]])
    assert np.allclose(t.inverse().points(t.points(p)), p)
    if name not in ("affine", "resize"):
        assert (t.inverse().image(t.image(IMAGE)) == IMAGE).all()
        mark = np.zeros((12, 15), np.uint8)
        mark[4:6, 3:8] = 1
        ring = np.array([[3.0, 4], [8, 4], [8, 6], [3, 6]])  # corners of cells
        at = np.argwhere(t.labels(mark) == 1)[:, ::-1]
        moved = t.points(ring)
        assert np.allclose(at.min(axis=0), moved.min(axis=0)) and np.allclose(at.max(axis=0) + 1, moved.max(axis=0))


def test_what_cannot_be_undone():
    with pytest.raises(ValueError):
        augment.composed([augment.warp(np.zeros((12, 15)), np.zeros((12, 15)))]).inverse()
    cut = augment.crop(12, 15, 2, 3, 5, 6)
    back = cut.inverse().labels(cut.labels(np.ones((12, 15), np.uint8)))
    assert back.shape == (12, 15) and (back[2:7, 3:9] == 1).all() and (back == 1).sum() == 30


@pytest.mark.parametrize("kind, size", [("relative", (0.5, 0.5)), ("relative_range", (0.4, 0.6)), ("absolute", (5, 7)), ("absolute_range", (4, 9))])
def test_crops(kind, size):
    g = np.random.default_rng(2)
    for _ in range(30):
        h, w = augment.random_crop(kind, size)(augment.Sample(IMAGE), g).image(IMAGE).shape[:2]
        assert {"relative": (h, w) == (6, 8), "relative_range": 5 <= h <= 12 and 9 <= w <= 15, "absolute": (h, w) == (5, 7), "absolute_range": 4 <= h <= 9 and 4 <= w <= 9}[kind]
    assert augment.fixed_crop(20, 6)(augment.Sample(IMAGE), g).image(IMAGE).shape == (20, 6, 3)
    with pytest.raises(NotImplementedError):
        augment.crop_size("other", size, 3, 3, g)


def test_crops_that_no_class_fills():
    labels = np.zeros((40, 40), np.uint8)
    labels[:, 30:] = 1
    image, shares = np.zeros((40, 40, 1), np.uint8), []
    for most in (1.0, 0.8):
        g, n = np.random.default_rng(3), 0
        for _ in range(60):
            part = augment.random_crop("absolute", (10, 10), most)(augment.Sample(image, labels), g).labels(labels)
            n += np.bincount(part.ravel()).max() < 80
        shares.append(n)
    assert shares[1] > 2 * shares[0]


def test_chain_of_a_configuration():
    g = lambda: np.random.default_rng(4)
    s = augment.Sample(IMAGE, np.ones((12, 15), np.uint8), 300)
    assert augment.chain_of({"resize": {"mode": "shortest_edge", "min": [24], "max": 28}}, "val")(s, g()).image(IMAGE).shape == (22, 28, 3)
    assert augment.chain_of({"resize": {"mode": "longest_edge", "min": [30]}}, "test")(s, g()).image(IMAGE).shape == (24, 30, 3)
    assert augment.chain_of({"resize": {"mode": "none", "target_dpi": 150}}, "preprocess")(s, g()).image(IMAGE).shape == (6, 8, 3)
    assert augment.chain_of({"flip": {"vertical": 1.0}}, "train")(s, g()).image(IMAGE).tolist() == IMAGE[::-1].tolist()
    full = {k: {"p": 1.0} for k in ("turn", "elastic", "affine", "grayscale", "threshold", "invert", "blur", "noise", "brightness", "contrast", "saturation", "hue")} | {"crop": {"enabled": True, "resize": True}}
    t = augment.chain_of(full, "train")(s, g())
    assert t.image(IMAGE).shape[:2] == t.labels(s.labels).shape and set(np.unique(t.labels(s.labels))) <= {1, 255}
    with pytest.raises(NotImplementedError):
        augment.chain_of({}, "other")
    with pytest.raises(NotImplementedError):
        augment.chain_of({"resize": {"mode": "other"}}, "val")
    with pytest.raises(KeyError):
        augment.chain_of({"unknown": 1}, "val")


def test_samples_are_mapped_together(spark):
    schema = "path long, h int, w int, c int, data binary, dpi int, labels binary, annotations array<array<struct<x:double,y:double>>>"
    labels = np.zeros((12, 15), np.uint8)
    labels[2, 3] = 7
    rows = [(k, 12, 15, 3, bytearray(IMAGE.tobytes()), None, bytearray(labels.tobytes()) if k else None, [[(3.0, 2.0)]]) for k in range(3)]
    of, draw = spark.createDataFrame(rows, schema), augment.chain_of({"flip": {"horizontal": 1.0}}, "train")
    got = {r.path: r for r in augment.mapped_samples(of, draw, "path", True).collect()}
    assert got[0].labels is None and np.frombuffer(got[1].labels, np.uint8).reshape(12, 15)[2, 11] == 7
    assert got[2].annotations[0][0].x == 12.0 and np.frombuffer(got[2].data, np.uint8).reshape(12, 15, 3).tolist() == IMAGE[:, ::-1].tolist()
    assert augment.mapped_samples(of, draw, "path", False).head().annotations is None
    with pytest.raises(Exception, match="labels of"):
        augment.mapped_samples(of.withColumn("labels", F.lit(b"12")), draw, "path", True).collect()


def test_runs_of_the_program(tmp_path):
    of = config.Frozen({"a": {"b": [1, 2]}, "seed": 3})
    with pytest.raises(TypeError):
        of.a.b = 3
    assert config.plain(of) == {"a": {"b": [1, 2]}, "seed": 3} and config.value_at(of, "a.b") == [1, 2] and of.a["b"] == [1, 2]
    with pytest.raises(KeyError, match="c is missing"):
        config.value_at(of, "a.c")
    at = config.started(of, tmp_path)
    assert json.loads((at / "config.json").read_text())["config"] == config.plain(of)
    log = config.logger("quirefold.test", tmp_path / "log.txt")
    assert len(config.logger("quirefold.test", tmp_path / "log.txt").handlers) == 2
    log.info("said")
    logging.shutdown()
    assert "said" in (tmp_path / "log.txt").read_text()
    with config.folder_or_temporary(None) as folder:
        assert folder.exists()
    assert not folder.exists()
    rows = []
    with pytest.raises(ValueError), config.timed(rows, "x"):
        raise ValueError
    assert rows[0][0] == "x" and rows[0][1] >= 0


def test_models(spark):
    @inference.loader("short of memory")
    def _(path):
        def run(a):
            raise MemoryError

        return run

    of = spark.createDataFrame([(1, 12, 15, 3, bytearray(IMAGE.tobytes()))], "path long, h int, w int, c int, data binary")
    # the loaders of this test are known to this process alone
    assert inference.part_of("sem_seg", "scores") is evaluate.compared
    with pytest.raises(NotImplementedError):
        inference.part_of("other", "scores")
    assert inference.predicted(of, "threshold", "100", fallback="threshold").count() == 1


def test_answers_of_the_ledger(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([("a", "queued", None), ("b", "processing", None), ("c", "queued", None)], "identifier string, status string, process_end timestamp_ntz")
    done = spark.createDataFrame([("a", t, None), ("b", t, "broke"), ("b", t + dt.timedelta(1), None)], "identifier string, at timestamp_ntz, error string")
    assert sorted((x.identifier, x.status, x.error_message) for x in ledger.completed(r, done).collect()) == [("a", "finished", None), ("b", "error", "broke"), ("c", "queued", None)]
    assert tuple(ledger.health(r, 2).head()) == (2, 1, "full") and ledger.health(r, 3).head().state == "healthy"
    told = ledger.refused(spark.createDataFrame([(1, 202), (2, 429)], "event_id long, status_code int")).collect()
    assert [(x.event_id, json.loads(x.body)["error"]) for x in told] == [(2, "the queue is full")]
