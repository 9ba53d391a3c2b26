import numpy as np
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.sources import sinks


def test_yolo_lines(spark, tmp_path):
    pts = G.points(F.lit("0,0 0,4 8,4"))
    row = spark.range(1).select(sinks.detection_line(F.lit(3), G.centre_box(G.box(pts))).alias("d"), sinks.segmentation_line(F.lit(3), pts).alias("s")).head()
    assert (row.d, row.s) == ("3 4.0 2.0 8 4", "3 0 0 0 4 8 4")
    lines = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "page long, line string")
    sinks.write_lines(lines, str(tmp_path / "l"), "page", "line")
    assert sorted((r.page, r.value) for r in spark.read.text(str(tmp_path / "l")).collect()) == [(1, "a"), (1, "b"), (2, "c")]
    sinks.write_list(lines, str(tmp_path / "n"), "line")
    assert [r.value for r in spark.read.text(str(tmp_path / "n")).collect()] == ["a", "b", "c"]


def test_pictures():
    classes = np.array([[0, 1]])
    palette = [(0, 0, 0), (255, 0, 0)]
    assert sinks.coloured(classes, palette).tolist() == [[[0, 0, 0], [255, 0, 0]]]
    assert sinks.overlaid(np.full((1, 2, 3), 100), classes, palette).tolist() == [[[100, 100, 100], [177, 50, 50]]]
    assert sinks.heat(np.array([0.0, 1.0])).tolist() == [list(sinks.SCALE[0]), list(sinks.SCALE[-1])]
