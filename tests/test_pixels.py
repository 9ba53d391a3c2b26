"""Pixel transforms, prediction and configuration."""

import json

import numpy as np
import pytest

from quirefold.operators import inference, pixels
from quirefold.plans import config

IMAGE = np.random.default_rng(0).integers(0, 256, (12, 15, 3)).astype(np.uint8)


def test_identities():
    assert (pixels.resized(IMAGE, 12, 15) == IMAGE).all()
    assert (pixels.affine(IMAGE, np.eye(3)[:2]) == IMAGE).all()
    assert (pixels.warped(IMAGE, 0, 0) == IMAGE).all()
    assert (pixels.inverted(pixels.inverted(IMAGE)) == IMAGE).all()
    assert (pixels.cropped(pixels.padded(IMAGE, 1, 2, 3, 4), 1, 3, 12, 15) == IMAGE).all()
    assert (pixels.brightness(IMAGE, 1.0) == IMAGE).all() and (pixels.hue(IMAGE, 0.0) == IMAGE).all()
    assert (pixels.hue(IMAGE, 1.0) == IMAGE).all()


def test_hue_undoes_itself():
    assert np.abs(pixels.hue(pixels.hue(IMAGE, 0.2), -0.2).astype(int) - IMAGE).max() <= 6


def test_shift_brings_ignored_cells_in():
    mask = np.ones((4, 4, 1), np.uint8)
    got = pixels.affine(mask, np.array([[1.0, 0, 2], [0, 1, 0]]), nearest=True, outside=pixels.IGNORED)[..., 0]
    assert (got[:, :2] == 255).all() and (got[:, 2:] == 1).all()


def test_flat_image_stays_flat():
    flat = np.full((9, 9, 3), 70, np.uint8)
    for f in (lambda a: pixels.blurred(a, 1.5), pixels.luminance, lambda a: pixels.contrast(a, 1.7), lambda a: pixels.saturation(a, 0.2)):
        assert np.abs(f(flat).astype(int) - 70).max() <= 1
    assert (pixels.thresholded(flat) == 255).all()


def test_polygon_is_cut_to_the_box():
    square = np.array([[0.0, 0], [10, 0], [10, 10], [0, 10]])
    got = pixels.clipped_polygon(square, 2, 3, 20, 6)
    assert {tuple(p) for p in got} == {(2, 3), (10, 3), (10, 6), (2, 6)}
    assert len(pixels.clipped_polygon(square, 20, 20, 30, 30)) == 0


def images(spark):
    return spark.createDataFrame([(k, 12, 15, 3, bytearray(IMAGE.tobytes())) for k in range(6)] + [(9, None, None, None, None)], f"path long, {pixels.SCHEMA}")


def test_the_same_key_draws_the_same(spark):
    of = lambda: {r.path: r.data for r in pixels.mapped(images(spark), lambda a, g: np.rot90(a, int(g.integers(0, 4))), "path", 3).collect()}
    one, two = of(), of()
    assert one == two and one[9] is None and len({bytes(v) for v in one.values() if v}) > 1


def test_prediction_and_its_regions(spark):
    a = np.full((10, 10, 3), 200, np.uint8)
    a[:, 5:] = 10
    of = spark.createDataFrame([("x", 10, 10, 3, bytearray(a.tobytes())), ("broken", None, None, None, None)], f"path string, {pixels.SCHEMA}")
    p = inference.predicted(of, "threshold", "100")
    row, = p.collect()
    assert row.path == "x" and row.confidence == pytest.approx(1.0, abs=1e-3)
    got = inference.regions_of(p, ["photo"]).collect()
    assert [(r.rtype, r.points) for r in got] == [("photo", "5,0 5,9 9,9 9,0")]


def test_config_layers(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"A": {"x": 1, "y": 2}}))
    (tmp_path / "top.json").write_text(json.dumps({"_BASE_": "base.json", "A": {"y": 3}}))
    made = config.merged({"A": {"x": 0, "y": 0, "z": 0}, "B": "b"}, config.from_file(tmp_path / "top.json"))
    assert config.overridden(made, ["A.z", "7", "B", "text"]) == {"A": {"x": 1, "y": 3, "z": 7}, "B": "text"}
    with pytest.raises(KeyError):
        config.overridden(made, ["A.unknown", "1"])
