"""Models as pluggable kernels: a registry, and batch prediction over images."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Name -> a function that loads a model: it takes a path and gives a function of an image [h, w, c] to logits [class, h, w].
LOADERS: dict[str, Callable[[str], Callable[[np.ndarray], np.ndarray]]] = {}


def loader(name: str):
    """Registers a loader; the module that does so must be importable on the executors."""

    def add(f):
        LOADERS[name] = f
        return f

    return add


@lru_cache(1)
def loaded(name: str, path: str) -> Callable[[np.ndarray], np.ndarray]:
    """One model is held per worker process, the one asked for last."""
    return LOADERS[name](path)


@loader("threshold")
def _threshold(path: str) -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in: class 1 where the first channel is under the number that `path` is."""
    cut = float(path)
    return lambda a: np.stack([a[..., 0] - cut, cut - a[..., 0]])


def predicted(images: DataFrame, name: str, path: str, key: str = "path", fallback: str | None = None) -> DataFrame:
    """(key, h, w, classes BINARY of uint8, confidence) of each image that could be read.

    confidence is the mean of the greatest probability, moved from [1/n, 1] to [0, 1]. An error in a model fails the task, but
    where memory runs out and a fallback is named (a loader on another device), the image goes through that.
    """
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(name, path)
        for b in batches:
            out = []
            for k, h, w, c, data in zip(b[key], b["h"], b["w"], b["c"], b["data"]):
                if data is None:
                    continue
                image = np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c)).astype(float)
                try:
                    z = np.asarray(model(image), float)
                except MemoryError:
                    if fallback is None:
                        raise
                    z = np.asarray(LOADERS[fallback](path)(image), float)
                p = 1 / np.exp(z - z.max(axis=0)).sum(axis=0)
                out.append((k, *z.shape[1:], z.argmax(axis=0).astype(np.uint8).tobytes(), float(((p - 1 / len(z)) / (1 - 1 / len(z))).mean())))
            yield pd.DataFrame(out, columns=[key, "h", "w", "classes", "confidence"])

    return images.select(key, "h", "w", "c", "data").mapInPandas(run, f"{key} {kind}, h int, w int, classes binary, confidence double")


def regions_of(predictions: DataFrame, names: list[str], least_area: float = 10, key: str = "path") -> DataFrame:
    """(key, rtype, seq, points) of predicted masks; names[k] is the name of class k + 1."""
    from quirefold.operators.vectorize import mask_polygons

    kind = predictions.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h, w, data in zip(b[key], b["h"], b["w"], b["classes"]):
                got = mask_polygons(np.frombuffer(data, np.uint8).reshape(int(h), int(w)).astype(int), least_area)
                out += [(k, names[c - 1], i + 1, " ".join(f"{x},{y}" for x, y in p)) for i, (c, p) in enumerate(got)]
            yield pd.DataFrame(out, columns=[key, "rtype", "seq", "points"])

    return predictions.select(key, "h", "w", "classes").mapInPandas(run, f"{key} {kind}, rtype string, seq long, points string")


def detected(images: DataFrame, name: str, path: str, key: str = "path") -> DataFrame:
    """(key, category, confidence, cx, cy, w, h) of the boxes that a detector gives for each image, as shares of its size. Its loader gives a function of an image to such rows without the key."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(name, path)
        for b in batches:
            out = [(k, *found) for k, h, w, c, data in zip(b[key], b["h"], b["w"], b["c"], b["data"]) if data is not None for found in model(np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c)))]
            yield pd.DataFrame(out, columns=[key, "category", "confidence", "cx", "cy", "w", "h"])

    return images.select(key, "h", "w", "c", "data").mapInPandas(run, f"{key} {kind}, category int, confidence double, cx double, cy double, w double, h double")


#: Kind of model -> what goes with it: how its samples are mapped, how it is scored, how its pages are made.
KINDS: dict[str, dict[str, str]] = {
    "sem_seg": {"mapper": "augment.mapped_samples", "scores": "evaluate.compared", "pages": "extract.generated"},
    "binary_seg": {"mapper": "augment.mapped_samples", "scores": "evaluate.above_half", "pages": "extract.generated"},
    "panoptic": {"mapper": "augment.mapped_samples", "scores": "evaluate.compared", "pages": "extract.generated"},
}


def part_of(kind: str, part: str) -> Callable:
    """The operator that a kind of model has for a part."""
    from importlib import import_module

    if kind not in KINDS:
        raise NotImplementedError(f"unknown kind of model: {kind}")
    module, _, name = KINDS[kind][part].partition(".")
    return getattr(import_module(f"quirefold.operators.{module}"), name)
