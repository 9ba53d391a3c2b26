"""Samples under one transform: a picture, its labels and its points move together.

A Transform has a part for each of the three and, where there is one, its inverse. An augmentation draws a transform for a
sample from a generator of the sample's key, so that a second run gets the same. `chain_of` builds the chain of a
configuration, `mapped_samples` runs one over rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quirefold.operators import pixels as P

Array = np.ndarray
_same = lambda a: a


@dataclass
class Transform:
    """What happens to a picture [h, w, c], to labels [h, w] and to points [n, 2] (x, y). inverse gives the transform that undoes this one; None: nothing does."""

    image: Callable[[Array], Array] = _same
    labels: Callable[[Array], Array] = _same
    points: Callable[[Array], Array] = _same
    inverse: Callable[[], Transform] | None = None


def _on_labels(f: Callable[[Array], Array]) -> Callable[[Array], Array]:
    return lambda m: f(m[..., None])[..., 0]


def resize(h: int, w: int, new_h: int, new_w: int) -> Transform:
    by = np.array([new_w / w, new_h / h])
    return Transform(lambda a: P.resized(a, new_h, new_w), _on_labels(lambda m: P.resized(m, new_h, new_w, True)), lambda p: p * by, lambda: resize(new_h, new_w, h, w))


def flip(h: int, w: int, across: bool) -> Transform:
    """Left and right exchanged if across, else top and bottom."""
    turn = (lambda a: a[:, ::-1]) if across else (lambda a: a[::-1])
    size, sign = (np.array([w, 0]), np.array([-1, 1])) if across else (np.array([0, h]), np.array([1, -1]))
    return Transform(turn, turn, lambda p: size + sign * p, lambda: flip(h, w, across))


def turn(h: int, w: int, quarters: int) -> Transform:
    """Quarter turns against the clock."""
    move = {0: lambda p: p, 1: lambda p: np.stack([p[:, 1], w - p[:, 0]], axis=1), 2: lambda p: np.array([w, h]) - p, 3: lambda p: np.stack([h - p[:, 1], p[:, 0]], axis=1)}[quarters % 4]
    to = (w, h) if quarters % 2 else (h, w)
    return Transform(lambda a: np.rot90(a, quarters), lambda m: np.rot90(m, quarters), move, lambda: turn(*to, -quarters % 4))


def affine(m: Array, ignored: int = P.IGNORED) -> Transform:
    """By a 2 x 3 matrix of places; labels from outside are ignored ones."""
    full = np.vstack([m, [0, 0, 1]])
    return Transform(lambda a: P.affine(a, m), _on_labels(lambda x: P.affine(x, m, True, ignored)), lambda p: p @ m[:, :2].T + m[:, 2], lambda: affine(np.linalg.inv(full)[:2], ignored))


def warp(dy: Array, dx: Array, ignored: int = P.IGNORED) -> Transform:
    """By a field; points stay where they are."""
    return Transform(lambda a: P.warped(a, dy, dx), _on_labels(lambda m: P.warped(m, dy, dx, True, ignored)))


def colour(f: Callable[[Array], Array]) -> Transform:
    return Transform(image=f)


def hue(by: float) -> Transform:
    return Transform(image=lambda a: P.hue(a, by), inverse=lambda: hue(-by))


def crop(h: int, w: int, y: int, x: int, new_h: int, new_w: int) -> Transform:
    cut = lambda a: a[y : y + new_h, x : x + new_w]
    return Transform(cut, cut, lambda p: p - np.array([x, y]), lambda: pad(new_h, new_w, y, h - y - new_h, x, w - x - new_w))


def pad(h: int, w: int, top: int, bottom: int, left: int, right: int, value: int = 0, label: int = P.IGNORED) -> Transform:
    return Transform(lambda a: P.padded(a, top, bottom, left, right, value), lambda m: np.pad(m, ((top, bottom), (left, right)), constant_values=label), lambda p: p + np.array([left, top]), lambda: crop(h + top + bottom, w + left + right, top, left, h, w))


def composed(steps: Sequence[Transform]) -> Transform:
    """One after the other; the inverse undoes them from the last to the first."""
    def through(name: str) -> Callable[[Array], Array]:
        def run(a: Array) -> Array:
            for s in steps:
                a = getattr(s, name)(a)
            return a

        return run

    def undone() -> Transform:
        if any(s.inverse is None for s in steps):
            raise ValueError("a step cannot be undone")
        return composed([s.inverse() for s in reversed(steps)])

    return Transform(through("image"), through("labels"), through("points"), undone)


# --- augmentations: of (picture, labels or None, generator) to a transform ---


@dataclass
class Sample:
    image: Array
    labels: Array | None = None
    dpi: int | None = None
    points: list[Array] = field(default_factory=list)


Draw = Callable[[Sample, np.random.Generator], Transform]
NOTHING = Transform()


def perhaps(p: float, draw: Draw) -> Draw:
    return lambda s, g: draw(s, g) if g.random() < p else NOTHING


def always(of: Callable[[Array], Array]) -> Draw:
    return lambda s, g: colour(of)


def _whole(v: float) -> int:
    return int(v + 0.5)


def fitted(h: float, w: float, most: float | None) -> tuple[int, int]:
    """Rounded, and no edge over `most`."""
    by = most / max(h, w) if most and max(h, w) > most else 1.0
    return _whole(h * by), _whole(w * by)


def resize_scaling(scale: float, most: int | None = None, target_dpi: int | None = None) -> Draw:
    def draw(s: Sample, g: np.random.Generator) -> Transform:
        h, w = s.image.shape[:2]
        by = scale * (target_dpi / s.dpi if target_dpi and s.dpi else 1)
        return resize(h, w, *fitted(h * by, w * by, most))

    return draw


def resize_edge(sizes: Sequence[int], most: int | None = None, longest: bool = False, style: str = "choice") -> Draw:
    """The shortest or longest edge to one of the sizes ("choice") or any from the first to the last ("range"); 0: as it is. The ratio stays."""
    if style not in ("choice", "range"):
        raise NotImplementedError(style)

    def draw(s: Sample, g: np.random.Generator) -> Transform:
        h, w = s.image.shape[:2]
        edge = int(g.choice(sizes)) if style == "choice" else int(g.integers(sizes[0], sizes[-1] + 1))
        if edge <= 0:
            return NOTHING
        by = edge / (max if longest else min)(h, w)
        return resize(h, w, *fitted(h * by, w * by, most))

    return draw


def random_flip(across: bool = True) -> Draw:
    return lambda s, g: flip(*s.image.shape[:2], across)


def random_turn(shares: Sequence[float] = (0.25, 0.25, 0.25, 0.25)) -> Draw:
    return lambda s, g: turn(*s.image.shape[:2], int(g.choice(4, p=np.array(shares) / sum(shares))))


def random_elastic(strength: float = 4, sigma: float = 4) -> Draw:
    def draw(s: Sample, g: np.random.Generator) -> Transform:
        dy, dx = (P.smoothed(g.random(s.image.shape[:2]) * 2 - 1, P.bell(sigma)) * strength for _ in range(2))
        return warp(dy, dx)

    return draw


def random_affine(shift: float = 0.0, turned: float = 0.0, shear: float = 0.0, scale: float = 0.0) -> Draw:
    """Each part alone if the others are 0: a shift by a share of the size either way; a turn, von Mises about 0 with concentration 1 / turned^2; a shear by radians; a scale by exp of a draw either way."""
    def draw(s: Sample, g: np.random.Generator) -> Transform:
        h, w = s.image.shape[:2]
        u = lambda most: (g.random() * 2 - 1) * most
        angle = g.vonmises(0, 1 / turned**2) if turned else 0.0
        kx, ky, by = np.tan(u(shear)), np.tan(u(shear)), np.exp(u(scale))
        m = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]]) @ np.array([[1, kx], [ky, 1]]) * by
        middle = np.array([(w - 1) / 2, (h - 1) / 2])
        return affine(np.hstack([m, (middle - m @ middle + np.array([u(shift) * w, u(shift) * h]))[:, None]]))

    return draw


def random_blur(least: float, most: float) -> Draw:
    def draw(s: Sample, g: np.random.Generator) -> Transform:
        sigma = least + g.random() * (most - least)
        return colour(lambda a: P.blurred(a, sigma))

    return draw


def random_noise(most: float) -> Draw:
    def draw(s: Sample, g: np.random.Generator) -> Transform:
        noise, weight = g.random(s.image.shape) * 510 - 255, g.random() * most
        return colour(lambda a: P.blended(a, noise, weight, 1.0) if a.shape == noise.shape else a)

    return draw


def random_weight(of: Callable[[Array, float], Array], spread: float) -> Draw:
    """Brightness, contrast or saturation by a weight of 1 give or take the spread."""
    def draw(s: Sample, g: np.random.Generator) -> Transform:
        by = 1 + (g.random() * 2 - 1) * spread
        return colour(lambda a: of(a, by))

    return draw


def random_hue(most: float) -> Draw:
    return lambda s, g: hue(float(g.random() * 2 - 1) * most)


def crop_size(kind: str, size: Sequence[float], h: int, w: int, g: np.random.Generator) -> tuple[int, int]:
    """Height and width of a crop: shares of the picture ("relative"), any share from the given ones to 1 ("relative_range"), cells ("absolute"), or any number of cells from the first to the second ("absolute_range")."""
    if kind == "relative":
        return _whole(h * size[0]), _whole(w * size[1])
    if kind == "relative_range":
        a, b = (low + g.random() * (1 - low) for low in size)
        return _whole(h * a), _whole(w * b)
    if kind == "absolute":
        return min(int(size[0]), h), min(int(size[1]), w)
    if kind == "absolute_range":
        pick = lambda n: int(g.integers(min(n, int(size[0])), min(n, int(size[1])) + 1))
        return pick(h), pick(w)
    raise NotImplementedError(kind)


def fixed_crop(h: int, w: int, value: int = 0, label: int = P.IGNORED) -> Draw:
    """A random window of so many cells; a smaller picture is padded on the right and below."""
    def draw(s: Sample, g: np.random.Generator) -> Transform:
        have_h, have_w = s.image.shape[:2]
        new_h, new_w = min(h, have_h), min(w, have_w)
        y, x = int(g.integers(0, have_h - new_h + 1)), int(g.integers(0, have_w - new_w + 1))
        return composed([crop(have_h, have_w, y, x, new_h, new_w), pad(new_h, new_w, 0, h - new_h, 0, w - new_w, value, label)])

    return draw


def random_crop(kind: str, size: Sequence[float], most_share: float = 1.0, ignored: int | None = None, tries: int = 10) -> Draw:
    """A random window; with most_share under 1 the first of `tries` in which no class but the ignored one has so great a share, and two classes stand, else the last."""
    def draw(s: Sample, g: np.random.Generator) -> Transform:
        h, w = s.image.shape[:2]
        for _ in range(tries):
            new_h, new_w = crop_size(kind, size, h, w, g)
            y, x = int(g.integers(0, h - new_h + 1)), int(g.integers(0, w - new_w + 1))
            if most_share >= 1 or s.labels is None:
                break
            found, n = np.unique(s.labels[y : y + new_h, x : x + new_w], return_counts=True)
            n = n[found != ignored] if ignored is not None else n
            if len(n) > 1 and n.max() < n.sum() * most_share:
                break
        return crop(h, w, y, x, new_h, new_w)

    return draw


def crop_then_resize(cut: Draw, size: Draw) -> Draw:
    """A window, resized as a whole picture of its size would be."""
    def draw(s: Sample, g: np.random.Generator) -> Transform:
        first = cut(s, g)
        return composed([first, size(Sample(first.image(s.image), None, s.dpi), g)])

    return draw


def chain(*draws: Draw) -> Draw:
    """Each draws for the sample as the ones before have left it."""
    def draw(s: Sample, g: np.random.Generator) -> Transform:
        steps, now = [], s
        for d in draws:
            t = d(now, g)
            steps.append(t)
            now = Sample(t.image(now.image), None if now.labels is None else t.labels(now.labels), now.dpi)
        return composed(steps)

    return draw


#: The keys of a configuration and what they are without one. Probabilities of 0 leave a step out.
DEFAULTS: dict[str, Any] = {
    "resize": {"mode": "none", "min": [1024], "max": 2048, "sampling": "choice", "scaling": 1.0, "target_dpi": None},
    "crop": {"enabled": False, "type": "relative_range", "size": [0.9, 0.9], "most_share": 1.0, "ignored": None, "resize": False},
    "flip": {"horizontal": 0.0, "vertical": 0.0}, "turn": {"p": 0.0, "shares": [1, 1, 1, 1]}, "elastic": {"p": 0.0, "strength": 4, "sigma": 4},
    "affine": {"p": 0.0, "shift": 0.02, "turned": 0.05, "shear": 0.05, "scale": 0.05}, "grayscale": {"p": 0.0}, "threshold": {"p": 0.0}, "invert": {"p": 0.0},
    "blur": {"p": 0.0, "least": 0.5, "most": 1.5}, "noise": {"p": 0.0, "most": 0.1}, "brightness": {"p": 0.0, "spread": 0.3}, "contrast": {"p": 0.0, "spread": 0.3},
    "saturation": {"p": 0.0, "spread": 0.3}, "hue": {"p": 0.0, "most": 0.05},
}


def _resizing(of: Mapping[str, Any]) -> Draw:
    if of["mode"] == "none":
        return resize_scaling(1.0, None, of["target_dpi"])
    if of["mode"] == "scaling":
        return resize_scaling(of["scaling"], of["max"], of["target_dpi"])
    if of["mode"] in ("shortest_edge", "longest_edge"):
        return resize_edge(of["min"], of["max"], of["mode"] == "longest_edge", of["sampling"])
    raise NotImplementedError(f"unknown way of resizing: {of['mode']}")


def chain_of(config: Mapping[str, Any], mode: str) -> Draw:
    """The chain of a configuration (see DEFAULTS): for "preprocess", "val" and "test" the resizing alone, for "train" all."""
    from quirefold.plans.config import merged

    if mode not in ("preprocess", "train", "val", "test"):
        raise NotImplementedError(f"unknown mode: {mode}")
    c = merged(DEFAULTS, config)
    size = _resizing(c["resize"])
    if mode != "train":
        return chain(size)
    cut = random_crop(c["crop"]["type"], c["crop"]["size"], c["crop"]["most_share"], c["crop"]["ignored"])
    start = [size] if not c["crop"]["enabled"] else [crop_then_resize(cut, size)] if c["crop"]["resize"] else [size, cut]
    steps = [
        (c["turn"]["p"], random_turn(c["turn"]["shares"])), (c["flip"]["horizontal"], random_flip(True)), (c["flip"]["vertical"], random_flip(False)), (c["elastic"]["p"], random_elastic(c["elastic"]["strength"], c["elastic"]["sigma"])),
        (c["affine"]["p"], random_affine(*(c["affine"][k] for k in ("shift", "turned", "shear", "scale")))), (c["grayscale"]["p"], always(P.luminance)), (c["threshold"]["p"], always(P.thresholded)), (c["invert"]["p"], always(P.inverted)),
        (c["blur"]["p"], random_blur(c["blur"]["least"], c["blur"]["most"])), (c["noise"]["p"], random_noise(c["noise"]["most"])),
        *((c[k]["p"], random_weight(f, c[k]["spread"])) for k, f in (("brightness", P.brightness), ("contrast", P.contrast), ("saturation", P.saturation))), (c["hue"]["p"], random_hue(c["hue"]["most"])),
    ]
    return chain(*start, *(perhaps(p, d) for p, d in steps if p > 0))


def mapped_samples(samples: DataFrame, draw: Draw, key: str, train: bool, seed: int = 0) -> DataFrame:
    """(key, h, w, c, data, labels, annotations) of rows (key, h, w, c, data, dpi, labels, annotations), each under one drawn transform.

    labels are a byte a cell (null: none), of the picture's size or an error; annotations, arrays of points (x, y) (null:
    none), are dropped unless for training.
    """
    kind = samples.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                k, h, w, c, data, dpi, labels, notes = row
                image = np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c))
                if labels is not None and len(labels) != int(h) * int(w):
                    raise ValueError(f"{k}: labels of {len(labels)} cells for a picture of {h} x {w}")
                mask = None if labels is None else np.frombuffer(labels, np.uint8).reshape(int(h), int(w))
                t = draw(Sample(image, mask, None if pd.isna(dpi) else int(dpi)), P.generator(k, seed))
                new = np.ascontiguousarray(t.image(image))
                moved = None if notes is None or not train else [[{"x": float(x), "y": float(y)} for x, y in t.points(np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2))] for ring in notes]
                yield pd.DataFrame([(k, *new.shape, new.tobytes(), None if mask is None else np.ascontiguousarray(t.labels(mask)).tobytes(), moved)], columns=[key, "h", "w", "c", "data", "labels", "annotations"])

    return samples.select(key, "h", "w", "c", "data", "dpi", "labels", "annotations").mapInPandas(run, f"{key} {kind}, h int, w int, c int, data binary, labels binary, annotations array<array<struct<x:double,y:double>>>")
