"""Sinks: YOLO label lines, file lists, mask pictures, heat maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detection_line(category: Column, box: Column) -> Column:
    """ "category cx cy w h" of a normalised centre box."""
    return F.concat_ws(" ", category.cast("string"), *[box[k].cast("string") for k in ("cx", "cy", "w", "h")])


def segmentation_line(category: Column, pts: Column) -> Column:
    """ "category x1 y1 x2 y2 ..." of normalised points."""
    return F.concat_ws(" ", category.cast("string"), F.array_join(F.transform(pts, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), " "))


def write_lines(rows: DataFrame, path: str, page: str, line: str) -> None:
    """A folder per page with its lines as text."""
    rows.select(page, F.col(line).alias("value")).write.partitionBy(page).text(path)


def write_list(rows: DataFrame, path: str, column: str) -> None:
    """One list of names, sorted; a list is as long as the data set has files, and one task writes it by intent."""
    rows.select(F.col(column).cast("string").alias("value")).orderBy("value").coalesce(1).write.text(path)


def coloured(classes: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """A mask as an RGB picture by its classes' colours."""
    return np.asarray(palette, np.uint8)[classes]


def overlaid(image: np.ndarray, classes: np.ndarray, palette: np.ndarray, share: float = 0.5) -> np.ndarray:
    """The picture of a mask over an image, the background left as it is."""
    mixed = (image * (1 - share) + coloured(classes, palette) * share).astype(np.uint8)
    return np.where(classes[..., None] > 0, mixed, image)


# Colours of a scale from low to high, in even steps between which it is linear.
SCALE = ((13, 8, 135), (84, 2, 163), (139, 10, 165), (185, 50, 137), (219, 92, 104), (244, 136, 73), (254, 188, 43), (240, 249, 33))


def heat(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 as colours of the scale."""
    at = np.clip(np.asarray(values, float), 0, 1) * (len(SCALE) - 1)
    scale = np.array(SCALE, float)
    return np.floor(np.stack([np.interp(at, np.arange(len(SCALE)), scale[:, k]) for k in range(3)], axis=-1) + 0.5).astype(np.uint8)
