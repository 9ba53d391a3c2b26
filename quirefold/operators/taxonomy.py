"""Class taxonomies as small tables: ids, merges, tags, colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import geometry as G

BACKGROUND = "background"


def class_ids(names: DataFrame) -> DataFrame:
    """(name, class_id) of rows (place, name): 0 is the background, then from 1 by place. One row per class."""
    ranked = names.select("name", F.row_number().over(Window.orderBy("place")).cast("int").alias("class_id"))
    ground = names.sparkSession.range(1).select(F.lit(BACKGROUND).alias("name"), F.lit(0).alias("class_id"))
    return ranked.union(ground)


def parsed_merges(text: str) -> list[tuple[str, str]]:
    """ "parent:child,child parent:child" to (parent, child)."""
    return [(p, c) for part in text.split() for p, _, cs in [part.partition(":")] for c in cs.split(",") if c]


def checked(pairs: list[tuple[str, str]], names: list[str]) -> None:
    """Parents must be defined, a child has one parent, and no parent is a child."""
    children = [c for _, c in pairs]
    for parent, _ in pairs:
        if parent not in names:
            raise ValueError(f"undefined parent: {parent}")
        if parent in children:
            raise ValueError(f"parent is a child itself: {parent}")
    if len(set(children)) < len(children):
        raise ValueError("a child is named twice")


def merged(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ids in which each child of (parent, child) has its parent's."""
    parent = ids.select(F.col("name").alias("parent"), F.col("class_id").alias("parent_id"))
    of = pairs.join(parent, "parent").select(F.col("child").alias("name"), "parent_id")
    return ids.join(of, "name", "left").select("name", F.coalesce("parent_id", "class_id").alias("class_id"))


def classes(spark: SparkSession, names: list[str], merged: str = "") -> DataFrame:
    """(name, class_id) of a configured list, children of merges at their parents' ids."""
    pairs = parsed_merges(merged)
    checked(pairs, names)
    parent = {c: p for p, c in pairs}
    own = [n for n in names if n not in parent]
    ids = {n: k + 1 for k, n in enumerate(own)}
    rows = [(BACKGROUND, 0), *ids.items(), *((c, ids[p]) for c, p in parent.items())]
    return spark.createDataFrame(rows, "name string, class_id int")


def tags(names: DataFrame, given: DataFrame, default: str = "TextRegion") -> DataFrame:
    """(name, tag): the one given, else the default; full_page always has the default."""
    full = names.sparkSession.range(1).select(F.lit("full_page").alias("name"), F.lit(default).alias("tag"))
    return names.join(given, "name", "left").select("name", F.coalesce("tag", F.lit(default)).alias("tag")).union(full)


def distinct_colours(n: int, step: int = 51) -> list[tuple[int, int, int]]:
    """n colours, each the farthest of a grid from those before; black first."""
    grid = [(r, g, b) for r in range(0, 256, step) for g in range(0, 256, step) for b in range(0, 256, step)]

    def far(a: tuple[int, int, int], b: tuple[int, int, int]) -> float:
        mean = (a[0] + b[0]) / 2
        return (2 + mean / 256) * (a[0] - b[0]) ** 2 + 4 * (a[1] - b[1]) ** 2 + (2 - (255 - mean) / 256) * (a[2] - b[2]) ** 2

    out = [(0, 0, 0)]
    near = [far(c, out[0]) for c in grid]
    while len(out) < n:
        k = max(range(len(grid)), key=lambda i: near[i])
        out.append(grid[k])
        near = [min(d, far(c, grid[k])) for d, c in zip(near, grid)]
    return out[:n]


def coloured(ids: DataFrame) -> DataFrame:
    """(name, class_id, r, g, b, far): a palette by class id, and the squared distance from black. The palette is made for as many classes as there are, a driver-side list of that length."""
    n = ids.agg(F.max("class_id")).head()[0] + 1
    palette = [(0, 0, 0), (255, 255, 255)] if n == 2 else distinct_colours(n)
    table = ids.sparkSession.createDataFrame([(k, *c) for k, c in enumerate(palette)], "class_id int, r int, g int, b int")
    zero = (F.lit(0), F.lit(0), F.lit(0))
    return ids.join(F.broadcast(table), "class_id").select("name", "class_id", "r", "g", "b", G.colour_distance((F.col("r"), F.col("g"), F.col("b")), zero).alias("far"))
