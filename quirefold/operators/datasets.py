"""Checks and cuts of data sets: histograms, duplicates, splits, samples, incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.sources.settled import settled


def draw(key: Column, seed: int) -> Column:
    """A hash that orders keys at random, the same each time."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def histogram(regions: DataFrame) -> DataFrame:
    """page_id, rtype, n of each page and type, of each page, and of all (nulls: all; a missing type is named "None")."""
    named = regions.select("page_id", F.coalesce("rtype", F.lit("None")).alias("rtype"))
    return named.rollup("page_id", "rtype").agg(F.count("*").alias("n"))


def remaining(pages: DataFrame, regions: DataFrame, bad: list[str]) -> DataFrame:
    """page_id and why it is out, or "remaining": "empty" without regions, "bad" with a missing or bad type."""
    of = regions.groupBy("page_id").agg(F.max(F.col("rtype").isNull() | F.col("rtype").isin(bad)).alias("bad"))
    return pages.select("page_id").join(of, "page_id", "left").select("page_id", F.when(F.col("bad").isNull(), "empty").when(F.col("bad"), "bad").otherwise("remaining").alias("state"))


def duplicates(names: DataFrame, name: str, place: str) -> DataFrame:
    """Names that stand in several places, with how often and in how many."""
    return names.groupBy(name).agg(F.count("*").alias("n"), F.count_distinct(place).alias("n_places")).filter("n > 1")


def shared_places(names: DataFrame, name: str, place: str) -> DataFrame:
    """(a, b, n): how many names places a < b share. Pairs are of the distinct places of one name, not of its rows."""
    of = names.groupBy(name).agg(F.array_sort(F.collect_set(place)).alias("ps")).filter(F.size("ps") > 1)
    pair = F.explode(F.flatten(F.transform("ps", lambda a, i: F.transform(F.slice("ps", i + 2, F.size("ps")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")
    return of.select(pair).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def bounds(n: int, parts: dict[str, float]) -> list[tuple[str, int]]:
    """Last rank of each part; ratios are normed, floors go to all but the last."""
    total, at, out = sum(parts.values()), 0, []
    for k, (name, share) in enumerate(parts.items()):
        at = n if k == len(parts) - 1 else at + int(n * (share / total))
        out.append((name, at))
    return out


def split(rows: DataFrame, key: str, parts: dict[str, float], seed: int = 42) -> DataFrame:
    """(key, part): exact shares by rank of the hash.

    The rank is global without one task for all rows: rows are ranged by the first hex digits of their hash, as many that a
    range has some 65,536 rows; counts per range give each its start, and ranks are taken within ranges.
    """
    n, digits = rows.count(), 0
    while digits < 8 and n >> (16 + 4 * digits):
        digits += 1
    hashed = rows.select(key, draw(F.col(key), seed).alias("_h")).withColumn("_g", F.substring("_h", 1, digits))
    sizes = hashed.groupBy("_g").agg(F.count("*").alias("_n"))
    start = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_g")) - F.col("_n"))
    start = F.broadcast(start) if digits <= 3 else start  # 4,096 rows at most
    rank = hashed.join(start, "_g").withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_h", key)) + F.col("_start"))
    part = None
    for name, last in bounds(n, parts):
        here = F.col("_r") <= last
        part = F.when(here, name) if part is None else part.when(here, name)
    return rank.select(key, part.alias("part"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by least hash."""
    return rows.orderBy(draw(F.col(key), seed), key).limit(n)


def to_do(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not there with the same keys."""
    return wanted.join(done, keys, "left_anti")


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """With place, the rank over all rows in this order.

    Rows are ranged by the order, so that each task sorts a share, and settled with the number of their share and their place
    in it; the shares' sizes, one number each, give the ranks their starts.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() % (1 << 33))
    ranged = settled(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    start = sizes.select(F.col("_part"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return ranged.join(F.broadcast(start), "_part").withColumn("place", F.col("_in") + F.col("_start") + 1).drop("_part", "_in", "_start")
