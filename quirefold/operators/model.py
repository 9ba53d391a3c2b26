"""The page model: sizes, ids, iterators over regions, baselines, zones and texts, and sampling by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import pagetext as T


def page_size(pages: DataFrame) -> DataFrame:
    """page_id, h, w; an override (struct h, w) goes before the page's own size."""
    size = F.coalesce("override", F.struct(F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w")))
    return pages.select("page_id", size.alias("s")).select("page_id", "s.h", "s.w")


def element_id(rows: DataFrame) -> DataFrame:
    """With id "None" where there is none."""
    return rows.withColumn("id", F.coalesce("id", F.lit("None")))


def class_regions(regions: DataFrame, classes: DataFrame) -> DataFrame:
    """Regions of known type with three points at least, and class_id. classes: (name, class_id), a few rows per taxonomy."""
    known = classes.select(F.col("name").alias("rtype"), "class_id")
    return regions.join(F.broadcast(known), "rtype").filter(F.size("pts") >= 3)


def baselines(lines: DataFrame) -> DataFrame:
    """With pts from the text `points`; without points a line is none, a single point is doubled."""
    pts = lines.filter(F.col("points").isNotNull() & (F.trim("points") != "")).withColumn("pts", G.points(F.col("points")))
    return pts.withColumn("pts", F.when(F.size("pts") == 1, F.concat("pts", "pts")).otherwise(F.col("pts")))


def zones(regions: DataFrame, names: list[str]) -> DataFrame:
    """Regions of these types, numbered from 0 on each page in document order (seq)."""
    w = Window.partitionBy("page_id").orderBy("seq")
    return regions.filter(F.col("rtype").isin(names)).withColumn("idx", F.row_number().over(w) - 1)


def transcription(lines: DataFrame) -> DataFrame:
    """(key, text) by region and line id; a missing text is '', of equal keys the last by place counts."""
    key = F.concat_ws("_", F.col("region_id").cast("string"), F.col("line_id").cast("string"))
    last = F.max_by(T.unit_text(F.col("text")), F.col("place"))
    return lines.groupBy(key.alias("key")).agg(last.alias("text"))


def resolution(auto: Column, found: Column, default: int, manual: int) -> Column:
    """The resolution found in the file, or the default, if so wished; else the one given."""
    return F.when(auto, F.coalesce(found, F.lit(default))).otherwise(F.lit(manual))


def chance(key: Column, p: float, seed: int) -> Column:
    """True with probability p, by a hash of the key, so that a run can be replayed."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return h < int(p * (1 << 32))


def processing_step(pages: DataFrame, config: dict[str, str], allowed: list[str], confidence: Column) -> DataFrame:
    """With a struct `step`: creator, time, confidence, and of the configuration what is allowed; an unknown key is an error."""
    missing = [k for k in allowed if k not in config]
    if missing:
        raise KeyError(f"not in the configuration: {missing}")
    kept = F.create_map(*[F.lit(x) for k in allowed for x in (k, config[k])]) if allowed else F.create_map().cast("map<string,string>")
    return pages.withColumn("step", F.struct(F.uuid().alias("id"), F.current_timestamp().alias("time"), confidence.alias("confidence"), kept.alias("config")))


def links(files: DataFrame, target: str, mode: str) -> DataFrame:
    """(src, dst, mode) of what to copy or link, one row per file."""
    if mode not in ("copy", "link", "symlink"):
        raise ValueError(mode)
    return files.select(F.col("path").alias("src"), F.concat(F.lit(target.rstrip("/") + "/"), T.name_of(F.col("path"))).alias("dst"), F.lit(mode).alias("mode"))
