"""Preparing data sets: outputs of pages in a mode, kept by size, with a manifest; and what is done with them.

A prepared data set is a folder with a table per output, `manifest` and `run`. Outputs are keyed by page, size and mode, so
a second run prepares only what is not there; another mode prepares all anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.operators import datasets as D
from quirefold.operators import masks as M
from quirefold.sources import pagexml

KEYS = ["page_id", "h", "w"]


def sizes(pages: DataFrame, resize: Mapping[str, object]) -> DataFrame:
    """(page_id, h, w) that the pages (page_id, page_h, page_w) get. resize: mode none, scaling, shortest_edge or longest_edge, with scaling, min and max."""
    h, w = F.col("page_h").cast("long"), F.col("page_w").cast("long")
    if resize["mode"] == "none":
        new = h.cast("int"), w.cast("int")
    elif resize["mode"] == "scaling":
        new = G.size_by_scale(h, w, resize["scaling"], resize.get("max"))
    elif resize["mode"] in ("shortest_edge", "longest_edge"):
        new = G.size_by_edge(h, w, resize["min"], resize["mode"] == "longest_edge", resize.get("max"))
    else:
        raise NotImplementedError(f"unknown way of resizing: {resize['mode']}")
    return pages.select("page_id", new[0].alias("h"), new[1].alias("w"))


def checked(images: DataFrame, documents: DataFrame) -> None:
    """An error if there are no images or pages, a name stands twice, a page has no document or a document cannot be read; with counts and one example each."""
    n_images, n_pages = images.count(), documents.count()
    if not n_images or not n_pages:
        raise ValueError(f"{n_images} images and {n_pages} documents")
    faults = {
        "names that stand twice": images.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1").select("page_id"),
        "images without a document": images.join(documents, "page_id", "left_anti").select("page_id"),
        "documents that cannot be read": pagexml.checked(pagexml.elements(documents)).filter("state = 'broken'").select("page_id"),
    }
    told = [f"{of.count()} {name}, as {head[0]}" for name, of in faults.items() if (head := of.head())]
    if told:
        raise ValueError("; ".join(told))


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def prepared(images: DataFrame, documents: DataFrame, classes: DataFrame, path: str, mode: str, outputs: Sequence[str], resize: Mapping[str, object], width: int = 5, check: bool = True) -> DataFrame:
    """Prepares the outputs of images (page_id, path) and their documents (page_id, xml) under path; gives the manifest.

    What another run has left for the same page, size and mode is kept; each run adds files to a table by Spark's
    committer, so that a broken run leaves no half of one.
    """
    spark = images.sparkSession
    unknown = [o for o in outputs if o not in M.OUTPUTS]
    if unknown:
        raise NotImplementedError(f"unknown outputs: {unknown}")
    if check:
        checked(images, documents)
    layout = M.Layout.read(documents.join(images.select("page_id"), "page_id", "left_semi"), classes)
    wanted = sizes(layout.pages, resize)
    before = _table(spark, f"{path}/run")
    fresh = before is None or before.orderBy(F.col("at").desc()).head()["mode"] != mode
    for name in outputs:
        done = None if fresh else _table(spark, f"{path}/{name}")
        todo = wanted if done is None else D.to_do(wanted, done.select(*KEYS).distinct(), KEYS)
        made = M.converted(layout, name, mode, todo, width).join(todo.withColumnsRenamed({"h": "_h", "w": "_w"}), "page_id")
        keyed = made.drop("h", "w").withColumnsRenamed({"_h": "h", "_w": "w"}) if name not in ("sem_seg", "binary_seg", "panoptic") else made.drop("_h", "_w")
        keyed.write.mode("overwrite" if fresh else "append").parquet(f"{path}/{name}")
    manifest = images.join(wanted, "page_id").select("page_id", F.col("path").alias("image"), "h", "w", F.lit(mode).alias("mode"), F.array(*[F.lit(o) for o in outputs]).alias("outputs"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    run = spark.range(1).select(F.lit(uuid.uuid4().hex).alias("run_id"), F.current_timestamp().alias("at"), F.lit(mode).alias("mode"))
    run.write.mode("append").parquet(f"{path}/run")
    classes.write.mode("overwrite").parquet(f"{path}/classes")
    return spark.read.parquet(f"{path}/manifest")


def loaded(spark: SparkSession, path: str, output: str) -> DataFrame:
    """The manifest's pages with one prepared output, at the size that the manifest tells."""
    manifest = spark.read.parquet(f"{path}/manifest").select(*KEYS, "image", "mode")
    return manifest.join(spark.read.parquet(f"{path}/{output}"), KEYS)


def prepared_parts(parts: Mapping[str, tuple[DataFrame, DataFrame]], classes: DataFrame, path: str, *args, **more) -> dict[str, DataFrame]:
    """Prepares the parts of a data set, train and val say, each in a folder of its own; gives their manifests."""
    return {name: prepared(images, documents, classes, f"{path}/{name}", *args, **more) for name, (images, documents) in parts.items()}


def panoptic_pictures(masks: DataFrame) -> DataFrame:
    """(page_id, y, x0, x1, r, g, b): the runs of panoptic masks with their ids as colours."""
    return M.run_rows(masks).select("page_id", "y", "x0", "x1", G.packed_id(F.col("v")).alias("c")).select("page_id", "y", "x0", "x1", "c.*")


def yolo_layout(pages: DataFrame, path: str) -> DataFrame:
    """(page_id, part, image_dst, label_dst) of pages (page_id, image, part): images/part and labels/part under path."""
    name = F.regexp_extract("image", r"([^/]*)$", 1)
    base = F.lit(path.rstrip("/"))
    return pages.select("page_id", "part", F.concat_ws("/", base, F.lit("images"), "part", name).alias("image_dst"), F.concat(F.concat_ws("/", base, F.lit("labels"), "part", F.regexp_replace(name, r"\.[^.]*$", "")), F.lit(".txt")).alias("label_dst"))


def yolo_description(path: str, parts: Sequence[str], names: Sequence[str]) -> str:
    """The description of a YOLO data set: its folder, those of its parts, and the names by category."""
    return "\n".join([f"path: {path}", *(f"{p}: images/{p}" for p in parts), "names:", *(f"  {k}: {n}" for k, n in enumerate(names))]) + "\n"


def validated(spark: SparkSession, predictions: DataFrame, path: str, classes: int, ratio: float = 0.02) -> DataFrame:
    """All scores of predicted masks (page_id, h, w, runs) against a prepared data set's masks."""
    from quirefold.operators import evaluate as E

    truth = loaded(spark, path, "sem_seg").select("page_id", "h", "w", "runs")
    return E.compared(predictions, truth, classes, None, ratio)
