"""Evaluation: confusion matrices as aggregation, and what is derived from them.

A matrix is long: (pred, gt, n). One pass counts with partial sums before the shuffle; everything after works on at most
classes x classes rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, pred, gt, n) of rows (keys, pred, gt); rows may carry a weight n."""
    n = F.sum("n") if "n" in pairs.columns else F.count("*")
    return pairs.groupBy(*keys, "pred", "gt").agg(n.cast("long").alias("n"))


def with_ignored(gt: Column, ignored: int, classes: int) -> Column:
    """The ignored label goes to a bucket of its own, number `classes`."""
    return F.when(gt == ignored, classes).otherwise(gt)


def support(matrix: DataFrame, classes: int) -> DataFrame:
    """cls, tp, pos_gt, pos_pred of classes 0 to classes - 1; what the truth ignores counts nowhere."""
    of = matrix.filter(F.col("gt") < classes)
    each = of.select(F.explode(F.array(F.struct(F.col("gt").alias("cls"), F.lit(0).alias("side")), F.struct(F.col("pred").alias("cls"), F.lit(1).alias("side")))).alias("s"), "n", (F.col("pred") == F.col("gt")).alias("hit"))
    got = each.groupBy("s.cls").agg(F.sum(F.when((F.col("s.side") == 0) & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s.side") == 0, F.col("n")).otherwise(0)).alias("pos_gt"), F.sum(F.when(F.col("s.side") == 1, F.col("n")).otherwise(0)).alias("pos_pred"))
    every = matrix.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    return every.join(got, "cls", "left").select("cls", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "pos_gt", "pos_pred")])


def class_scores(of: DataFrame) -> DataFrame:
    """With acc and iou in percent; null without support in the truth."""
    union = F.col("pos_gt") + F.col("pos_pred") - F.col("tp")
    some = F.col("pos_gt") > 0
    return of.select("*", F.when(some, F.lit(100.0) * F.col("tp") / F.col("pos_gt")).alias("acc"), F.when(some & (union > 0), F.lit(100.0) * F.col("tp") / union).alias("iou"))


def totals(scores: DataFrame) -> DataFrame:
    """miou, fwiou, macc, pacc over the classes with support."""
    all_gt = F.sum("pos_gt")
    return scores.agg(F.avg("iou").alias("miou"), (F.sum(F.col("iou") * F.col("pos_gt")) / all_gt).alias("fwiou"), F.avg("acc").alias("macc"), (F.lit(100.0) * F.sum("tp") / all_gt).alias("pacc"))


def least_known(a: Column, b: Column) -> Column:
    """The lesser of two scores; null if the first is, the first if only the second is null."""
    return F.when(a.isNull(), None).when(b.isNull(), a).otherwise(F.least(a, b))


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of both sides with how often each has them; a pair is one and one."""
    count = lambda d, c: d.groupBy(key).agg(F.count("*").alias(c))
    both = count(left, "n_left").join(count(right, "n_right"), key, "full")
    return both.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_left", "n_right")]).withColumn("paired", (F.col("n_left") == 1) & (F.col("n_right") == 1))


def best_row(rows: DataFrame, metric: str, place: str, highest: bool = True) -> DataFrame:
    """The one row with the best metric, the first by place among equals."""
    key = F.struct(F.col(metric), -F.col(place)) if highest else F.struct(-F.col(metric), -F.col(place))
    return rows.filter(F.col(metric).isNotNull()).agg(F.max_by(F.struct("*"), key).alias("m")).select("m.*")


def running_best(rows: DataFrame, metric: str, place: str, key: str) -> DataFrame:
    """Of each key the rows at which the metric beats all before."""
    before = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_b", F.max(metric).over(before)).filter(F.col("_b").isNull() | (F.col(metric) > F.col("_b"))).drop("_b")


# --- masks ---


def border(mask: np.ndarray, ratio: float = 0.02) -> np.ndarray:
    """Each cell less the least one around it, zeros outside, as far as `ratio` of the diagonal (rounded half to even, 1 at least): what is left is a border."""
    h, w = mask.shape
    n = max(1, round(ratio * float(np.hypot(h, w))))
    least = np.pad(mask, n)
    for axis in (0, 1):
        size = least.shape[axis] - 2 * n
        least = np.minimum.reduce([np.take(least, np.arange(k, k + size), axis=axis) for k in range(2 * n + 1)])
    return mask - least


def mask_confusion(pred: DataFrame, truth: DataFrame, classes: int, ignored: int | None = None, ratio: float | None = None) -> DataFrame:
    """(page_id, pred, gt, n) of masks (page_id, h, w, runs) on both sides; the ignored label is number `classes`.

    With a ratio the borders of both are compared. A page that lacks a side, or whose masks differ in size, is an error.
    """
    from quirefold.operators.masks import dense

    side = lambda m, k: m.select("page_id", F.col("h").alias(f"h{k}"), F.col("w").alias(f"w{k}"), F.col("runs").alias(f"r{k}"))
    both = side(pred, 0).join(side(truth, 1), "page_id", "full")
    kind = pred.schema["page_id"].dataType.simpleString()
    runs = lambda r, h, w: dense(np.array([(x["y"], x["x0"], x["x1"], x["v"]) for x in r], np.int64).reshape(-1, 4), int(h), int(w))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if row.r0 is None or row.r1 is None or (row.h0, row.w0) != (row.h1, row.w1):
                    raise ValueError(f"page {row.page_id}: masks of {row.h0} x {row.w0} and {row.h1} x {row.w1}")
                p, g = runs(row.r0, row.h0, row.w0), runs(row.r1, row.h1, row.w1)
                if ignored is not None:
                    g[g == ignored] = classes
                if ratio is not None:
                    p, g = border(p, ratio), border(g, ratio)
                n = np.bincount((p.astype(np.int64) * (classes + 1) + g).ravel(), minlength=1)
                out += [(row.page_id, int(k // (classes + 1)), int(k % (classes + 1)), int(n[k])) for k in np.flatnonzero(n)]
            yield pd.DataFrame(out, columns=["page_id", "pred", "gt", "n"])

    return both.mapInPandas(run, f"page_id {kind}, pred int, gt int, n long")


def border_scores(of: DataFrame) -> DataFrame:
    """(cls, border_iou) in percent of the support of borders; null where neither side has one."""
    union = F.col("pos_gt") + F.col("pos_pred") - F.col("tp")
    return of.select("cls", F.when(union > 0, F.lit(100.0) * F.col("tp") / union).alias("border_iou"))


def compared(pred: DataFrame, truth: DataFrame, classes: int, ignored: int | None = None, ratio: float = 0.02) -> DataFrame:
    """cls, acc, iou, border_iou, least_iou and the totals miou, fwiou, macc, pacc of two sets of masks, a row a class: all of an evaluation."""
    scores = class_scores(support(confusion(mask_confusion(pred, truth, classes, ignored)), classes))
    edges = border_scores(support(confusion(mask_confusion(pred, truth, classes, ignored, ratio)), classes))
    each = scores.join(F.broadcast(edges), "cls").withColumn("least_iou", least_known(F.col("iou"), F.col("border_iou")))
    return each.crossJoin(F.broadcast(totals(scores))).drop("tp", "pos_gt", "pos_pred")


def compared_pages(pred: DataFrame, truth: DataFrame, classes: DataFrame, mode: str, width: int = 5, n_classes: int | None = None) -> DataFrame:
    """`compared` of two sets of page XML documents (page_id, xml), converted to masks in a mode; each page has the size that its truth tells."""
    from quirefold.operators import masks as M

    n = n_classes or classes.agg(F.max("class_id")).head()[0] + 1
    sides = [M.Layout.read(d, classes) for d in (pred, truth)]
    sizes = sides[1].pages.select("page_id", F.col("page_h").alias("h"), F.col("page_w").alias("w"))
    made = [M.converted(s, "sem_seg", mode, sizes, width) for s in sides]
    return compared(*made, n)


def above_half(logits: DataFrame, planes: int) -> DataFrame:
    """(keys, plane, pred) of rows with an array z of a logit per plane: 1 where its sigmoid is over one half, that is, z over 0."""
    keep = [c for c in logits.columns if c != "z"]
    return logits.select(*keep, F.posexplode(F.slice("z", 1, planes)).alias("plane", "_z")).select(*keep, "plane", (F.col("_z") > 0).cast("int").alias("pred"))


def in_order(left: DataFrame, right: DataFrame, path: str) -> DataFrame:
    """(left, right) of two sets of paths, paired by stem; an error if the sets differ or a stem stands twice."""
    from quirefold.functions import pagetext as T

    side = lambda d, n: d.groupBy(T.stem(F.col(path)).alias("stem")).agg(F.min(path).alias(n), F.count("*").alias(f"n_{n}"))
    both = side(left, "left").join(side(right, "right"), "stem", "full")
    told = F.format_string("no pair for %s", F.col("stem"))
    right_one = F.coalesce((F.col("n_left") == 1) & (F.col("n_right") == 1), F.lit(False))
    return both.select(F.when(right_one, F.col("left")).otherwise(F.raise_error(told)).alias("left"), "right")


def printed(metrics: DataFrame, decimals: int = 4) -> DataFrame:
    """Numbers as text with so many decimals; a null is "nan"."""
    numbers = {f.name for f in metrics.schema if f.dataType.simpleString() in ("double", "float")}
    return metrics.select(*[F.coalesce(F.format_string(f"%.{decimals}f", F.col(c)), F.lit("nan")).alias(c) if c in numbers else F.col(c) for c in metrics.columns])


def confidence(pages: DataFrame) -> DataFrame:
    """(mean, std, n) of the confidence of pages, std of the population; an error names a page that has none."""
    known = F.when(F.col("confidence").isNull(), F.raise_error(F.format_string("no confidence: %s", F.col("page_id").cast("string")))).otherwise(F.col("confidence"))
    return pages.select(known.alias("c")).agg(F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.count("*").alias("n"))
