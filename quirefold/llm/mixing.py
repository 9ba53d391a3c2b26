"""Mixing sources to target weights: rates from word totals, whole copies plus one hash-seeded Bernoulli copy.

A source's target is its share of budget * (all words) by weight; no target exceeds max_repeat times the source's
words, the excess going to the other sources by weight until none is above. That water level has a closed form: with
sources ascending by capacity / weight, a source is capped exactly if its capacity is within its share of what the
capped ones before it leave. A document is then taken floor(rate) times, and once more if a hash of seed and doc_id
falls below the fraction, so no document is taken more than max_repeat times (rounded up).

Nulls: a null text has no words; null is a source of its own, ranked last; a null doc_id draws as the string "null".
Rows with equal doc_id draw alike. A source without words has target 0 and rate 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm import common as C

#: Bits of the md5 that make a draw; exact in a double.
DRAW_BITS = 52


def source_targets(sizes: DataFrame, weights=(3, 1, 2), budget=(3, 2), max_repeat: int = 2) -> DataFrame:
    """source, source_size, target from rows (source, size); weights repeat over the sources by code point, null last.

    budget is a fraction of all words, as (numerator, denominator); all comparisons are on whole numbers. The ranking
    windows run over one row per source (an aggregate), not over documents.
    """
    up, down = budget
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    everything = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = per.withColumn("w", weight.cast("long")).withColumn("ratio", F.col("s").cast("double") / F.col("w"))
    level = (
        ranked.withColumn("c", F.col("s") * max_repeat)
        .withColumn("c_before", F.coalesce(F.sum("c").over(before), F.lit(0)).cast("long"))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)).cast("long"))
        .withColumn("all_s", F.sum("s").over(all_rows))
        .withColumn("all_w", F.sum("w").over(all_rows))
        .withColumn("capped", F.col("c").cast("decimal(20,0)") * down * (F.col("all_w") - F.col("w_before")).cast("decimal(10,0)") <= F.col("w").cast("decimal(10,0)") * (big("all_s") * up - big("c_before") * down).cast("decimal(24,0)"))
    )
    left = F.col("all_s") * up - F.coalesce(F.sum(F.when(F.col("capped"), F.col("c"))).over(all_rows), F.lit(0)) * down
    shared = F.col("all_w") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(all_rows), F.lit(0))
    target = F.when(F.col("capped"), F.col("c").cast("double")).otherwise(F.col("w").cast("double") * left.cast("double") / (shared * down).cast("double"))
    return level.select("source", F.col("s").alias("source_size"), target.alias("target"))


def copies(doc_id, size_target, size_source, seed: str):
    """How often a document is taken: floor(rate), and one more with the fraction's probability."""
    rate = F.when(size_source > 0, size_target / size_source).otherwise(F.lit(0.0))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long").cast("double") / float(1 << DRAW_BITS)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """The rows packed in `_in`, with size, source_size, target and n_copies. The table of sources is settled, and broadcast only if checked small."""
    sized = C.with_n_words(C.packed(docs, "doc_id", "text", "source"), "_text", "_size")
    per = C.settle(source_targets(sized.select(F.col("_source").alias("source"), F.col("_size").alias("size")), **targets), "sources")
    per = per.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    joined = sized.join(C.small(per), F.col("_source").eqNullSafe(F.col("_s")))
    return joined.withColumn("_copies", copies(F.col("_doc_id"), F.col("_target"), F.col("_source_size"), seed))


def mix(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """The documents as often as taken: their columns (own `copy_no` is replaced) and copy_no from 1."""
    taken = plan_mix(docs, seed, **targets).filter("_copies > 0")
    out = taken.withColumn("_no", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    keep = docs.drop("copy_no")
    return C.unpacked(out, keep, F.col("_no").alias("copy_no"))
