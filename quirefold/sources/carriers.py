"""Page tables derived by whole-number arithmetic from star-schema tables, to run the operators on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import pagetext


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, w, h of an order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), (F.lit(1000) + F.col("o_custkey") % 1000).alias("w"), (F.lit(1400) + F.col("o_orderkey") % 600).alias("h"))


def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, seq, x, y, w, h, rtype of an order's line."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kind = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_returnflag") == "A", "marginalia").when(F.col("l_returnflag") == "N", "paragraph").when(F.col("l_returnflag") == "R", "heading")
    return line.select(
        F.col("l_orderkey").alias("page_id"), F.row_number().over(w).cast("long").alias("seq"), (F.col("l_partkey") % 800).alias("x"), ((F.col("l_suppkey") * 37 + F.col("l_linenumber") * 113) % 1200).alias("y"),
        (F.lit(20) + F.col("l_quantity").cast("int")).cast("int").alias("w"), (F.lit(10) + F.col("l_linenumber") * 5).cast("int").alias("h"), kind.alias("rtype"),
    )


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like region, without the number of the line on its page and so without a shuffle; line carries what orders lines."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("line"), (F.col("l_partkey") % 800).alias("x"), ((F.col("l_suppkey") * 37 + F.col("l_linenumber") * 113) % 1200).alias("y"),
        (F.lit(20) + F.col("l_quantity").cast("int")).cast("int").alias("w"), (F.lit(10) + F.col("l_linenumber") * 5).cast("int").alias("h"),
    )


def custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, seq, custom."""
    r = region(spark, sf_dir)
    text = F.concat(pagetext.order_custom(F.col("seq")), F.when(F.col("rtype").isNull(), "").otherwise(F.concat(F.lit(" "), pagetext.type_custom(F.col("rtype")))))
    return r.select("page_id", "seq", text.alias("custom"))


def polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, i, x, y: the points of a user's line, by time."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 60)
    return e.select("user_id", F.row_number().over(w).cast("long").alias("i"), x.cast("long").alias("x"), F.floor("value").cast("long").alias("y"))


def request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, queued_at, process_start, process_end, status."""
    e = table(spark, sf_dir, "events")
    queued = F.col("ts").cast("timestamp_ntz")
    start = queued + F.make_dt_interval(secs=F.col("event_id") % 50)
    end = start + F.make_dt_interval(secs=F.col("event_id") % 300)
    return e.select("event_id", "user_id", queued.alias("queued_at"), start.alias("process_start"), end.alias("process_end"), F.col("event_type").alias("status"))
