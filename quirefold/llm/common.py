"""Shared helpers: tables, settled intermediates, checked broadcasts, native word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.sources.settled import settled as settle  # noqa: F401  the name that the operators use
from quirefold.sources.settled import shared_dir  # noqa: F401

#: ASCII white space of the word pattern [^\x20\x09-\x0D]+, without the blank itself.
WS_OTHER = "\t\n\x0b\x0c\r"

#: A settled table of at most this many rows and bytes may be broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame) -> DataFrame:
    """Mark a settled table for broadcast if its counted rows and estimated bytes are under the bounds; else leave the join to a shuffle."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) <= BROADCAST_BYTES and df.count() <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def spaced(text: Column, chars: str = WS_OTHER) -> Column:
    """Text (null: empty) with all ASCII white space, or these characters, as blanks.

    By one replacement per character: a search over bytes that gives the text itself back where there is none, while
    translate looks every character up.
    """
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in chars:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def without(text: Column, chars: str) -> Column:
    """Text without these characters."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ by JVM built-ins that need no regular expression."""
    return F.array_remove(F.split(spaced(text), " "), "")


def count_words(blanked: Column) -> Column:
    """Number of words of a text that has no white space but blanks, and none at its ends; cut into words only where blanks stand together."""
    single = F.octet_length(blanked) - F.octet_length(F.replace(blanked, F.lit(" "), F.lit(""))) + 1
    return F.when(F.octet_length(blanked) == 0, 0).when(F.instr(blanked, "  ") == 0, single).otherwise(F.size(F.array_remove(F.split(blanked, " "), "")))


def with_n_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """df and the number of words of a text column."""
    blank = F.trim(spaced(F.col(text))).alias("_blanked")
    return df.select("*", blank).select(*df.columns, count_words(F.col("_blanked")).cast("long").alias(name))


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The row as struct `_in`, and the named columns as `_<name>` (null if absent), so that no extra column can clash."""
    have = set(df.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in")
    return df.select(row, *[(F.col(f"`{c}`") if c in have else F.lit(None)).alias(f"_{c}") for c in needed])


def unpacked(df: DataFrame, like: DataFrame, *more: Column) -> DataFrame:
    """The columns of `like` out of `_in`, then more."""
    return df.select(*[F.col("_in").getField(c).alias(c) for c in like.columns], *more)
