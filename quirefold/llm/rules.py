"""Quality rules with adaptive thresholds, from mergeable quantile sketches per language and source.

Each document is measured by built-in functions. Documents that pass the base rules feed log-linear histogram sketches
of whole numbers (32 buckets per power of two, so a quantile is off by at most 1/32): a sketch is rows (bucket, n), and
two sketches merge by adding n. Sketches of (language, source) with fewer than min_docs documents give way to their
merge over the language, and that to the merge over everything. Fences q75 + k * max(q75 - q25, floor) (and below
q25 for the word length) take the place of fixed cutoffs; the fences, a few numbers per group, are joined to the
documents.

Nulls: a null text has no words and fails the base rules; null is a language or source of its own. Rows are judged one
by one, so repeated rows fare alike; ties fall on the keeping side (only beyond a fence is out). Two windows of words
are held equal if their 64-bit hashes are. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm import common as C

SYMBOLS = "#*$%&|<>"

#: metric -> (floor of the spread, whether a lower fence holds too). Densities are per 10,000, word length in 1/100.
METRICS = {
    "symbols": (200, False),
    "dup_lines": (2000, False),
    "repeats": (1000, False),
    "shouts": (200, False),
    "word_length": (60, True),
}
MIN_DOCS, FENCE = 100, 3


def bucket(v: Column) -> Column:
    """Log-linear bucket of a whole number >= 0: itself below 64, else 32 per power of two."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (e * 32 + F.call_function("shiftright", v, e)).cast("int")


def bucket_top(b: Column) -> Column:
    """Largest number of the bucket."""
    e = F.greatest(F.floor((b - 32) / 32), F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - e * 32 + 1).cast("long"), e) - 1


def measured(df: DataFrame, keep: list[str]) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the metrics need, all prefixed `_`."""
    text = F.coalesce(F.col("_text").cast("string"), F.lit(""))
    without = lambda c, chars: F.length(C.without(c, chars))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(C.spaced(x))) > 0)
    a = df.select(*keep, text.alias("_t"), C.words(text).alias("_w"), lines.alias("_l"))
    n = F.size("_w")
    part = lambda i: F.slice("_w", i, F.greatest(n - 2, F.lit(0)))
    hashed = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    b = a.select(
        *keep,
        n.cast("long").alias("_n_words"),
        without(F.col("_t"), " " + C.WS_OTHER).cast("long").alias("_word_chars"),
        (F.length("_t") - without(F.col("_t"), SYMBOLS)).cast("long").alias("_n_symbols"),
        (F.length("_t") - without(F.col("_t"), "!")).cast("long").alias("_n_shouts"),
        F.size("_l").cast("long").alias("_n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("_n_dup_lines"),
        hashed.alias("_h"),
    )
    done = [c for c in b.columns if c != "_h"]
    # Only texts with some window twice are sorted; windows and their places are sorted together, so equals are neighbours.
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    c = b.select(*done, F.when(twice, F.sort_array(F.transform("_h", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))).alias("_s"))
    m = F.size("_s")
    pairs = F.arrays_zip(F.slice("_s", 1, m - 1).alias("x"), F.slice("_s", 2, m - 1).alias("y"))
    same = F.filter(pairs, lambda p: p["x"]["v"] == p["y"]["v"])
    places = F.sort_array(F.array_distinct(F.concat(F.transform(same, lambda p: p["x"]["i"]), F.transform(same, lambda p: p["y"]["i"]))))
    d = c.select(*done, F.when(F.col("_s").isNotNull(), places).alias("_p"))
    k = F.size("_p")
    gaps = F.zip_with(F.slice("_p", 1, k - 1), F.slice("_p", 2, k - 1), lambda x, y: F.least(y - x, F.lit(3)))
    covered = F.when(F.col("_p").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x))
    return d.select(*done, covered.cast("long").alias("_n_repeat_words"))


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("_n_words") < min_words) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * repeat_percent)


def metrics() -> dict[str, Column]:
    per = lambda a, b, scale: F.expr(f"({a} * {scale}) div greatest({b}, 1)")
    return {
        "symbols": per("_n_symbols", "_word_chars", 10_000),
        "dup_lines": per("_n_dup_lines", "_n_lines", 10_000),
        "repeats": per("_n_repeat_words", "_n_words", 10_000),
        "shouts": per("_n_shouts", "_word_chars", 10_000),
        "word_length": per("_word_chars", "_n_words", 100),
    }


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of the documents that passed the base rules; partial sums go before the shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics().items()])).alias("m")
    good = rows.filter(~base_failed())
    return good.select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), each).groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, *keys: str, prefix: str) -> DataFrame:
    """One row per group: `<prefix>n`, and `<prefix><metric>_lo/_hi`. The window runs over the buckets of one sketch."""
    w = Window.partitionBy(*keys, "metric")
    runs = sketches.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, bucket_top(F.col("bucket"))))
    quart = runs.groupBy(*keys, "metric").agg(at(25).alias("q25"), at(75).alias("q75"), F.max("total").alias("n"))
    out = [F.max("n").alias(f"{prefix}n")]
    for name, (floor, lower) in METRICS.items():
        spread = F.greatest(F.col("q75") - F.col("q25"), F.lit(floor)) * FENCE
        of = F.col("metric") == name
        out.append(F.max(F.when(of, F.col("q75") + spread)).alias(f"{prefix}{name}_hi"))
        if lower:
            out.append(F.max(F.when(of, F.col("q25") - spread)).alias(f"{prefix}{name}_lo"))
    return quart.groupBy(*keys).agg(*out)


def judged(docs: DataFrame, carry: bool, min_docs: int = MIN_DOCS) -> DataFrame:
    """Measures, base verdict and verdict of every row, all prefixed `_`; with carry also the packed row `_in`.

    The measured rows are settled once and read twice: for the sketches, and for the filter.
    """
    keep = ["_doc_id", "_lang", "_source"] + ["_in"] * carry
    rows = C.settle(measured(C.packed(docs, "doc_id", "text", "lang", "source"), keep), "measured")
    per_source = C.settle(sketch(rows), "sketches")
    per_lang = merged(per_source, "lang")
    own = fences(per_source, "lang", "source", prefix="s_")
    lang = fences(per_lang, "lang", prefix="l_").withColumnRenamed("lang", "l_lang")
    every = fences(merged(per_lang), prefix="a_")
    table = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").crossJoin(F.broadcast(every))  # one row
    names = [c[2:] for c in own.columns if c.startswith("s_") and c != "s_n"]
    pick = lambda c: F.when(F.col("s_n") >= min_docs, F.col(f"s_{c}")).when(F.col("l_n") >= min_docs, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    table = C.settle(table.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *[pick(c).alias(f"f_{c}") for c in names]), "fences")
    joined = rows.join(C.small(table), F.col("_lang").eqNullSafe(F.col("f_lang")) & F.col("_source").eqNullSafe(F.col("f_source")), "left")
    inside = F.lit(True)
    for name, value in metrics().items():
        inside &= value <= F.col(f"f_{name}_hi")
        if METRICS[name][1]:
            inside &= value >= F.col(f"f_{name}_lo")
    failed = base_failed()
    return joined.withColumn("_base_failed", failed).withColumn("_kept", ~failed & F.coalesce(inside, F.lit(True)))


def rated(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document."""
    of = judged(docs, carry=False, **options)
    return of.select(*[F.col(f"_{c}").alias(c) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def filtered(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return C.unpacked(judged(docs, carry=True, **options).filter("_kept"), docs)
