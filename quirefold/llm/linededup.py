"""Line dedup: content-defined chunks of lines, found again anywhere, are removed after a byte comparison.

Lines with no word are passed over (and stay). From every line a chunk runs forward, and one backward, to where a
rolling hash over the hashes of the last two lines (or the two first, backward) falls on 0 modulo a divisor, once the
chunk has two lines and MIN_WORDS words; at the latest at MAX_WORDS words or MAX_LINES lines. The end thus depends on
the chunk's own lines alone, so a passage gives the same chunks wherever it stands. Chunks opened at every line, in
both directions, cover a repeated run to its first and last line; any run of MAX_WORDS words or more holds one. A
chunk of one line alone needs MAX_WORDS words.

Of equal chunks the first by (doc_id, text hash, line) stays; a later one's lines are removed if its bytes equal the
first one's. Every removed line has an equal one at an earlier place, so one copy of all text stays.

Nulls: a null text stays null; a null doc_id sorts first. Rows with equal doc_id and text are one document and fare
alike; the same passage twice in one document is a repeat too. An emptied document is left with text '' by `rewritten`
and dropped by `filtered`. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm import common as C

MIN_WORDS, MAX_WORDS, MAX_LINES, DIVISOR = 20, 40, 8, 4


def _lines(text: str, blanked: str) -> Column:
    """Structs of the lines with words: p place among all lines, h hash, d part of another hash, w number of words. blanked: the text with blanks for other white space but line ends."""
    # three hex digits of each line's md5: all of its hash that the rolling hash modulo DIVISOR depends on
    cut = F.transform(F.split(text, "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), F.substring(F.md5(x.cast("binary")), 13, 3).alias("m")))
    both = F.arrays_zip(cut.alias("x"), F.transform(F.split(blanked, "\n"), lambda y: F.trim(y)).alias("y"))

    def number(m: Column) -> Column:
        digit = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring(m, k, 1)) - 1
        return digit(1) * 256 + digit(2) * 16 + digit(3)

    return F.filter(F.transform(both, lambda b, i: F.struct(i.alias("p"), b["x"]["h"].alias("h"), number(b["x"]["m"]).alias("d"), C.count_words(b["y"]).alias("w"))), lambda x: x["w"] > 0)


def _has_word(line: Column) -> Column:
    return F.length(F.trim(C.spaced(line))) > 0


def _chunks(lines: str, forward: bool) -> Column:
    """From each line of the array column, the chunk it opens as struct (f, t, h); null where the text ends before it closes."""
    n = F.size(lines)
    if forward:
        look = F.arrays_zip(*[F.slice(lines, 1 + k, F.greatest(n - k, F.lit(0))).alias(f"s{k}") for k in range(MAX_LINES)])
    else:
        # Reversed, the same is done from each line towards the first.
        look = F.arrays_zip(*[F.slice(F.reverse(lines), 1 + k, F.greatest(n - k, F.lit(0))).alias(f"s{k}") for k in range(MAX_LINES)])

    def one(x: Column) -> Column:
        out = F.lit(None).cast("int")
        total = [x["s0"]["w"]]
        for k in range(1, MAX_LINES):
            total.append(total[-1] + x[f"s{k}"]["w"])
        for k in reversed(range(MAX_LINES)):
            close = total[k] >= MAX_WORDS
            if k:
                roll = (x[f"s{k - 1}"]["d"].bitwiseXOR(F.call_function("shiftright", x[f"s{k - 1}"]["d"], F.lit(7)))).bitwiseXOR(x[f"s{k}"]["d"])
                close = close | ((total[k] >= MIN_WORDS) & (F.pmod(roll, F.lit(DIVISOR)) == 0))
            if k == MAX_LINES - 1:
                close = total[k].isNotNull()
            out = F.when(close, F.lit(k)).otherwise(out)
        return out

    closed = F.transform(look, lambda x: F.struct(x.alias("x"), one(x).alias("k")))
    closed = F.filter(closed, lambda y: y["k"].isNotNull())

    def made(y: Column) -> Column:
        x, k = y["x"], y["k"]
        parts = F.slice(F.array(*[x[f"s{i}"]["h"] for i in range(MAX_LINES)]), F.lit(1), k + 1)
        far = F.element_at(F.array(*[x[f"s{i}"]["p"] for i in range(MAX_LINES)]), k + 1)
        near = x["s0"]["p"]
        if not forward:
            parts, near, far = F.reverse(parts), far, near
        return F.struct(near.alias("f"), far.alias("t"), F.xxhash64(parts).alias("h"))

    return F.transform(closed, made)


def chunked(docs: DataFrame) -> DataFrame:
    """(doc_id, k, f, t, h) of every chunk; k is a hash of doc_id and text, f and t are line numbers, both included."""
    blanked = docs.select("doc_id", "k", "text", C.spaced(F.col("text"), C.WS_OTHER.replace("\n", "")).alias("blanked"))
    a = blanked.select("doc_id", "k", _lines("text", "blanked").alias("ls"))
    b = a.select("doc_id", "k", F.sort_array(F.concat(_chunks("ls", True), _chunks("ls", False))).alias("cs"))
    # A chunk found in both directions is next to itself once sorted (array_distinct would compare all structs with all).
    before = F.concat(F.array(F.lit(None).cast("struct<f:int,t:int,h:bigint>")), F.slice("cs", 1, F.greatest(F.size("cs") - 1, F.lit(0))))
    once = F.filter(F.arrays_zip(F.col("cs").alias("x"), before.alias("y")), lambda b: b["x"].isNotNull() & ~b["x"].eqNullSafe(b["y"]))
    return b.select("doc_id", "k", F.explode(once).alias("c")).select("doc_id", "k", "c.x.f", "c.x.t", "c.x.h")


def _without_covered(spans: Column) -> Column:
    """Of spans sorted by (f, t) those that are not within their neighbour: the one before reaches as far, or the next starts alike and reaches farther."""
    n = F.size(spans)
    before = F.concat(F.array(F.lit(None).cast("struct<f:int,t:int,h:bigint>")), F.slice(spans, 1, F.greatest(n - 1, F.lit(0))))
    both = F.arrays_zip(spans.alias("x"), before.alias("y"), F.slice(spans, 2, F.greatest(n - 1, F.lit(0))).alias("z"))
    alone = F.filter(both, lambda b: ~F.coalesce(b["y"]["t"] >= b["x"]["t"], F.lit(False)) & ~F.coalesce(b["z"]["f"] == b["x"]["f"], F.lit(False)))
    return F.transform(alone, lambda b: b["x"])


def repeats(docs: DataFrame) -> DataFrame:
    """(k, spans): the line spans to remove of each document that has some. docs: doc_id, text, k."""
    chunks = C.settle(chunked(docs), "chunks")
    first = chunks.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "k", "f", "t")).alias("m")).filter("n > 1")
    first = C.settle(first.select("h", "m.k", "m.f", "m.t"), "first")
    again = chunks.join(first.select("h", F.col("k").alias("k1"), F.col("f").alias("f1")), "h").filter("k <> k1 OR f <> f1")
    # the repeats of one document, sorted: what is within another needs no comparison of its own
    per_doc = again.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("f", "t", "h"))).alias("cs"))
    chosen = C.settle(per_doc.select("k", F.explode(_without_covered(F.col("cs"))).alias("c")).select("k", "c.f", "c.t", "c.h", F.lit(False).alias("first")), "chosen")
    wanted = chosen.union(first.join(chosen.select("h").distinct(), "h", "left_semi").select("k", "f", "t", "h", F.lit(True)))
    spans = C.settle(wanted.groupBy("k").agg(F.collect_set(F.struct("f", "t", "h", "first")).alias("cs")), "spans")
    # The spans grow with the corpus: the texts are dealt by k at every size, and nothing is broadcast.
    held = docs.select("k", "text").join(spans.hint("merge"), "k").select("k", F.split("text", "\n").alias("ls"), F.explode("cs").alias("c"))
    words_only = F.filter(F.slice("ls", F.col("c.f") + 1, F.col("c.t") - F.col("c.f") + 1), _has_word)
    pieces = held.select("k", "c.*", F.array_join(words_only, "\n").alias("b"))
    same = pieces.filter("NOT first").join(pieces.filter("first").select("h", F.col("b").alias("b1")), "h").filter("b = b1")
    return C.settle(same.groupBy("k").agg(F.collect_set(F.struct("f", "t")).alias("spans")), "same")


def rewritten(docs: DataFrame) -> DataFrame:
    """The packed rows, with the text left as `_new`, and `_lines` and `_removed`, the numbers of lines with words before and removed."""
    rows = C.packed(docs, "doc_id", "text").withColumn("_text", F.col("_text").cast("string")).withColumn("_k", F.xxhash64("_doc_id", "_text"))
    spans = repeats(rows.select(F.col("_doc_id").alias("doc_id"), F.col("_text").alias("text"), F.col("_k").alias("k")))
    joined = rows.join(spans.select(F.col("k").alias("_j"), "spans").hint("merge"), F.col("_k") == F.col("_j"), "left")
    lines = joined.select("_in", "_doc_id", "_text", "spans", F.split("_text", "\n").alias("_ls"))
    kept = ["_in", "_doc_id", "_text", "_ls"]
    with_words = F.filter(F.transform("_ls", lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull())
    gone = F.array_intersect(with_words, F.flatten(F.transform("spans", lambda s: F.sequence(s["f"], s["t"]))))
    marked = lines.select(*kept, F.coalesce(F.size(with_words), F.lit(0)).alias("_n"), F.when(F.col("spans").isNotNull(), gone).alias("_gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_ls") - 1), F.col("_gone"))
    placed = marked.select(*kept, "_n", F.when(F.col("_gone").isNotNull(), F.size("_gone")).otherwise(0).alias("_m"), F.when(F.col("_gone").isNotNull(), left).alias("_left"))
    new = F.array_join(F.transform("_left", lambda i: F.element_at(F.col("_ls"), i + 1)), "\n")
    return placed.select("_in", "_doc_id", "_text", F.coalesce(new, F.col("_text")).alias("_new"), F.col("_n").cast("long").alias("_lines"), F.col("_m").cast("long").alias("_removed"))


def rated(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines and n_removed (lines with words), and the text left, of every row."""
    return rewritten(docs).select(F.col("_doc_id").alias("doc_id"), F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_new").alias("text"))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; those of which nothing is left go. n_chars follows the text where it is a column."""
    of = rewritten(docs).filter("_removed = 0 OR _removed < _lines")
    new = {"text": F.col("_new"), "n_chars": F.when(F.col("_removed") > 0, F.length("_new").cast("long"))}
    field = lambda c: F.col("_in").getField(c)
    out = [F.coalesce(new[c].cast(t), field(c)).alias(c) if c in new else field(c).alias(c) for c, t in docs.dtypes]
    return of.select(*out)
