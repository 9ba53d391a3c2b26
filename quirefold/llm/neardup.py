"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct 5-word shingles (fewer words: the whole sequence; none: empty, linked with nothing).
Equal sets are one class, held once. One hash per shingle serves all bins: the top bits name the bin, the least hash in
a bin is its value, and an empty bin takes the value of the first non-empty one in a fixed pseudo-random sequence of
its own. Bands of 4 bins are buckets, each split by size so that two sizes that allow a link share a part. Within a part
each class is paired with one of them, the centre (a star): first with the centre it shares most bands with, then with
the others that are still in another component. Pairs are confirmed on full sets, and links make components by repeated
contraction. Star pairs are at most two a band and class, whatever the size of a group.

With 32 bands of 4, two sets of Jaccard 0.75 share no bucket with probability (1 - 0.75^4)^32 = 5e-6. A link may also
hide behind a centre that is not like its ends, or whose size differs. So in each part that still holds several
components the members outside the largest one are held against all others: by their whole sets (32-bit values) up to
SAMPLE shingles, by samples of about so many beyond. A part is cut into pieces of FULL members, each held against the
others FULL at a time, so that no size of a part is too large. Where the others are more than FULL, the part's members
are first dealt by the first shingles of their full sets, a quarter of each, in one order of all, the rarest first: two
sets of Jaccard 0.75 always share one of these, so no link is parted. Of what is alike a piece gives the links that make
a forest of its components, the most alike first; pairs of samples within four standard errors of 0.75 are given all.
These too are confirmed on full sets.

Nulls: a null text is empty; a null doc_id is linked with nothing and kept. Rows of one doc_id are one document: their
sets each may link it, and they fare alike. The least doc_id of a component stays (ties cannot be). Shingles are held
equal if their 64-bit hashes are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import bytewords as B
from quirefold.llm import common as C

BINS, ROWS, K, PERCENT = 128, 4, 5, 75
BANDS = BINS // ROWS
#: Values of a set that stand for it in comparisons; members of a piece of a bucket.
SAMPLE, FULL = 512, 1024
_SHIFT = np.uint64(64 - 7)


def _donors(seed: int = 11) -> np.ndarray:
    """For each bin a sequence of bins to take from: 2-universal draws, then all bins, so that one is found."""
    rng = np.random.default_rng(seed)
    draws = rng.integers(0, BINS, (BINS, 3 * BINS))
    return np.hstack([draws, np.array([rng.permutation(BINS) for _ in range(BINS)])])


def densified(sets: list[np.ndarray], donors: np.ndarray) -> np.ndarray:
    """One row of bin values for each sorted, non-empty set."""
    out = np.empty((len(sets), BINS), np.uint64)
    for r, u in enumerate(sets):
        b = (u >> _SHIFT).astype(np.int64)
        new = np.flatnonzero(np.diff(b, prepend=-1))
        have = np.zeros(BINS, bool)
        have[b[new]] = True
        out[r, b[new]] = u[new]
        empty = np.flatnonzero(~have)
        step = 0
        while len(empty):
            d = donors[empty, step]
            ok = have[d]
            out[r, empty[ok]] = out[r, d[ok]]
            empty, step = empty[~ok], step + 1
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """Hash of each band, its number included."""
    v = values.reshape(len(values), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), v.shape[:2])
    for r in range(ROWS):
        h = B.mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, :, r])
    return h


def sorted_sets(texts: pa.Array):
    """The distinct shingles of each text, sorted, in order of the rows."""
    data, at = B.arrow_bytes(texts)
    for i, j in B.each_group(at):
        h, row = B.hashed_words(data, at, i, j)
        sh, first = B.shingles(h, row, j - i, K)
        for r in range(j - i):
            s = np.sort(sh[first[r] : first[r + 1]])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def set_hash(u: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    a = B.mix(u ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64)
    b = B.mix(u + np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _signed(of: DataFrame) -> DataFrame:
    """(doc_id, n, c, c2, bands) of rows (doc_id, text)."""
    schema = "doc_id long, n long, c long, c2 long, bands array<long>"
    donors = _donors()

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            todo: list = []
            place = 0

            def flush():
                full = [k for k, s in enumerate(todo) if len(s)]
                bands = [None] * len(todo)
                if full:
                    keys = band_keys(densified([todo[k] for k in full], donors)).view(np.int64)
                    for k, row in zip(full, keys):
                        bands[k] = row
                hashes = [set_hash(s) if len(s) else (None, None) for s in todo]
                return pa.RecordBatch.from_arrays([ids.slice(place, len(todo)), pa.array([len(s) for s in todo], pa.int64()), pa.array([a for a, _ in hashes], pa.int64()), pa.array([b for _, b in hashes], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "c", "c2", "bands"])

            held = 0
            for s in sorted_sets(batch.column(1)):
                todo.append(s)
                held += len(s)
                if len(todo) >= 1024 or held > 1 << 20:
                    yield flush()
                    place, todo, held = place + len(todo), [], 0
            if todo:
                yield flush()

    return of.mapInArrow(run, schema)


def _rate(t: int) -> int:
    """Samples of the part t are the values below this: whole sets up to SAMPLE, else about so many of each."""
    return min(1 << 32, int((1 << 32) * SAMPLE / (100 / PERCENT) ** t))


def _sets(of: DataFrame) -> DataFrame:
    """(c, s, v) of rows (doc_id, c, text): the full set of each row whose text is of class c, and its sorted 32-bit values below the rate of its size."""

    def run(batches):
        for batch in batches:
            cs, ss, vs, held = [], [], [], 0

            def flush():
                return pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(ss, pa.list_(pa.int64())), pa.array(vs, pa.binary())], names=["c", "s", "v"])

            for w, s in zip(batch.column(1).to_pylist(), sorted_sets(batch.column(2))):
                if len(s) and set_hash(s)[0] == w:
                    v = np.sort(B.mix(s) >> np.uint64(32))
                    v = v[v < _rate(math.floor(math.log(len(s)) / math.log(100 / PERCENT)))]
                    cs.append(w), ss.append(s.view(np.int64)), vs.append(v.astype(np.uint32).tobytes())
                    held += len(s)
                if held > 1 << 20:
                    yield flush()
                    cs, ss, vs, held = [], [], [], 0
            if cs:
                yield flush()

    return of.mapInArrow(run, "c long, s array<long>, v binary")


def contracted(edges: DataFrame) -> DataFrame:
    """(v, root) for every v of an edge (a, b): root is the least number of its component.

    Each round, every vertex and its old root take the least root next to them, and paths are halved; the labels are
    settled each time, so a round's plan stays small and a lost executor costs one round. Minima are partial before the
    shuffle; labels are broadcast only while they are checked small.
    """
    both = C.settle(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a")).distinct(), "edges")
    label = both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("u", "v").alias("root"))
    label = C.settle(label, "labels")
    while True:
        at = C.small(label)
        near = both.join(at.select(F.col("v").alias("u"), F.col("root").alias("r")), "u").select("v", "r").union(label.select("v", "root"))
        least = near.groupBy("v").agg(F.min("r").alias("r"))
        # what a vertex has learned, its old root learns too, so that whole trees join at once
        hooked = least.join(at, "v").select(F.col("root").alias("v"), "r").union(least).groupBy("v").agg(F.min("r").alias("r"))
        hooked = C.settle(hooked, "hooked")
        new = hooked.join(C.small(hooked.select(F.col("v").alias("r"), F.col("r").alias("rr"))), "r").select("v", F.col("rr").alias("root"))
        new = C.settle(new.join(at.withColumnRenamed("root", "old"), "v"), "labels")
        moved = new.filter("old <> root").limit(1).count()
        label = new.select("v", "root")
        if not moved:
            return label


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components (v, root) once more links (a, b) are there: only what these touch is contracted, root by root."""
    if not links.limit(1).count():
        return label
    ends = links.select(F.col("a").alias("v")).union(links.select("b")).distinct()
    base = label.union(ends.join(label, "v", "left_anti").select("v", F.col("v").alias("root")))
    at = ends.join(base, "v")
    root = lambda x: at.select(F.col("v").alias(x), F.col("root").alias(f"root_{x}"))
    upper = contracted(links.join(root("a"), "a").join(root("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    upper = upper.select(F.col("v").alias("root"), F.col("root").alias("top"))
    return C.settle(base.join(upper, "root", "left").select("v", F.coalesce("top", "root").alias("root")), "base")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes whose full sets are alike. sets: (c, s) of every class in a pair."""
    one = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
    two = one.join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return two.filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * PERCENT).select("a", "b")


def _fits(a: str, b: str):
    """Whether two sizes allow a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _crowded(classes: DataFrame) -> DataFrame:
    """(bucket, t, c, n, b, nb) of every class in each part of a bucket that it shares, with the part's centre b, the least c, and its size.

    A class of size class s, the whole part of log n to the base 100 / PERCENT, is in the parts t = s and s + 1, so that
    two sizes that allow a link share a part.
    """
    members = classes.select(F.explode("bands").alias("band"), "c", "n")
    shared = C.settle(members.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1").select("band"), "shared")
    s = F.floor(F.log("n") / math.log(100 / PERCENT)).cast("int")
    parts = members.join(shared, "band").select("band", F.explode(F.array(s, s + 1)).alias("t"), "c", "n")
    parts = C.settle(parts.select(F.xxhash64("band", "t").alias("bucket"), "t", "c", "n"), "parts")
    centre = parts.groupBy("bucket").agg(F.min(F.struct("c", "n")).alias("m"), F.count("*").alias("k")).filter("k > 1")
    return C.settle(parts.join(centre.select("bucket", F.col("m.c").alias("b"), F.col("m.n").alias("nb")), "bucket"), "crowd")


def _held_sets(crowd: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(c, s, v) of every class in the crowd, once: the texts are shuffled one time, for all comparisons to come."""
    need = crowd.select("c").distinct().join(classes.select("c", "doc_id"), "c").select("doc_id", "c")
    sets = C.settle(_sets(docs.join(need, "doc_id").select("doc_id", "c", "text")), "sets")
    if sets.groupBy("c").count().filter("count > 1").limit(1).count():  # repeated rows
        sets = C.settle(sets.dropDuplicates(["c"]), "sets")
    return sets


def alike(c: np.ndarray, n: np.ndarray, root: np.ndarray, most: np.ndarray, own: np.ndarray, t: int, samples: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of one piece's members in different components that may be links, by samples.

    Members outside the part's largest component (not `most`; of these the ones that are the piece's to hold) are held
    against those the piece owns. Pairs that are alike
    for sure (whole sets, or by four standard errors) come as a forest over the components, the most alike first; those
    within four standard errors come all, unless the forest joins their components.
    """
    whole = _rate(t) == 1 << 32
    values = [np.frombuffer(v, np.uint32) for v in samples]
    if not whole:
        values = [v[v < _rate(t)] for v in values]
    size = np.array([len(v) for v in values])
    _, at = np.unique(np.concatenate(values), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(at.max(initial=0) + 1, np.int64)
    sure, maybe = [], []
    for i in np.flatnonzero(~most):
        mine = at[begin[i] : begin[i + 1]]
        mark[mine] = 1
        total = np.concatenate(([0], np.cumsum(mark[at])))
        mark[mine] = 0
        both = total[begin[1:]] - total[begin[:-1]]
        union = np.maximum(size[i] + size - both, 1)
        slack = 0 if whole else 4 * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / union)
        near = own & (root != root[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * PERCENT)
        good = near & (both >= (PERCENT / 100 + slack) * union - 1e-9)
        if good.any():
            j = np.flatnonzero(good)
            j = j[np.lexsort((-both[j] / union[j], root[j]))]
            for k in j[np.concatenate(([True], root[j][1:] != root[j][:-1]))]:  # of each component the most alike
                sure.append((-both[k] / union[k], int(min(c[i], c[k])), int(max(c[i], c[k])), int(root[i]), int(root[k])))
        if not whole:
            for k in np.flatnonzero(near & ~good & (both >= (PERCENT / 100 - slack) * union)):
                maybe.append((int(min(c[i], c[k])), int(max(c[i], c[k])), int(root[i]), int(root[k])))
    over: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := over.setdefault(v, v)) != v:
            over[v] = v = over[up]
        return v

    out = set()
    for _, a, b, x, y in sorted(sure):
        if (x := find(x)) != (y := find(y)):
            over[x] = y
            out.add((a, b))
    return sorted(out | {(a, b) for a, b, x, y in maybe if find(x) != find(y)})


def _compared(parts: DataFrame) -> DataFrame:
    """(a, b) of rows (bucket, t, c, n, root, most, own, v): of each bucket the pairs that may be links."""

    def run(batches):
        held: list[tuple] = []

        def found():
            _, t, c, n, root, most, own, v = zip(*held)
            pairs = alike(np.array(c), np.array(n), np.array(root), np.array(most), np.array(own), t[0], list(v))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if held and row[0] != held[0][0]:
                    yield found()
                    held = []
                held.append(row)
        if held:
            yield found()

    sorted_parts = parts.select("bucket", "t", "c", "n", "root", "most", "own", "v").repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return sorted_parts.mapInArrow(run, "a long, b long").distinct()


def _first(of: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, x) of classes (c): the shingles x that come first in c's full set, the rarest in these classes before others, without those that one class alone has.

    Two sets that share at least PERCENT of their union share one of the first n - ceil(n * PERCENT / 100) + 1 of each.
    """
    each = C.settle(of.join(sets.select("c", "s"), "c").select("c", F.explode("s").alias("x")), "shingles")
    often = each.groupBy("x").agg(F.count("*").alias("f"))
    in_order = each.join(often, "x").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("o"))
    first = F.slice("o", F.lit(1), F.expr(f"cast(size(o) * {100 - PERCENT} div 100 + 1 as int)"))
    return in_order.select("c", F.explode(F.filter(first, lambda y: y["f"] > 1)).alias("y")).select("c", "y.x")


def _open(members: DataFrame, least: int) -> DataFrame:
    """Rows (bucket, t, c, n, root) of buckets with several components and at least so many members, with k, the number of these, others, those outside the largest component, and major, that component."""
    each = members.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    of = each.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("k"), F.count("*").alias("roots"))
    of = of.filter((F.col("roots") > 1) & (F.col("k") >= least)).select("bucket", "k", (F.col("k") - F.col("m.k")).alias("others"), F.col("m.root").alias("major"))
    return C.settle(members.join(of, "bucket"), "open")


def _dealt(parts: DataFrame) -> DataFrame:
    """(bucket, t, c, n, root, most, own) of the pieces of buckets: each member is owned once for every FULL of the others, which are held against all."""
    pieces, sides = F.ceil(F.col("k") / FULL), F.ceil(F.col("others") / FULL)
    other = F.col("root") != F.col("major")
    mine, side = F.pmod(F.xxhash64("c"), pieces), F.pmod(F.xxhash64("c", F.lit(1)), sides)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda i, j, own, held: F.struct(i.alias("i"), j.alias("j"), own.alias("own"), (~held).alias("most"))
    owned = F.transform(upto(sides), lambda j: cell(mine, j, F.lit(True), other & (j == side)))
    guest = F.transform(F.filter(upto(pieces), lambda i: other & (i != mine)), lambda i: cell(i, side, F.lit(False), F.lit(True)))
    placed = parts.select("*", F.explode(F.concat(owned, guest)).alias("z"))
    return placed.select(F.xxhash64("bucket", "z.i", "z.j").alias("bucket"), "t", "c", "n", "root", "z.most", "z.own")


def _hidden(crowd: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Candidate pairs (a, b) in the parts that still hold several components; None if there are none.

    The members of parts with more than FULL outside the largest component meet by their first shingles instead.
    """
    members = crowd.select("bucket", "t", "c", "n").join(label.select(F.col("v").alias("c"), "root"), "c")
    parts = _open(members, 3)  # two members are one pair, which the star has tried
    wide = parts.filter(F.col("others") > FULL).select("t", "c", "n", "root").distinct()
    if wide.limit(1).count():
        met = wide.join(_first(wide.select("c").distinct(), sets), "c").select(F.xxhash64("x", "t").alias("bucket"), "t", "c", "n", "root")
        parts = parts.filter(F.col("others") <= FULL).union(_open(met, 2).select(parts.columns))
    if not parts.limit(1).count():
        return None
    return _compared(_dealt(parts).join(sets.select("c", "v"), "c"))


def components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, c) of every row with a doc_id, and (c, component_id) of the classes of several rows or that share a bucket."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = C.settle(_signed(docs.filter("doc_id IS NOT NULL")), "signed")
    full = rows.filter("n > 0")
    # A class is a set; c names it. Its least document stands for it.
    classes = C.settle(full.groupBy("c", "c2", "n").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.count("*").alias("many")), "classes")
    crowd = _crowded(classes)
    sets = _held_sets(crowd, classes, docs)
    label = sets.select(F.col("c").alias("v"), F.col("c").alias("root"))
    # First the centre with which a class shares most bands; the others only where they are in another component by then.
    pairs = crowd.filter(_fits("n", "nb") & (F.col("c") != F.col("b"))).groupBy(F.col("c").alias("a"), "b").agg(F.count("*").alias("bands"))
    stars = C.settle(pairs.groupBy("a").agg(F.max(F.struct("bands", "b")).alias("m"), F.collect_list("b").alias("bs")).select("a", F.col("m.b").alias("best"), "bs"), "stars")
    label = joined(label, C.settle(_confirmed(stars.select("a", F.col("best").alias("b")), sets), "links"))
    rooted = stars.join(label.withColumnRenamed("v", "a"), "a").select("a", F.col("root").alias("root_a"), F.explode(F.array_remove("bs", F.col("best"))).alias("b"))
    at = label.select(F.col("v"), F.col("root").alias("root_b"))
    rest = C.settle(rooted.join(at, (F.col("b") == F.col("v")) & (F.col("root_a") != F.col("root_b"))).select("a", "b"), "pairs")
    if rest.limit(1).count():
        label = joined(label, C.settle(_confirmed(rest, sets), "links"))
    # Behind a centre a link of others may hide, also of members whose size does not allow a link with it.
    more = _hidden(crowd, label, sets)
    if more is not None:
        label = joined(label, C.settle(_confirmed(C.settle(more, "pairs"), sets), "links"))
    # Rows of one doc_id are one document, whatever their texts.
    several = C.settle(full.groupBy("doc_id").agg(F.min("c").alias("b"), F.max("c").alias("z")).filter("b <> z").select("doc_id", "b"), "several")
    if several.limit(1).count():
        label = joined(label, C.settle(full.join(several, "doc_id").select(F.col("c").alias("a"), "b").filter("a <> b").distinct(), "links"))
    placed = C.settle(classes.select("c", "doc_id", "many").join(label.select(F.col("v").alias("c"), "root"), "c", "left").filter("many > 1 OR root IS NOT NULL").select("c", "doc_id", F.coalesce("root", "c").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.select("doc_id", "n", "c"), C.settle(placed.join(least, "root").select("c", "component_id"), "components")


def rated(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; a null doc_id has component null and is kept."""
    rows, linked = components(docs)
    out = rows.join(linked, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = docs.filter("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lone = _signed(nameless).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(lone)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents but one of each component, with their columns."""
    rows, linked = components(docs.select("doc_id", "text"))
    gone = C.settle(rows.join(linked, "c").filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return C.unpacked(C.packed(docs, "doc_id").join(gone, F.col("_doc_id").cast("long") == F.col("_gone"), "left_anti"), docs)
