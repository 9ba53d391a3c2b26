"""Benchmark decontamination: rare n-gram seeds join passages to test items; Smith-Waterman alignment scores them.

Test items are cut into segments of SEGMENT words that overlap by half. The document frequency of every 3-gram of the segments is
counted over the whole corpus; each 3-gram of a segment of fewer than SHORT words is a seed; of a longer one, in each
window of WINDOW 3-grams (at least LEAST windows) the rarest of those that occur at all, since what occurs nowhere can
hit nothing: a seed stands every few words however often an item leaked. A hit of a seed in a document gives a window of words around the place, and the local alignment of segment and window (match +2, else -1) over words gives
the score: the share of the segment's best possible score. A document leaks an item if a segment scores at least
THRESHOLD, with at least MIN_MATCH words' worth of score or the segment whole.

The items come to the executors in blocks of at most BLOCK_WORDS words, each block with its own pass; the driver holds
one block and its seeds. Documents are worked on whole, where they are read.

Nulls: a null text matches nothing; null ids are carried. An item of one or two words is leaked by a document that
consists of these words alone: within other text they are not told from ordinary use. Items with the same words are one,
named by the least of their ids. Repeated rows of one doc_id give one row per item, the best. Ties go to the first place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import bytewords as B
from quirefold.llm import common as C

N, SEGMENT, WINDOW, LEAST, SHORT, THRESHOLD, MIN_MATCH, BLOCK_WORDS = 3, 64, 3, 8, 40, 0.5, 8, 1 << 20
_BITS = 22


def segments(h: np.ndarray) -> list[np.ndarray]:
    """Words in runs of SEGMENT that overlap by half or more, so that each SEGMENT / 2 words together stand in one."""
    spare = max(0, len(h) - SEGMENT)
    n = -(-2 * spare // SEGMENT)
    return [h[a : a + SEGMENT] for a in (spare * k // max(n, 1) for k in range(n + 1))]


class Block:
    """Segments of some test items: words, 3-grams, and, once chosen, seeds."""

    def __init__(self, items: list[tuple[object, np.ndarray]]) -> None:
        self.items, self.words = [], []
        for item, h in items:
            for part in segments(h):
                if len(part):
                    self.items.append(item)
                    self.words.append(part)
        grams = [B.shingles(w, np.zeros(len(w), np.int64), 1, N)[0] for w in self.words]
        self.gram_of = grams
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)

    def seeded(self, counts: np.ndarray) -> Seeds:
        keys, segs, places = [], [], []
        for s, g in enumerate(self.gram_of):
            c = counts[np.searchsorted(self.grams, g)]
            rank = np.where(c > 0, c, np.iinfo(np.int64).max)
            n = len(g) if len(self.words[s]) < SHORT else max(len(g) // WINDOW, LEAST)
            for part in np.array_split(np.arange(len(g)), n):
                p = int(part[np.lexsort((g[part], rank[part]))[0]])
                if c[p]:
                    keys.append(g[p]), segs.append(s), places.append(p)
        return Seeds(self, np.array(keys, np.uint64), np.array(segs, np.int64), np.array(places, np.int64))


class Lookup:
    """Sorted keys behind a table of bits, so that most words are dismissed by one load."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `of` that are keys, and the index of the first equal key."""
        maybe = np.flatnonzero(self.bits[(of >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.searchsorted(self.keys, of[maybe])
        at = np.minimum(at, len(self.keys) - 1)
        ok = self.keys[at] == of[maybe]
        return maybe[ok], at[ok]


class Seeds:
    def __init__(self, block: Block, keys: np.ndarray, segs: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.segs, self.places = keys[order], segs[order], places[order]
        self.words, self.items = block.words, block.items
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.lookup = Lookup(self.keys)

    def hits(self, h: np.ndarray, row: np.ndarray, n_rows: int) -> list[tuple[int, int, float, int, int]]:
        """(row, segment, score, first word, last word) of the alignments that pass, of word hashes in order of rows."""
        sh, first = B.shingles(h, row, n_rows, N)
        counts = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
        begin = np.concatenate(([0], np.cumsum(counts)))
        place, key = self.lookup.find(sh)
        if not len(place):
            return []
        r = np.searchsorted(first, place, "right") - 1
        upto = np.searchsorted(self.keys, self.keys[key], "right")
        many = upto - key
        each = np.repeat(np.arange(len(key)), many)
        seed = np.repeat(key, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        seg, diagonal = self.segs[seed], (place - first[r])[each] - self.places[seed]
        # a text of fewer than N words has one key, of all its words: it equals the item
        short = counts[r][each] < N
        out = [(int(a), int(s), 1.0, 0, int(counts[a]) - 1) for a, s in zip(r[each][short], seg[short]) if self.length[s] == counts[a]]
        each, seg, diagonal = each[~short], seg[~short], diagonal[~short]
        half = np.maximum(self.length[seg] // 2, 4)
        bins = np.floor_divide(diagonal, half)
        jobs = np.unique(np.stack([r[each], seg, bins], axis=1), axis=0)
        jobs = jobs[np.argsort(self.length[jobs[:, 1]], kind="stable")]
        for a in range(0, len(jobs), 512):
            out += self._align(jobs[a : a + 512], h, begin, counts)
        return out

    def _align(self, jobs: np.ndarray, h: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        length = self.length[jobs[:, 1]]
        half = np.maximum(length // 2, 4)
        slack = half
        lo = np.clip(jobs[:, 2] * half - slack, 0, counts[jobs[:, 0]])
        hi = np.clip(jobs[:, 2] * half + half + length + slack, 0, counts[jobs[:, 0]])
        a = np.zeros((len(jobs), length.max()), np.uint64)
        b = np.ones((len(jobs), int((hi - lo).max())), np.uint64)
        in_a = np.arange(a.shape[1]) < length[:, None]
        in_b = np.arange(b.shape[1]) < (hi - lo)[:, None]
        a[in_a] = np.concatenate([self.words[s] for s in jobs[:, 1]])
        b[in_b] = np.concatenate([h[begin[r] + x : begin[r] + y] for r, x, y in zip(jobs[:, 0], lo, hi)])
        score, end = smith_waterman(a, b, in_a, in_b)
        good = (score >= THRESHOLD * 2 * length) & ((score >= 2 * MIN_MATCH) | (score == 2 * length))
        out = []
        if good.any():
            # the same backwards gives the first word
            turned, start = smith_waterman(a[good][:, ::-1], b[good][:, ::-1], in_a[good][:, ::-1], in_b[good][:, ::-1])
            for k, (j, s) in enumerate(zip(np.flatnonzero(good), start)):
                out.append((int(jobs[j, 0]), int(jobs[j, 1]), float(score[j]) / (2 * float(length[j])), int(lo[j] + b.shape[1] - 1 - s), int(lo[j] + end[j])))
        return out


def smith_waterman(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each row of a against that of b (match 2, mismatch and gap -1), and the place in b where it ends."""
    n, w = b.shape
    h = np.zeros((n, w + 1), np.int32)
    at = np.arange(w, dtype=np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(a.shape[1]):
        gain = np.where((b == a[:, i : i + 1]) & in_b & in_a[:, i : i + 1], 2, -1).astype(np.int32)
        t = np.maximum(np.maximum(h[:, :-1] + gain, h[:, 1:] - 1), 0)
        t = np.maximum.accumulate(t + at, axis=1) - at
        h[:, 1:] = t
        top = t.argmax(axis=1)
        value = t[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


def distinct_items(items: DataFrame) -> DataFrame:
    """(item_id, text) of items (item_id, text): those with the same words once, by the least of their ids."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.array_join(C.words(F.translate(F.col("text").cast("string"), upper, upper.lower())), " ")
    return items.select("item_id", words.alias("text")).groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text")


def blocks(items: DataFrame, words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The distinct test items in blocks of at most so many words (or one item), one at a time on the driver."""
    held, size = [], 0
    for item, text in distinct_items(items).toLocalIterator():
        data, at = B.arrow_bytes(pa.array([text], pa.string()))
        h, _ = B.hashed_words(data, at, 0, 1)
        if held and size + len(h) > words:
            yield Block(held)
            held, size = [], 0
        held.append((item, h))
        size += len(h)
    if held:
        yield Block(held)


def _counted(docs: DataFrame, block: Block) -> np.ndarray:
    """In how many rows each 3-gram of the block stands, over the whole corpus."""
    lookup = Lookup(block.grams)

    def run(batches):
        total = np.zeros(len(lookup.keys), np.int64)
        for batch in batches:
            data, at = B.arrow_bytes(batch.column(0))
            for i, j in B.each_group(at):
                sh, first = B.shingles(*B.hashed_words(data, at, i, j), j - i, N)
                place, key = lookup.find(sh)
                row = np.searchsorted(first, place, "right") - 1
                both = np.unique(row * len(total) + key)
                total += np.bincount(both % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["g", "n"])

    counts = np.zeros(len(block.grams), np.int64)
    for g, n in docs.select(F.col("text").cast("string")).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        counts[g] = n  # at most the block's 3-grams
    return counts


def seeds(docs: DataFrame, items: DataFrame, words: int = BLOCK_WORDS) -> Iterator[Seeds]:
    for block in blocks(items, words):
        if len(block.grams):
            yield block.seeded(_counted(docs, block))


def _of_batch(texts: pa.Array, found: Seeds) -> Iterator[tuple[int, int, float, int, int]]:
    data, at = B.arrow_bytes(texts)
    for i, j in B.each_group(at):
        for r, *rest in found.hits(*B.hashed_words(data, at, i, j), j - i):
            yield (r + i, *rest)


def leaks(docs: DataFrame, items: DataFrame, words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word of each document and distinct item it leaks (see distinct_items)."""
    of, item_type = docs.select("doc_id", F.col("text").cast("string").alias("text")), items.schema["item_id"].dataType
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, score double, first_word long, last_word long"
    parts = []
    for found in seeds(of, items, words):

        def run(batches, found=found):
            for batch in batches:
                got = list(_of_batch(batch.column(1), found))
                if got:
                    r, s, score, a, z = zip(*got)
                    item = pa.array([found.items[k] for k in s])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), item, pa.array(score), pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["doc_id", "item_id", "score", "first_word", "last_word"])

        parts.append(of.mapInArrow(run, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("a"), "last_word")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.score", (-F.col("m.a")).alias("first_word"), "m.last_word")


def clean(docs: DataFrame, items: DataFrame, words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that leak no item, with their columns; dropped where they are read, so without a shuffle."""
    place = docs.columns.index("text")
    out = docs
    for found in seeds(docs, items, words):

        def run(batches, found=found):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for r, *_ in _of_batch(batch.column(place), found):
                    keep[r] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
