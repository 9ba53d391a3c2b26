"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score, so that
P(grade <= k) = logistic(threshold_k - score). The expected grade ranks documents; the tail probability, that of the
top grade, selects them. Grades come from the labels: 0 toxic, 1 poor, 2 good and not toxic. A feature is the presence
of a word, of the first 4 or 6 bytes of a word, or of a step of a measure of the text (share of signs, of upper case,
of repeated words, length); hashes name the weights.

The fit is on the driver, on at most FIT_ROWS labelled rows with at most FIT_FEATURES features (8 bytes each) together,
those with the least hash of doc_id; scoring covers every document, whole, where it is read.

Nulls: a null text has no words; labels without a doc_id or a quality are not fitted on (a null toxic counts as 0).
Repeated labels of one document count as often as they stand. Without labels the weights are 0, and every document is
graded by the prior of equal grades. Repeated rows are scored alike; a tail probability of exactly KEEP is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import bytewords as B
from quirefold.llm import common as C

BITS, HEADS, GRADES, FIT_ROWS, KEEP, WHOLE, MARK = 18, (4, 6), 3, 12_000, 0.5, 0.1, 10.0
#: Features of the fit sample, 128 MB; the row that would pass the bound and those after it in order of the hash stay out.
FIT_FEATURES = 1 << 24
_BREAK = np.zeros(0, np.int64)


def features(data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of the text in bytes lo to hi, and their values: log2(1 + times), less for whole words."""
    parts, words, upper, signs, total = [[] for _ in range(1 + len(HEADS))], [], 0, 0, hi - lo
    for p, q in B.text_slices(data, lo, hi):
        b = data[p:q]
        h, _, _, *heads = B._slice(b, _BREAK, HEADS)
        words.append(h)
        for k, x in enumerate((h, *heads)):
            parts[k].append((B.mix(x + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64))
        upper += int(((b >= 65) & (b <= 90)).sum())
        signs += int(((b >= 33) & (b <= 47) | (b >= 58) & (b <= 64) | (b >= 91) & (b <= 96) | (b >= 123) & (b <= 126)).sum())
    words = np.concatenate(words) if words else np.zeros(0, np.uint64)
    n = len(words)
    repeated = 1 - len(np.unique(words)) / n if n else 0.0
    steps = [int(40 * signs / max(total, 1)), int(20 * upper / max(total, 1)), int(20 * repeated), int(2 * np.log2(n + 1)), int(4 * total / max(n, 1))]
    marks = np.array([(k + 1) << 32 | s for k, s in enumerate(steps)], np.uint64)
    found, values = [(B.mix(marks) >> np.uint64(64 - BITS)).astype(np.int64)], [np.full(len(marks), MARK, np.float32)]
    for k, part in enumerate(parts):
        if part:
            at, times = np.unique(np.concatenate(part), return_counts=True)
            found.append(at)
            values.append((np.log2(1 + times) * (1.0 if k else WHOLE)).astype(np.float32))
    return np.concatenate(found), np.concatenate(values)


class Ordinal:
    """Weights and thresholds."""

    def __init__(self) -> None:
        self.w = np.zeros(1 << BITS)
        self.cuts = np.log(np.arange(1, GRADES) / np.arange(GRADES - 1, 0, -1))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k but the last."""
        return 1 / (1 + np.exp(np.clip(self.cuts - score[:, None], -40, 40)))

    def fit(self, xs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 20, batch: int = 128, rate: float = 0.05, shrink: float = 3e-6, seed: int = 3) -> Ordinal:
        """AdaGrad on the negative log likelihood; the gaps between thresholds stay positive by their logarithms."""
        rng = np.random.default_rng(seed)
        share = np.clip(np.cumsum(np.bincount(y, minlength=GRADES))[:-1] / len(y), 0.02, 0.98)
        self.cuts = np.sort(np.log(share / (1 - share)) + np.arange(GRADES - 1) * 1e-3)
        first, gaps = self.cuts[0], np.log(np.maximum(np.diff(self.cuts), 0.05))
        seen, seen_c = np.full(len(self.w), 1e-3), np.full(GRADES - 1, 1.0)
        for _ in range(rounds):
            order = rng.permutation(len(xs))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                idx = np.concatenate([xs[k][0] for k in some])
                value = np.concatenate([xs[k][1] for k in some])
                row = np.repeat(np.arange(len(some)), [len(xs[k][0]) for k in some])
                score = np.bincount(row, self.w[idx] * value, len(some))
                t = np.hstack([np.ones((len(some), 1)), self.tails(score), np.zeros((len(some), 1))])
                at = np.arange(len(some)), y[some]
                p = np.maximum(t[at[0], at[1]] - t[at[0], at[1] + 1], 1e-9)
                slope = t * (1 - t)  # of each tail by the score
                d_score = -(slope[at[0], at[1]] - slope[at[0], at[1] + 1]) / p
                g = np.bincount(idx, d_score[row] * value, len(self.w)) / len(some)
                d_cut = np.zeros((len(some), GRADES + 1))
                d_cut[at[0], at[1]] += slope[at[0], at[1]] / p
                d_cut[at[0], at[1] + 1] -= slope[at[0], at[1] + 1] / p
                dc = d_cut[:, 1:-1].mean(axis=0)
                here = np.flatnonzero(g)
                g = g[here] + shrink * self.w[here]
                seen[here] += g * g
                self.w[here] -= rate * g / np.sqrt(seen[here])
                d_all = np.concatenate([[dc.sum()], [dc[k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 2)]])
                seen_c += d_all**2
                move = rate * d_all / np.sqrt(seen_c)
                first, gaps = first - move[0], gaps - move[1:]
                self.cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        return self


def _each(batch_text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, at = B.arrow_bytes(batch_text)
    for i in range(len(at) - 1):
        yield features(data, int(at[i]), int(at[i + 1]))


def trained(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> Ordinal:
    """Fitted on the labelled documents with the least hash of doc_id, fit_rows labels and fit_features features at most; only these are brought to the driver."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) > 0
    rated = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("_id"), F.when(toxic, 0).when(F.col("quality") <= 0, 1).otherwise(2).alias("_grade"))
    some = F.broadcast(rated.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(fit_rows))  # bounded by fit_rows
    of = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(some, F.col("doc_id") == F.col("_id")).select(F.xxhash64("_id").alias("h"), F.col("_id").cast("long").alias("id"), "_grade", "text")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                xs, vs = zip(*((x.astype(np.int32), v) for x, v in _each(part.column(3))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2).cast(pa.int32()), pa.array(list(map(len, xs)), pa.int32()), pa.array(xs, pa.list_(pa.int32())), pa.array(vs, pa.list_(pa.float32()))], names=["h", "id", "grade", "m", "x", "v"])

    made = C.settle(of.mapInArrow(run, "h long, id long, grade int, m int, x array<int>, v array<float>"), "features")
    # numbers only; of rows with the key of the first one that is out, all are out
    keys = ("h", "id", "grade")
    sizes = made.select(*keys, "m").orderBy(*keys).limit(fit_rows + 1).toArrow()
    upto = np.cumsum(sizes["m"].to_numpy()) if sizes.num_rows else np.zeros(0, np.int64)
    n = min(int(np.searchsorted(upto, fit_features, "right")), fit_rows)
    if n < sizes.num_rows:
        h, i, g = (sizes[c][n].as_py() for c in keys)
        made = made.filter((F.col("h") < h) | ((F.col("h") == h) & ((F.col("id") < i) | ((F.col("id") == i) & (F.col("grade") < g)))))
    got = made.select("id", "grade", "x", "v").toArrow().combine_chunks().sort_by([("id", "ascending"), ("grade", "ascending")])
    if not got.num_rows:
        return Ordinal()
    xs = [(np.asarray(x.values), np.asarray(v.values)) for x, v in zip(got["x"], got["v"])]
    return Ordinal().fit(xs, got["grade"].to_numpy())


def rated(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, expected_grade, tail_probability and kept of every row."""
    model = trained(docs, labels, fit_rows)
    of = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            score = np.array([model.w[x] @ v for x, v in _each(batch.column(1))])
            tails = model.tails(score) if len(score) else np.zeros((0, GRADES - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= KEEP)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return of.mapInArrow(run, f"doc_id {of.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_probability double, kept boolean")
