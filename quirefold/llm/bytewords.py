"""Words of UTF-8 texts as 64-bit hashes, by numpy over the bytes of an Arrow column.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered; both concern ASCII bytes alone, so the work is on bytes and no string
is made. Texts are worked on in slices of bounded size, cut at white space, whole to the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER = (_LOWER + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_BASE, _K1, _K2 = 0xD1342543DE82EF95, np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * _K1
    h = h ^ (h >> np.uint64(33))
    h = h * _K2
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each or more."""
    size = max(SLICE, 1 << (n - 1).bit_length())
    if size not in _powers:
        if size > SLICE:
            _powers.clear()
        up = np.ones(size, np.uint64)
        down = np.ones(size, np.uint64)
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def _slice(b: np.ndarray, breaks: np.ndarray, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash, start and end of each word of b, and the hash of its first bytes, so many as in heads; breaks are places where a word ends though no white space stands there."""
    n = len(b)
    ws = _WS[b]
    word = ~ws
    first = word.copy()
    first[1:] &= ws[:-1]
    if len(breaks):
        first[breaks] |= word[breaks]
    last = word.copy()
    last[:-1] &= ws[1:]
    if len(breaks):
        inner = breaks[breaks > 0]
        last[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[b] * up[:n], out=total[1:])
    of = lambda z: mix((total[z] - total[starts]) * down[starts])
    return of(ends), starts, ends, *[of(np.minimum(starts + k, ends)) for k in heads]


def arrow_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    if texts.type not in (pa.string(), pa.large_string()):
        texts = texts.cast(pa.large_string())
    width = np.int32 if texts.type == pa.string() else np.int64
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def each_group(at: np.ndarray, most: int = SLICE):
    """Runs (first, last) of rows whose texts together have at most so many bytes, or one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def hashed_words(data: np.ndarray, at: np.ndarray, i: int, j: int, spans: bool = False):
    """Of the rows i to j: word hashes, row number of each (from 0), and with spans the byte places from the row's start."""
    lo, hi = int(at[i]), int(at[j])
    if hi - lo <= SLICE or j - i > 1:
        b, cuts = data[lo:hi], at[i + 1 : j] - lo
        h, s, e, *_ = _slice(b, cuts[cuts < hi - lo]) if hi > lo else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        row = np.searchsorted(at[i + 1 : j + 1] - lo, s, "right")
        if spans:
            base = (at[i:j] - lo)[row] if len(row) else 0
            return h, row, s - base, e - base
        return h, row
    hs, ss, es = [], [], []
    for p, q in text_slices(data, lo, hi):
        h, s, e, *_ = _slice(data[p:q], np.zeros(0, np.int64))
        hs.append(h), ss.append(s + (p - lo)), es.append(e + (p - lo))
    h = np.concatenate(hs)
    return (h, np.zeros(len(h), np.int64), np.concatenate(ss), np.concatenate(es)) if spans else (h, np.zeros(len(h), np.int64))


def text_slices(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pieces of one text of SLICE bytes at most, each ending at white space (or longer, where there is none)."""
    p = lo
    while p < hi:
        q = min(hi, p + SLICE)
        while q < hi:
            white = np.flatnonzero(_WS[data[p:q]])
            if len(white):
                q = p + int(white[-1]) + 1
                break
            q = min(hi, q + (q - p))
        yield p, q
        p = q


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each row, in order, and first index per row (n_rows + 1); a row of 1 to k - 1 words has one, of all of them."""
    counts = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    begin = np.zeros(n_rows + 1, np.int64)
    np.cumsum(counts, out=begin[1:])
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.zeros(n_rows + 1, np.int64)
    np.cumsum(many, out=first[1:])
    out = np.empty(first[-1], np.uint64)
    if len(h) >= k:
        run = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            run = mix(run * np.uint64(3) + h[j : len(h) - k + 1 + j] + np.uint64(j + 1)) if j % 2 else (run ^ h[j : len(h) - k + 1 + j]) * _K1
        ok = row[: len(run)] == row[k - 1 :]
        run = mix(run[ok])
        places = np.repeat(counts >= k, many)
        out[places] = run
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        x = np.uint64(counts[r])
        with np.errstate(over="ignore"):
            for v in h[begin[r] : begin[r + 1]]:
                x = (x ^ v) * _K2
                x ^= x >> np.uint64(31)
        out[first[r]] = x
    return out, first
