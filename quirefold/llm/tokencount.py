"""Token counts by a compiled finite-state tokenizer.

A byte pair encoding with word ends is turned into a deterministic transducer over (byte, last byte of its word?). Its
state is what the encoding of any continuation can depend on: of each place in the longest suffix of the prefix read so
far that begins some token, the last token of the encoding up to there, and how many tokens that took, against here.
(A sequence of tokens is the encoding of its text exactly if every token encodes to itself and every neighbouring pair
encodes to itself, so the last token at a place is the one suffix that follows on validly.) A transition carries the
change of the count, so the sum along a word is its number of tokens; a word's last byte leads back to the start state.
States are made on first need and kept in one table of whole numbers; past MAX_STATES it starts afresh.

A batch of texts is one stream of bytes, cut into chunks of CHUNK. A chunk is a map from entry state to (exit state,
counts). From its first word end on it is constant: those bodies run in lockstep, one array operation per step over all
chunks, and give the entry states of the chunks that follow a word end. Within a word that spans chunks, a chunk's map
is known for some entry states only: first for the one that its last WARM bytes lead to from the start, which is mostly
right, since what a state depends on reaches back a few tokens. The maps of all chunks are composed by a parallel prefix
scan; where an exit state is not yet among the next chunk's entries, it is added, all such in one lockstep run, until
the scan knows every chunk's true entry. So a long word costs a few runs of CHUNK steps, however long it is.

Normalising (composition, white space, lower case) is the library's own; cutting into words is on code points, whose
classes are asked of the library's pre-tokenizer once each. Special strings in a text count as one token, as its default.

Nulls: a null text is empty and has 0 tokens; ids may be null or repeated; each row is counted by itself.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, WARM, MAX_STATES = 256, 64, 1 << 17
#: Tokens that begin alike, up to which states are told apart by what can follow rather than by the token before.
FEW = 40
#: Text worked on at once, in characters; a longer text is one piece.
PIECE = 1 << 19
LETTER, DIGIT, SPACE, OTHER, UNKNOWN = range(5)
#: What the pre-tokenizer cuts off as a word of its own, longest first where they share a start.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Transducer:
    """The lazily determinised machine of one vocabulary with word-end suffix."""

    def __init__(self, model: dict) -> None:
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.symbol = byte_symbols()
        vocab = [t for t in model["vocab"]]
        ids = {t: k for k, t in enumerate(vocab)}
        self.names = vocab
        self.inner = {t: k for t, k in ids.items() if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)]: k for t, k in ids.items() if t.endswith(self.end) and t != self.end}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.begins = {t[:k] for t in [*self.inner, *self.final] for k in range(1, len(t) + 1)}
        self.ordered = sorted((t, k) for kind in (self.inner, self.final) for t, k in kind.items())
        self.onwards: dict = {}
        self.sames: dict = {}
        self.half: dict[str, tuple[str, str, int]] = {}
        self.valid_one: dict[int, bool] = {}
        self.fresh()

    def fresh(self) -> None:
        """State 0 is the start; column 0 of the table leads there from anywhere without a count."""
        self.columns = np.full(512, -1, np.int32)
        self.n_columns = 1
        self.table = np.full((1024, 64), -1, np.int32)
        self.table[:, 0] = 0 << 8 | 128
        self.states: list[tuple[str, tuple]] = [("", ((-1, 0),))]
        self.number = {self.states[0]: 0}

    def merged(self, parts: list[str]) -> list[str]:
        """Symbols merged by rank, leftmost first among equals."""
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[k], parts[k + 1]) not in self.rank:
                break
            parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]
        return parts

    def _parts(self, token: int) -> list[str]:
        return self._parts_of(self.names[token])

    def _parts_of(self, name: str) -> list[str]:
        if name.endswith(self.end) and name != self.end:
            body = list(name[: -len(self.end)])
            return [*body[:-1], body[-1] + self.end]
        return list(name)

    def stands(self, token: int) -> bool:
        if token not in self.valid_one:
            self.valid_one[token] = self.merged(self._parts(token)) == [self.names[token]]
        return self.valid_one[token]

    def halves(self, name: str) -> tuple[str, str, int]:
        """The last merge that makes a token, and its rank; -1 for a single symbol."""
        if name not in self.half:
            parts = self._parts_of(name)
            while len(parts) > 2:
                k = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
                parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]
            self.half[name] = ("", "", -1) if len(parts) == 1 else (*parts, self.rank[tuple(parts)])
        return self.half[name]

    def follows(self, one: int, two: int) -> bool:
        """Whether the encoding of both texts together is these two tokens.

        It is unless, at some time while they were being merged, the parts that meet at the seam would have merged first:
        so merges are undone from the latest on, and each pair at the seam is held against the time of its undoing.
        """
        a, b, limit, never = self.names[one], self.names[two], 1 << 30, 1 << 30
        while self.rank.get((a, b), never) >= limit or (a, b) not in self.rank:
            (_, right, ra), (left, _, rb) = self.halves(a), self.halves(b)
            if ra < 0 and rb < 0:
                return True
            # equal ranks merge leftmost first: the seam lies left of b's inner merge, right of a's
            a, b, limit = (right, b, ra) if ra > rb else (a, left, rb + 1)
        return False

    def onward(self, before: int, tail: str):
        """Which tokens may run on from a place: None if none can, else a name that equals another's only if the same ones can.

        before is the last token up to the place, tail what has been read since. Where many tokens begin with tail, before
        stands for itself.
        """
        if before == -2 or tail not in self.begins:
            return None
        key = (before, tail)
        if key not in self.onwards:
            a = bisect_left(self.ordered, (tail,))
            b = a
            while b < len(self.ordered) and b - a <= FEW and self.ordered[b][0].startswith(tail):
                b += 1
            if b - a > FEW:
                found = before
            else:
                longer = [k for t, k in self.ordered[a:b] if len(self.names[k]) > len(tail)]
                found = tuple(k for k in longer if self.stands(k) and (before == -1 or self.follows(before, k))) or None
                found = self.sames.setdefault(found, found)
            self.onwards[key] = found
        return self.onwards[key]

    def last_token(self, suffix: str, chain: tuple, tokens: dict[str, int]) -> tuple[int, int]:
        """The token that ends the encoding at the end of suffix, and the count after it, relative as in chain.

        chain holds (last token, count) at each place of suffix but its end; -1 is the start of the word.
        """
        for k in range(len(suffix)):
            token = tokens.get(suffix[k:])
            if token is None or not self.stands(token):
                continue
            before, count = chain[k]
            if before == -1 or before >= 0 and self.follows(before, token):
                return token, count + 1
        raise ValueError(f"no encoding of {suffix!r}")

    def step(self, state: int, byte: int, final: bool) -> tuple[int, int]:
        """Next state and change of the count."""
        suffix, chain = self.states[state]
        grown = suffix + self.symbol[byte]
        here = chain[-1][1]
        if final:
            _, count = self.last_token(grown, chain, self.final)
            return 0, count - here
        token, count = self.last_token(grown, chain, self.inner)
        # Only the longest suffix that begins some token matters from here on; counts are kept against the new place.
        drop = 0
        while grown[drop:] and grown[drop:] not in self.begins:
            drop += 1
        rest = grown[drop:]
        places = (*chain, (token, count))[drop:]
        # A place matters if a token may run on from it; the last one always does.
        kept = tuple((t, c - count) if k == len(rest) or self.onward(t, rest[k:]) is not None else (-2, 0) for k, (t, c) in enumerate(places))
        key = (rest, tuple((t if k == len(rest) else self.onward(t, rest[k:]), c) for k, (t, c) in enumerate(kept)))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append((rest, kept))
        return self.number[key], count - here

    def need(self, states: np.ndarray, symbols: np.ndarray) -> None:
        """Fill the table where these (state, symbol) pairs are missing."""
        for state, symbol in {*zip(states.tolist(), symbols.tolist())}:
            nxt, change = self.step(state, symbol & 255, symbol >= 256)
            while nxt >= len(self.table):
                more = np.full((len(self.table), self.table.shape[1]), -1, np.int32)
                more[:, 0] = 128
                self.table = np.concatenate([self.table, more])
            self.table[state, self.columns[symbol]] = nxt << 8 | (change + 128)

    def mapped(self, symbols: np.ndarray) -> np.ndarray:
        """Columns of symbols, new ones for those not met before."""
        for s in np.flatnonzero(np.bincount(symbols, minlength=512)):
            if self.columns[s] < 0:
                if self.n_columns == self.table.shape[1]:
                    self.table = np.concatenate([self.table, np.full((len(self.table), 64), -1, np.int32)], axis=1)
                self.columns[s] = self.n_columns
                self.n_columns += 1
        return self.columns[symbols]

    def lockstep(self, symbols: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state of each lane and the count changes, of symbols[step, lane] (0 to 511; -1: stay at the start state)."""
        seen = self.mapped(symbols[symbols >= 0])
        cols = np.zeros(symbols.shape, np.int32)
        cols[symbols >= 0] = seen
        state = entry.astype(np.int64)
        changes = np.zeros(symbols.shape, np.int8)
        width = self.table.shape[1]
        flat = self.table.reshape(-1)
        for t in range(len(cols)):
            got = flat[state * width + cols[t]]
            if got.min() < 0:
                miss = np.flatnonzero(got < 0)
                self.need(state[miss], symbols[t, miss])
                flat = self.table.reshape(-1)
                got = flat[state * width + cols[t]]
            state = (got >> 8).astype(np.int64)
            changes[t] = (got & 255) - 128
        return state, changes

    def counts(self, symbols: np.ndarray) -> np.ndarray:
        """Change of the count at each place of a stream of whole words (byte + 256 at a word's last byte)."""
        if len(self.states) > MAX_STATES:
            self.fresh()
        n = len(symbols)
        lanes = max(1, -(-n // CHUNK))
        s = np.full(lanes * CHUNK, -1, np.int32)
        s[:n] = symbols
        s = s.reshape(lanes, CHUNK)
        is_end = s >= 256
        has_end = is_end.any(axis=1)
        head = np.where(has_end, is_end.argmax(axis=1) + 1, CHUNK)  # up to the first word end
        head[0] = 0
        body = s.copy()
        body[np.arange(CHUNK) < head[:, None]] = -1
        out, changes = self.lockstep(np.ascontiguousarray(body.T), np.zeros(lanes, np.int64))
        changes = np.ascontiguousarray(changes.T)
        def run(ks: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Exit states and changes of the heads of these chunks from these entries."""
            size = int(head[ks].max())
            part = s[ks, :size].copy()
            part[np.arange(size) >= head[ks][:, None]] = -1
            exits, more = self.lockstep(np.ascontiguousarray(part.T), entry)
            return exits, more.T

        def put(ks: np.ndarray, more: np.ndarray) -> None:
            inside = np.arange(more.shape[1]) < head[ks][:, None]
            changes[ks, : more.shape[1]] = np.where(inside, more, changes[ks, : more.shape[1]])

        known = np.flatnonzero(head > 0)
        known = known[has_end[known - 1] | (known == 1)]  # their entry is an exit that no entry bears on
        if len(known):
            exits, more = run(known, out[known - 1])
            put(known, more)
            out[known[~has_end[known]]] = exits[~has_end[known]]
        rest = np.setdiff1d(np.flatnonzero(head > 0), known, assume_unique=True)
        if len(rest):
            self._composed(rest, known, out, s, run, put)
        return changes.reshape(-1)[:n]

    def _composed(self, rest: np.ndarray, known: np.ndarray, out: np.ndarray, s: np.ndarray, run, put) -> None:
        """The heads of the chunks `rest`, which follow chunks without a word end: their maps, composed by prefix scan."""
        first = np.isin(rest - 1, known) | (rest == 1)  # the chunk before has a known exit
        guess, _ = self.lockstep(np.ascontiguousarray((s[rest - 1, -WARM:] & 255).T), np.zeros(len(rest), np.int64))
        entry = np.where(first, out[rest - 1], guess)[:, None]  # the entries each map is known for, -1 where fewer
        exits, more = run(rest, entry[:, 0])
        exits, held = exits[:, None], {(j, 0): more[j] for j in range(len(rest))}
        while True:
            m = entry.shape[1]
            # index of each exit among the entries of the next chunk; m is the unknown, and stays it but where a new word begins
            step = np.full((len(rest), m + 1), m, np.int64)
            after = np.flatnonzero(~first)
            same = (exits[after - 1][:, :, None] == entry[after][:, None, :]) & (entry[after - 1][:, :, None] >= 0)
            step[after, :m] = np.where(same.any(axis=2), same.argmax(axis=2), m)
            step[first] = 0
            path, d = step.copy(), 1
            while d < len(rest):
                path[d:] = np.take_along_axis(path[d:], path[:-d], axis=1)
                d *= 2
            at = path[:, 0]
            if (at < m).all():
                break
            lack = (step[after, :m] == m) & (entry[after - 1] >= 0)
            j, i = np.nonzero(lack)
            todo = np.unique(np.stack([after[j], exits[after[j] - 1, i]], axis=1), axis=0)
            more_exits, more = run(rest[todo[:, 0]], todo[:, 1])
            filled = (entry >= 0).sum(axis=1)
            place = filled[todo[:, 0]] + np.arange(len(todo)) - np.searchsorted(todo[:, 0], todo[:, 0])
            wider = max(m, int(place.max()) + 1)
            entry, exits = (np.pad(x, ((0, 0), (0, wider - m)), constant_values=-1) for x in (entry, exits))
            entry[todo[:, 0], place], exits[todo[:, 0], place] = todo[:, 1], more_exits
            held |= {(int(j), int(k)): row for j, k, row in zip(todo[:, 0], place, more)}
        true = [held[j, int(k)] for j, k in enumerate(at)]
        width = max(map(len, true))
        put(rest, np.stack([np.pad(row, (0, width - len(row))) for row in true]))


class Counter:
    """Counts tokens of texts as the library does with one tokenizer file, without added tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.machine = Transducer(made["model"])
        self.specials = [t["content"] for t in made["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.kind[np.array([9, 10, 11, 12, 13, 32])] = SPACE

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """Class of each code point: asked of the pre-tokenizer, by how it cuts the point next to itself and a letter."""
        got = self.kind[points]
        if (got == UNKNOWN).any():
            split = self.library.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[got == UNKNOWN]).tolist():
                c = chr(p)
                cuts = len(split(f"a{c}")), len(split(f"{c}{c}"))
                self.kind[p] = SPACE if cuts[1] == 0 else LETTER if cuts[0] == 1 else DIGIT if cuts[1] == 2 else OTHER
            got = self.kind[points]
        return got

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The text around special strings, normalised, and how many of these there are."""
        found = 0
        parts = [text]
        for s in self.specials:
            if s in text:
                cut = [q for p in parts for q in p.split(s)]
                found += len(cut) - len(parts)
                parts = cut
        return [p.lower() if p.isascii() else self.library.normalizer.normalize_str(p) for p in parts if p], found

    def counted(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        whole, owner = [], []
        for k, text in enumerate(texts):
            parts, out[k] = self.pieces(text)
            for p in parts:
                whole.append(p)
                owner.append(k)
        if not whole:
            return out
        joined = " ".join(whole)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds(points)
        word = kind != SPACE
        last = word.copy()
        last[:-1] &= (kind[:-1] != kind[1:]) | (kind[:-1] == DIGIT)
        self._endings(points, kind, last)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        size = np.full(len(points), 1, np.int64)
        size += (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        symbols = data.astype(np.int32)
        symbols[np.cumsum(size)[last] - 1] += 256
        keep = np.repeat(word, size)
        part = np.repeat(np.arange(len(whole)), [len(p) + 1 for p in whole])[: len(points)]
        row = np.asarray(owner)[np.repeat(part, size)[keep]]
        symbols = symbols[keep]
        if len(symbols):
            out += np.bincount(row, self.machine.counts(symbols), minlength=len(texts)).astype(np.int64)
        return out

    def _endings(self, points: np.ndarray, kind: np.ndarray, last: np.ndarray) -> None:
        """Marks the words ' + letters that the pre-tokenizer takes whole wherever a word may start at the apostrophe.

        The apostrophe starts a word unless other signs stand right before it; the letters after the ending go on as a word.
        """
        for a in np.flatnonzero(points == 0x27):
            if a and kind[a - 1] == OTHER and not last[a - 1]:
                continue
            after = "".join(map(chr, points[a : a + 3]))
            fit = next((e for e in ENDINGS if after.startswith(e)), None)
            if fit:
                last[a] = False
                last[a + len(fit) - 1] = True


@lru_cache(1)
def _counter(path: str) -> Counter:
    """One machine per worker process and file: its states serve all batches and tasks to come."""
    return Counter(path)


def counted(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. path: the vocabulary file, at the same place on every executor."""
    of = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {of.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            i = 0
            while i < len(texts):
                held, size, j = [], 0, i
                while j < len(texts) and (j == i or size < PIECE):
                    held.append(texts[j].as_py() or "")
                    size += len(held[-1])
                    j += 1
                n = counter.counted(held)
                n_bytes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in held], np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
                i = j

    return of.mapInArrow(run, schema)
