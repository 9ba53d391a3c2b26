"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is TURN role SAYS text END. In roles and texts a backslash is doubled and a
backslash put between '<' and '|', so that no marker can arise in them, and both are undone by dropping the backslash
before any character. The rendering is encoded once, with offsets, by a tokenizer in which the markers are single
tokens; a token hence never straddles a turn's border. The assistant's spans and the tokens' spans, both sorted, are
intersected by binary search: a token is under the mask if its span meets one of them.

A conversation's rows come sorted to one task and are worked on as they stream by, so memory is bound by FLUSH
characters and one turn, not by the conversation: past that, the part up to the last turn is encoded and given out
(at a marker, where the encoding is the same as that of the whole).

Nulls: a null text or role is empty; a null turn sorts first; rows of null conv_id are one conversation. Ties of turn
go by role, then text; repeated rows are repeated turns. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
SPEAKER = "assistant"
FLUSH = 1 << 20
_BACK = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return _BACK.sub(r"\1", text)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) turns, and the spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escaped(text)
        head = f"{TURN}{escaped(role)}{SAYS}"
        if role == SPEAKER:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a rendering."""
    turns = []
    for part in text.split(TURN)[1:]:
        role, _, body = part.partition(SAYS)
        turns.append((unescaped(role), unescaped(body.removesuffix(END))))
    return turns


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet a span; both are sorted, so each span's tokens are a run found by bisection."""
    out = np.zeros(len(starts), bool)
    if spans:
        a, z = np.array(spans).T
        full = z > a
        for lo, hi in zip(np.searchsorted(ends, a[full], "right"), np.searchsorted(starts, z[full], "left")):
            out[lo:hi] = True
    return out


def under(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> Iterator[str]:
    """The pieces of text under the mask: the unions of neighbouring masked tokens' spans (one character may be several tokens)."""
    k = np.flatnonzero(mask)
    if not len(k):
        return
    for run in np.split(k, np.flatnonzero(np.diff(k) > 1) + 1):
        yield text[int(starts[run].min()) : int(ends[run].max())]


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    made.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (TURN, SAYS, END)])
    return made


PARTS = "part long, text string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"


def formatted(convs: DataFrame, path: str) -> DataFrame:
    """conv_id, part, text, ids, starts, ends, mask of each conversation's rendering (one part, or more of a long one, in order)."""
    of = convs.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = of.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    id_type = of.schema["conv_id"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        rows: list[tuple] = []

        def encode(conv, part, turns):
            text, spans = rendered(turns)
            e = tok.encode(text, add_special_tokens=False)
            offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
            rows.append((conv, part, text, e.ids, offsets[:, 0].tolist(), offsets[:, 1].tolist(), masked(offsets[:, 0], offsets[:, 1], spans).tolist()))

        def flush(schema) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema)], names=["conv_id", "part", "text", "ids", "starts", "ends", "mask"])
            rows.clear()
            return out

        now, turns, size, part, held, types = None, [], 0, 0, 0, None
        for batch in batches:
            ints = pa.list_(pa.int32())
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), ints, ints, ints, pa.list_(pa.bool_())]
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if turns and (conv != now or size > FLUSH):
                    encode(now, part, turns)
                    held += size
                    part = part + 1 if conv == now else 0
                    turns, size = [], 0
                    if held > FLUSH or len(rows) >= 256:
                        yield flush(types)
                        held = 0
                elif conv != now:
                    part = 0
                now = conv
                turns.append((role, text))
                size += len(role) + len(text)
        if turns:
            encode(now, part, turns)
        if rows:
            yield flush(types)

    return dealt.mapInArrow(run, f"conv_id {id_type}, {PARTS}")


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation, from the output of `formatted` alone: turns read back, text under the mask, and their hashes. Parts stream by in order."""
    id_type = parts.schema["conv_id"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        now: list = []

        def row():
            conv, n, sha, chars, loss, size = now
            return (conv, n, sha.hexdigest(), chars, loss.hexdigest(), size)

        kinds = None

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "part", "text", "starts", "ends", "mask")]
            for k in range(batch.num_rows):
                conv, part, text = (c[k].as_py() for c in cols[:3])
                starts, ends, mask = (np.asarray(c[k].values.to_numpy(zero_copy_only=False)) for c in cols[3:])
                if part == 0:
                    if now:
                        done.append(row())
                    now[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parsed(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for piece in under(text, starts, ends, mask.astype(bool)):
                    said = unescaped(piece)
                    now[3] += len(said)
                    now[4].update(said.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
            if done:
                yield made(done)
        if now:
            yield made([row()])

    return parts.select("conv_id", "part", "text", "starts", "ends", "mask").mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
