"""The pipeline against a brute-force version: SQL for rules, lines and mixing, all pairs for near copies, all alignments for leaks."""

import duckdb
import numpy as np
import pyarrow as pa
from compare import SF
from test_methods import components

import corpus_pipeline
from quirefold.llm import bytewords, decontam, sql

COLUMNS = "doc_id, text, lang, source, n_chars"


def over(rows):
    """DuckDB with these documents."""
    c = duckdb.connect()
    documents = pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])})
    c.register("documents", documents)
    return c


def hashes(text):
    data, at = bytewords.arrow_bytes(pa.array([text], pa.string()))
    return bytewords.hashed_words(data, at, 0, 1)[0]


def leaking(rows, items):
    words = [w for w in map(hashes, items) if len(w) >= 3]
    a = np.zeros((len(words), max(map(len, words))), np.uint64)
    in_a = np.arange(a.shape[1]) < np.array([[len(w)] for w in words])
    a[in_a] = np.concatenate(words)
    size = np.array([len(w) for w in words])
    out = set()
    for r in rows:
        h = hashes(r[1])
        b = np.tile(h, (len(words), 1))
        score, _ = decontam.smith_waterman(a, b, in_a, np.ones(b.shape, bool))
        if ((score >= size) & (score >= 16)).any():
            out.add(r[0])
    return out


def test_run(spark):
    rows = duckdb.sql(f"SELECT {COLUMNS} FROM '{SF}/documents.parquet'").fetchall()
    items = [t for t, in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    kept = {i for i, in over(rows).sql(f"SELECT doc_id FROM ({sql.OP5}) WHERE kept").fetchall()}
    rows = [r for r in rows if r[0] in kept]
    left = {i: (n, m, t) for i, n, m, t in over(rows).sql(f"SELECT doc_id, n_lines, n_removed, text FROM ({sql.OP4})").fetchall()}
    rows = [(r[0], left[r[0]][2], *r[2:4], len(left[r[0]][2]) if left[r[0]][1] else r[4]) for r in rows if left[r[0]][1] in range(max(1, left[r[0]][0]))]
    root = components([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if root[r[0]][1] == r[0]]
    gone = leaking(rows, items)
    rows = [r for r in rows if r[0] not in gone]
    assert gone and len(rows) > 50
    copies = {i: taken // size for i, size, taken in over(rows).sql(f"SELECT doc_id, size, taken FROM ({sql.OP10})").fetchall() if size}
    want = sorted((*r, k + 1) for r in rows for k in range(copies.get(r[0], 0)))
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*COLUMNS.split(", "), "copy_no"]
    assert sorted(map(tuple, got.collect())) == want
