"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator on documents and for each stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirefold.llm import chat, decontam, htmltext, linededup, mixing, neardup, quality, rules, secrets, tokencount

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["k", "h", "size", "kept", "_in", "spans", "copies", "bands", "component_id", "n_words", "_text"]
PROSE = "The quick brown fox number {} jumps over the lazy dog while seventy other animals watch from afar and wonder why. "
LONG = " ".join(f"word{k % 977} other{k}" for k in range(40_000))
ROWS = [
    (1, "".join(PROSE.format(k) for k in range(8)), "en", "a", 1),
    (1, "".join(PROSE.format(k) for k in range(8)), "en", "a", 1),
    (2, "".join(PROSE.format(k) for k in range(8)), None, None, None),
    (3, None, "en", "a", None),
    (4, "", "", "", 0),
    (5, " \n\t \x0b\n", "en", "a", 5),
    (None, "no id but several words here", "en", None, 1),
    (6, LONG, "en", "b", len(LONG)),
    (7, "x" * 200_000, "de", "b", 200_000),
    (8, "éß漢字😀 ́\x00   ' '' <|endoftext|>", "fr", "c", 3),
]
LABELS = "doc_id long, quality int, toxic int"


def tokenizer(name):
    public = pytest.importorskip("public_tokenizers")
    return str(public.path(name))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    out = docs
    for c in CLASH:
        out = out.withColumn(c, F.lit("mine"))
    return out


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (2, None, 1), (3, 0, 1)], LABELS)
    items = spark.createDataFrame([(1, "number 3 jumps over the lazy dog while seventy other animals"), (2, None), (3, ""), (None, "a b")], "item_id long, text string")
    return {
        "quality": lambda d: quality.rated(d, labels),
        "neardup": neardup.rated,
        "leaks": lambda d: decontam.leaks(d, items),
        "lines": linededup.rated,
        "rules": rules.rated,
        "secrets": secrets.scanned,
        "tokens": lambda d: tokencount.counted(d, tokenizer("word_bpe_49k.json")),
        "mix": mixing.mix,
        "rules_filter": rules.filtered,
        "lines_filter": linededup.filtered,
        "neardup_filter": neardup.deduplicated,
        "clean": lambda d: decontam.clean(d, items),
    }


NAMES = ["quality", "neardup", "leaks", "lines", "rules", "secrets", "tokens", "mix", "rules_filter", "lines_filter", "neardup_filter", "clean"]


@pytest.mark.parametrize("name", NAMES)
def test_operator(spark, docs, clashing, nothing, name):
    of = operators(spark)[name]
    plain = of(docs).collect()
    wide = of(clashing).collect()
    assert len(plain) == len(wide)
    assert of(nothing).collect() == []
    if name in ("quality", "neardup", "lines", "rules", "tokens"):
        assert sorted(str(r.doc_id) for r in plain) == sorted(str(r[0]) for r in ROWS)
    if name.endswith("filter") or name == "clean":
        assert of(clashing).columns == [*docs.columns, *CLASH]
        assert all(r.kept == "mine" and r._in == "mine" for r in wide)


def test_rules_defined_results(docs):
    got = {r.doc_id: r for r in rules.rated(docs).collect()}
    assert got[3].base_failed and got[3].n_words == 0 and not got[3].kept
    assert got[1].n_repeat_words == got[2].n_repeat_words and got[7].n_words == 1


def test_lines_one_copy_stays(docs):
    got = {}
    for r in linededup.rated(docs).collect():
        got.setdefault(r.doc_id, r)
    assert got[3].text is None and got[4].text == "" and got[5].n_lines == 0
    assert got[1].n_removed == 0 and got[2].n_removed == 1 and got[2].text == ""
    assert 2 not in {r.doc_id for r in linededup.filtered(docs).collect()}


def test_neardup_defined_results(docs):
    got = {r.doc_id: r for r in neardup.rated(docs).collect()}
    assert (got[2].component_id, got[2].kept) == (1, False)
    assert (got[3].n_shingles, got[3].component_id) == (0, 3) and got[4].kept
    assert (got[None].component_id, got[None].kept) == (None, True)
    assert None in {r.doc_id for r in neardup.deduplicated(docs).collect()}


def test_leak_of_a_null_id_is_dropped(spark):
    d = spark.createDataFrame([(None, "so then one two three four five six seven eight nine ten and more"), (1, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(d, items).collect()] == [(None, 7)]
    assert [r.doc_id for r in decontam.clean(d, items).collect()] == [1]


def test_mix_is_the_same_each_time(docs):
    once = lambda: sorted(map(str, mixing.mix(docs).select("doc_id", "copy_no").collect()))
    assert once() == once()


@pytest.mark.parametrize("stage", range(5))
def test_stage(spark, docs, clashing, nothing, stage, tmp_path):
    spark.createDataFrame([(1, "never said anywhere by anyone in these texts at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    _, f = corpus_pipeline.STAGES[stage]
    for d in (docs, clashing, nothing):
        out = f(spark, d, str(tmp_path))
        assert out.columns[: len(d.columns)] == d.columns
        out.collect()
    assert f(spark, nothing, str(tmp_path)).count() == 0


def test_stages_on_nulls_and_repeats(spark, docs, tmp_path):
    """Which rows each stage keeps, not just that it runs."""
    spark.createDataFrame([(1, "never said anywhere by anyone in these texts at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    every = sorted(str(r[0]) for r in ROWS)
    without_2 = [k for k in every if k != "2"]
    kept = sorted(str(r.doc_id) for r in rules.rated(docs).collect() if r.kept)
    copies = {(r._doc_id, r._size): r._copies for r in mixing.plan_mix(docs).collect()}
    mixed = sorted(str(k) for k, n in [(r[0], copies[r[0], size]) for r, size in ((r, mixing_size(r[1])) for r in ROWS)] for _ in range(n))
    for (name, f), want in zip(corpus_pipeline.STAGES, (kept, without_2, without_2, every, mixed)):
        assert sorted(str(r.doc_id) for r in f(spark, docs, str(tmp_path)).collect()) == want, name


def mixing_size(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_chat_edges(spark):
    rows = [(None, 1, "user", "no id"), (1, None, None, None), (1, 2, "assistant", ""), (1, 2, "assistant", ""), (2, 0, "assistant", "x" * 3_000_000), (3, 0, "assistant", "\\<|end|>\\"), (3, 1, "user", "<|turn|>")]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    path = tokenizer("byte_bpe_50k.json")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(convs, path)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {None: (1, 0), 1: (3, 0), 2: (1, 3_000_000), 3: (2, len("\\<|end|>\\"))}
    assert chat.digests(chat.formatted(convs.filter("conv_id > 9"), path)).collect() == []


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "<article><h1>A title of words</h1><p>a&amp;b <b>c</p><script>x</script>"), (4, "w", "<" * 1000), (4, "w", "text alone")], "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = {r.url: r for r in htmltext.extracted(pages).collect()}
    assert got["u"].text == "" and got[None].n_chars == 0 and got["v"].text == "A title of words a&b c"
    assert htmltext.extracted(pages.filter("page_id > 9")).collect() == []
