"""Every operator and stage on nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stumpwright.llm import chat, decontaminate, html_extract, langid, ngram_join, packing, pii, quality, substring_dedup, token_store
from stumpwright.llm.common import shared_dir

LONG = " ".join(f"word{i % 977} text{i % 31}." for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (None, "one two three four five six", "en", "a", 5), (4, LONG, "en", "b", len(LONG)),
    (5, LONG, "de", "b", len(LONG)), (5, LONG, "de", "b", len(LONG)), (6, "un deux trois quatre cinq six sept huit neuf dix onze", "fr", "c", 9),
    (7, "ab", "fr", None, 2), (8, " \n\t ", "fr", "c", 4), (9, "\U0001f600 café 中文 x@y.org", "fr", "c", 9),
]
EXTRA = ("h", "n", "t", "rep", "m", "u", "v", "w", "body", "stream", "blocks", "kept", "part", "occ", "row", "n_tokens", "bin_offset", "share", "rn", "before", "copies", "links", "parent", "comp", "h1", "text_", "doc_id_", "node", "bands", "key", "k", "kind", "group", "bin", "size", "cluster", "host", "rest", "gone", "first", "last", "root", "class_id")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "un deux trois quatre cinq six sept huit neuf dix"), (2, None), (None, "one two three"), (3, " . ")], "item_id long, text string")


def _tokens(path):
    import public_tokenizers

    def run(d):
        token_store.write(d, path, public_tokenizers.path("byte_bpe_50k.json"))
        return token_store.digest(d.sparkSession, path, token_store.stored_keys(d.sparkSession, path))

    return run


def _runs(spark, items):
    return {
        "tokens": lambda d: _tokens(shared_dir(spark))(d),
        "pii": lambda d: pii.mask(d, b"k"),
        "ngrams": ngram_join.join,
        "leaks": lambda d: decontaminate.digest(decontaminate.scan(d, items)),
        "langid": langid.identify,
        "quality": quality.measure,
        "substring": substring_dedup.dedup,
    }


@pytest.mark.parametrize("name", ["tokens", "pii", "ngrams", "leaks", "langid", "quality", "substring"])
def test_one_row_per_document(spark, docs, wide, items, name):
    run = _runs(spark, items)[name]
    out = [tuple(map(str, r)) for r in run(docs).collect()]
    assert len(out) == len(ROWS)
    assert sorted(out) == sorted(tuple(map(str, r)) for r in run(wide).collect())
    assert run(docs.limit(0)).count() == 0


def test_defined_results(spark, docs, items):
    n = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    assert (n[1].class_id, n[1].n_links) == (1, 0) and (n[2].class_id, n[2].n_links) == (2, 0) and n[5].class_id == 4 and n[5].n_links == 2
    assert n[None].class_id is None
    d = {r.doc_id: r for r in decontaminate.scan(docs, items).collect()}
    assert (d[1].n_words, d[6].n_hit, d[6]["items"]) == (0, 10, ["1"]) and (d[None].n_hit, d[None]["items"]) == (3, [])
    lang = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert lang[1] == lang[2] == lang[8] == ("und", 0.0)
    q = {r.doc_id: r for r in quality.measure(docs).collect()}
    assert q[1].base_failed and q[2].n_words == 0 and not q[7].kept
    s = {r.doc_id: r for r in substring_dedup.dedup(docs).collect()}
    assert s[1].text is None and s[4].n_removed <= s[5].n_removed and s[5].text == ""
    p = packing.sequences(docs)
    assert sorted(map(str, p.collect())) == sorted(map(str, packing.sequences(docs.withColumns({c: F.lit(1) for c in EXTRA})).collect()))
    got = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in got}[4] == 60_000 and p.where("bin is null").count() == 3
    assert packing.sequences(docs.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, sf, tmp_path, k):
    name, stage = corpus_pipeline.STAGES[k]
    for d in (docs, docs.limit(0), docs.withColumns({c: F.lit(1) for c in ("h", "n", "n_tokens", "row", "k", "cluster", "size")})):
        out = stage(spark, d, sf)
        rows = out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == d.columns and len(rows) <= d.count()
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).count() == 0


def test_chat_and_pages(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", "b"), (1, None, None, "x"), (None, 2, "assistant", ""), (2, 1, "a\nb\\", "<|im_sep|>\\|<|")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.formatted(turns.withColumns({c: F.lit(1) for c in ("ts", "t", "starts", "blocks", "formatted", "loss_runs")})).select("conv_id", chat.turns_of(F.col("formatted")).alias("turns")).collect()}
    assert out == {1: [("", "x"), ("user", ""), ("user", "b")], None: [("assistant", "")], 2: [("a\nb\\", "<|im_sep|>\\|<|")]}
    assert chat.digest(chat.formatted(turns.limit(0))).count() == 0
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "http://h/", ""), (3, "http://h/", "<article>" + "w " * 200_000 + "</article>"), (4, "x", "no tags &lt;")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.text[:9], r.n_chars) for r in html_extract.extract(pages.withColumns({c: F.lit(1) for c in ("host", "stream", "rest", "blocks", "kept", "body", "size", "part", "text")})).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("3", "w w w w w", 399_999), ("4", "no tags <", 9), ("None", "", 0)]
    assert html_extract.extract(pages.limit(0)).count() == 0
