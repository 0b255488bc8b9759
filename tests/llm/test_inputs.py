"""Long texts, repeated rows, ties, nulls, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import store
from vigil.llm import cross_tokens, lm_bloom, near_dedup, pii, quality_fm, quality_rules, secrets, sentencepiece_bpe, url_rules, warc, winnowing
from vigil.llm.common import shared_path, tokenizer_path

LONG = " ".join(f"Word{i % 977} and{i % 13}" for i in range(60_000))
TEXTS = [None, "", "same text of a few words", "same text of a few words", LONG, LONG + " end", "x" * 200_000]
#: Names that operators use inside or add, and one that differs from a column by case alone in an added one.
NAMES = ("key", "own", "rest", "_key", "_rest", "_least", "_own", "row", "h", "c", "node", "version", "stratum", "rule", "cutoff_marks", "_text", "_words", "kept", "tokens", "leak", "sketch", "bands", "_score", "_leak", "_tokens", "_payload", "_row", "given")


def documents(spark, clash=True):
    rows = [(i, t, "en", "src", 0) for i, t in enumerate(TEXTS, 1)] + [(3, TEXTS[2], "en", "src", 0), (None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("own").alias(n) for n in NAMES)) if clash else df


def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (3, 1, 0), (3, 0, 1), (5, 1, 0), (6, 1, 0), (7, 0, 0), (8, None, None)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "word1 and1 word2 and2 word3 and3 word4 and4 word5 and5"), (2, None), (3, "few words")], "item_id long, text string")


def model():
    return sentencepiece_bpe.read_model(tokenizer_path())


def tokenizers():
    return [cross_tokens.read_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


#: Operator: function of (spark, documents), and whether it gives a row for each row.
OPERATORS = {
    "lm_bloom": (lambda s, d: lm_bloom.score(d), False),
    "sentencepiece": (lambda s, d: sentencepiece_bpe.encode(d, model(), to="found"), True),
    "secrets": (lambda s, d: secrets.find(d, to="found"), True),
    "quality_fm": (lambda s, d: quality_fm.judge(d, labels(s)), True),
    "quality_rules": (lambda s, d: quality_rules.keep(d, labels(s)), False),
    "cross_tokens": (lambda s, d: cross_tokens.align(d, *tokenizers(), to="found"), True),
    "pii": (lambda s, d: pii.find(d, to="found"), True),
    "near_dedup": (lambda s, d: near_dedup.groups(d), False),
    "winnowing": (lambda s, d: winnowing.decontaminate(d, benchmark(s), to="found"), True),
    "winnowing_joined": (lambda s, d: winnowing.decontaminate(d, benchmark(s), to="found", bound=0), True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    f, adds = OPERATORS[name]
    docs = documents(spark)
    found = f(spark, docs)
    rows = found.collect()
    assert len(rows) == len(TEXTS) + 2
    if adds:
        assert set(docs.columns) <= set(found.columns) and all(r.own == "own" and r._key == "own" and r.h == "own" for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append({c: r[c] for c in found.columns if c not in ("doc_id", "text", "held_out", "version")})
    assert by_id[3][0] == by_id[3][1]  # repeated rows
    if adds and name != "quality_fm":
        assert by_id[1][0]["found"] == by_id[2][0]["found"] or by_id[1][0]["found"] is None  # null and empty
    assert f(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, tmp_path, k):
    name, stage = corpus_pipeline.STAGES[k]
    store(labels(spark), tmp_path, "labels")
    sf = store(benchmark(spark), tmp_path, "benchmark")
    docs = documents(spark)
    out = stage(spark, docs, sf)
    rows = out.collect()
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns and all(r._score == r._leak == r.own == "own" for r in rows)
    assert (k == 0 or rows) and len(rows) <= docs.count() and stage(spark, docs.limit(0), sf).count() == 0


def test_warc_and_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.org/" + "p/" * 3000, LONG), (1, "http://a.org/x", LONG), (2, None, None), (None, "http://b.com/y", "z")], "page_id long, url string, html string")
    pages = pages.select("*", *(F.lit("own").alias(n) for n in NAMES))
    path = shared_path(spark, "warc-test")
    warc.write(pages, path)
    assert warc.captures(spark, path).count() == 4
    judged = url_rules.judge(pages, spark.createDataFrame([(1, True), (1, False), (9, None)], "page_id long, bad boolean"))
    assert judged.count() == 4 and all(r.own == r._key == "own" for r in judged.collect())
    warc.write(pages.limit(0), shared_path(spark, "warc-empty"))
    assert url_rules.judge(pages.limit(0), spark.createDataFrame([], "page_id long, bad boolean")).count() == 0


def test_long_text_is_searched_to_its_end(spark):
    end = " mail me@example.org password=abcdef123 word1 and1 word2 and2 word3 and3 word4 and4 word5 and5"
    docs = spark.createDataFrame([(1, LONG.replace("Word1 and1", "Word1 x") + end)], "doc_id long, text string")
    at = len(docs.first().text)
    assert pii.find(docs).first().pii[-1].start > at - 200 and secrets.find(docs).first().secrets[-1].start > at - 200
    assert winnowing.decontaminate(docs, benchmark(spark)).first().leak.n_hit >= 10
    ids = sentencepiece_bpe.encode(docs, model()).first().tokens
    assert ids.decoded.endswith(end) and len(ids.decoded) == at
