import random

import sentencepiece

import corpus_pipeline
from tests.llm.helpers import AWKWARD, documents, store
from tests.llm.test_near_dedup import brute
from tests.llm.test_winnowing import plain
from vigil.llm import pii
from vigil.llm.common import tokenizer_path


def corpus(spark, tmp_path):
    r = random.Random(1)
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(r.randrange(60)) for _ in range(n))
    item = words(25)
    good = [words(r.randint(30, 80)) + "." for _ in range(90)]
    good += [good[0], good[1].upper(), good[2] + " end", words(30) + " mail a@b.org " + words(9), words(20) + " " + item + " " + words(20)]
    bad = [" ".join(w + "!!" for w in words(40).upper().split()) for _ in range(45)]
    texts = [t for pair in zip(good, bad + [None] * len(good)) for t in pair if t] + good[45:]
    sf = store(documents(spark, texts), tmp_path)
    store(spark.createDataFrame([(i, int("!!" not in t), 0) for i, t in enumerate(texts, 1)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    store(spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"), tmp_path, "benchmark")
    return sf, texts, item


def test_stages_and_run(spark, tmp_path):
    sf, texts, item = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.quality(spark, docs, sf).collect()]
    assert {t for _, t in kept} == {t for t in texts if "!!" not in t}
    after = docs.where(docs.doc_id.isin([i for i, _ in kept]))
    one = corpus_pipeline.near_duplicates(spark, after, sf)
    assert one.columns == columns
    groups = brute(kept, 5, 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, g in groups.items() if i == g)
    clean = corpus_pipeline.decontamination(spark, one, sf)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in one.collect() if not plain(r.text, [(1, item)])[4])
    masked = corpus_pipeline.personal_data(spark, clean, sf)
    assert all(r.n_chars == len(r.text) and "@" not in r.text for r in masked.collect()) and masked.columns == columns
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    expected = {r.doc_id: library.encode(pii.masked(r.text), add_bos=True, add_eos=True) for r in clean.collect()}
    assert {i: list(r.ids) for i, r in final.items()} == expected and all(r.n_tokens == len(r.ids) for r in final.values())


def test_awkward_and_empty(spark, tmp_path):
    store(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    store(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    docs = documents(spark, AWKWARD + AWKWARD[:2])
    out = corpus_pipeline.run(spark, store(docs.unionByName(docs.where("doc_id = 4")), tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [r.doc_id for r in docs.collect()]  # no two share all shingles, id 4 stays once
    assert corpus_pipeline.run(spark, store(documents(spark, []), tmp_path)).count() == 0
