"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import chat_template, cross_tokens, lm_bloom, near_dedup, pii, quality_fm, quality_rules, secrets, sentencepiece_bpe, url_rules, warc, whitening, winnowing
from vigil.llm.common import shared_path, table, tokenizer_path


def op1_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document, learned from four fifths of them."""
    return lm_bloom.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url. A page has the label of the document that it holds, whose number ends its path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(url_rules.path(F.col("url")), url_rules.NUMBER, 1).try_cast("long").alias("doc_id")
    labels = pages.select("page_id", number).join(table(spark, sf_dir, "labels"), "doc_id").select("page_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_rules.judge(pages, labels).select("page_id", "host", "path", "rule", "verdict")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sentencepiece_bpe.digests(docs, sentencepiece_bpe.read_model(tokenizer_path()))
    return found.select("doc_id", "tokens.n_tokens", "tokens.ids_sha256", "tokens.decoded_sha256")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, as counts, a digest and spans."""
    found = secrets.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "secrets.*")


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a factorisation machine learned from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_fm.judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and whether the rules keep it."""
    found = quality_rules.keep(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, as counts, a digest and spans."""
    found = pii.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "pii.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of every document by 3-word shingles at a similarity of 0.85."""
    found = near_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back as a capture."""
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.captures(spark, path)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "leak.n_words", "leak.n_hit", "leak.n_items", "leak.items_sha256", "leak.contaminated")


#: A conversation that says what the template's control strings look like: id, turn, role, text.
TRICKY = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def op11_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted by the compiled template and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string"))
    return chat_template.digests(chat_template.format(turns), in_order=True)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first four components of the distinct quantised ones."""
    return whitening.components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers overlap in every document, and how common their linked pairs are in all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    a, b = (cross_tokens.read_file(tokenizer_path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = cross_tokens.judge(docs, a, b, keep=["doc_id"])
    return found.select("doc_id", *(f"aligned.{c}" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")))


def queries() -> dict:
    return {
        "op1_lm_bloom": op1_lm_bloom,
        "op2_url_rules": op2_url_rules,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_secrets": op4_secrets,
        "op5_quality_fm": op5_quality_fm,
        "op6_quality_rules": op6_quality_rules,
        "op7_pii": op7_pii,
        "op8_near_dedup": op8_near_dedup,
        "op9_warc": op9_warc,
        "op10_winnowing": op10_winnowing,
        "op11_chat_template": op11_chat_template,
        "op12_whitening": op12_whitening,
        "op13_cross_tokens": op13_cross_tokens,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_rules": url_rules.oracle(), "op6_quality_rules": quality_rules.oracle(), "op8_near_dedup": near_dedup.oracle(), "op9_warc": warc.oracle(), "op10_winnowing": winnowing.oracle(), "op11_chat_template": chat_template.oracle(TRICKY)}
