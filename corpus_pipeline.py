"""From raw documents to token ids: quality, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written
as Parquet and read again for the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import near_dedup, pii, quality_fm, sentencepiece_bpe, winnowing
from vigil.llm.common import shared_path, table, tokenizer_path, unused

#: A document is rejected when the probability that it is good is below this.
LEAST_QUALITY = 0.5


def small_batches(spark: SparkSession) -> None:
    """This is an application and sets its session: Python workers get texts by 8 MB, not 64, which keeps them small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects. It learns from the labelled ones among ``docs``."""
    small_batches(spark)
    model, score = quality_fm.learn(docs, table(spark, sf_dir, "labels")), unused(docs, "score")
    return quality_fm.score(docs, model, to=score).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates (5-word shingles, similarity 0.8)."""
    small_batches(spark)
    return near_dedup.keep_one(docs, k=5, percent=80).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten words in a row, or a whole shorter item, with the benchmark."""
    small_batches(spark)
    leak = unused(docs, "leak")
    found = winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"), to=leak)
    return found.where(~F.col(leak)["contaminated"]).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by placeholders; ``n_chars`` is that of the new text."""
    small_batches(spark)
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with begin and end."""
    small_batches(spark)
    to = unused(docs, "tokens")
    ids = F.col(to)["ids"]
    found = sentencepiece_bpe.encode(docs, sentencepiece_bpe.read_model(tokenizer_path()), to=to)
    return found.select("doc_id", "lang", "source", ids.alias("ids"), F.size(ids).cast("long").alias("n_tokens"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
