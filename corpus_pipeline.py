"""Corpus pipeline: documents in, cleaned and tokenised documents out, in ``STAGES``.

A stage is ``(name, function)``; its function takes ``(spark, docs, sf_dir)`` and returns the rows that stay, with the columns of documents
(the last one: the tokenised texts).  Extra columns pass through, null texts are handled as each operator says, rows with a null
id are kept by the stages that compare documents.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetseam.llm import feistel, language_id, latent_leaks, ngram_join, piece_table
from sheetseam.llm.common import ready, table, written
from sheetseam.llm.queries import PII_KEY, piece_model_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and those whose language is no better than a guess among the labels.

    A missing label is filled with the prediction."""
    ready(spark)
    model = language_id.train(docs, "text", "lang", "doc_id")
    least = 1.1 / len(model.labels) if model and len(model.labels) > 1 else 0.0
    found = language_id.predict(docs, "text", model, "__lang", "__score")
    kept = found.where((F.col("__lang") != language_id.UNDETERMINED) & (F.col("__score") >= least))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).drop("__lang", "__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group; of rows with one id the smallest."""
    ready(spark)
    found = ngram_join.near_duplicates(docs, "doc_id", "text")
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    same = docs.hint("merge").join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("__row"))
    one = same.select(*(F.col("doc_id") if c == "doc_id" else F.col("__row").getField(c).alias(c) for c in docs.columns))
    return one.unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak an item of the benchmark."""
    ready(spark)
    return latent_leaks.with_leaks(docs, table(spark, sf_dir, "benchmark"), name="__leaks").where(F.size("__leaks") == 0).drop("__leaks")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values by pseudonyms; ``n_chars`` follows the text."""
    ready(spark)
    return feistel.pseudonymise(docs, "text", PII_KEY, counts=False).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (with an end id), their number, and the text that they decode to."""
    ready(spark)
    coded = piece_table.with_ids(docs, "text", piece_model_path())
    return coded.select("doc_id", "lang", "source", F.col("decoded").alias("text"), "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("SentencePiece encoding and decoding", tokens),
]

#: Language ID, retrieval and tokenisation cannot be written in SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
