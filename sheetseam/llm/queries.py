"""Registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chosen_path, divergence_cube, feistel, hard_negatives, language_id, latent_leaks, ngram_join, one_permutation, piece_table, suffix_merge, tag_path, trie_lm, url_model
from .common import fold, ready, table

URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_leaks.leaks(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(ready(spark), sf_dir, "pages").select("page_id", "url", "html")
    return tag_path.extract(pages, "html").withColumn("n_chars", F.length("text").cast("long"))


#: A deployment passes its own secret; equal values stay linked only under one key.
PII_KEY = "corpus-2024"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    return feistel.pseudonymise(docs, "text", PII_KEY)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_merge.without_repeats(table(ready(spark), sf_dir, "documents").select("doc_id", "text"), "text")
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(ready(spark), sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    out = trie_lm.score_texts(docs, "doc_id", "text", fold("doc_id", 5) != 1, all_pairs=True)
    held_out = F.coalesce(fold("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(ready(spark), sf_dir, "pages").select("page_id", "url")
    return url_model.filter_urls(pages, "url", URL_RULES).select("page_id", "host", "path", "rule", "verdict", "accept_probability")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = piece_table.with_ids(docs, "text", piece_model_path(), keep_cache=True)
    return coded.select("doc_id", *piece_table.digest(F.col("ids"), F.col("decoded")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_permutation.edit_report(table(ready(spark), sf_dir, "documents"), "doc_id", "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(fold("doc_id", 4) != 2), "text", "lang", "doc_id")
    out = language_id.predict(docs, "text", model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(ready(spark), sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(ready(spark), sf_dir, "embeddings")
    noisy = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", noisy.alias("label"), "embedding"), F.expr("id % 100 = 0"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_cube.audit(table(ready(spark), sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_pii": op3_pii,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_url_filter": op7_url_filter,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_fingerprints": op9_fingerprints,
    "op10_language_id": op10_language_id,
    "op11_near_dedup": op11_near_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_divergence_audit": op13_divergence_audit,
}

SQL: dict[str, str] = {
    "op12_hard_negatives": """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.vec, b.vec)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor, id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor AS anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
""",
    "op13_divergence_audit": r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS MATERIALIZED (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
own AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(c)::HUGEINT AS total FROM own GROUP BY lang, source),
rated AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (l.lang_total + 5 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.f, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM rated WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
}
