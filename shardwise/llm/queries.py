"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwise.llm import bpe, hamming, langid, media, mixing, near_dup, quality, repeats, secrets, url_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document by speculative BPE, as digests."""
    return bpe.digests(bpe.encode_column(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as an MPEG transport stream and read back, as digests."""
    return media.digests(media.store_texts(table(spark, sf_dir, "documents")))


def op3_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every vector whose id is divisible by 50, among all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    return hamming.search(rows, rows.where("vec_id % 50 = 0"), k=10)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near duplicates: three-word shingles, 85 % in common."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents: toxic, else good or low by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("low")
    return table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", domain.alias("domain"))


#: Target shares of tokens by domain.
MIX = {"good": 0.88, "low": 0.07, "toxic": 0.05}


def op5_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, domain posteriors and rate for the target mix."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), MIX)
    return mixed.select("doc_id", "tokens", *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(sorted(MIX))), "rate", "residual")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; the held-out third is never learned from."""
    documents = table(spark, sf_dir, "documents")
    samples = langid.fit(documents.where(~langid.held_out()))
    return langid.identify(documents, samples).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


# The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, winning rule and verdict."""
    return url_rules.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight and whether resampling keeps it."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, as counts, a digest and spans."""
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that also start elsewhere, as digests."""
    return repeats.digests(repeats.remove_repeats(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe_codec,
        op2_transport_streams,
        op3_hamming_search,
        op4_near_duplicates,
        op5_mixing_rates,
        op6_language_id,
        op7_url_verdicts,
        op8_importance_resampling,
        op9_secret_spans,
        op10_repeated_strings,
    )
}
ORACLES: dict[str, str] = {
    "op3_hamming_search": """
        WITH coded AS (SELECT vec_id AS id, list_transform(embedding, lambda x: coalesce(x > 0, false)) AS code FROM embeddings WHERE len(embedding) = 64),
        pairs AS (
            SELECT q.id AS query_id, r.id AS neighbor_id,
                   list_sum(list_transform(list_zip(q.code, r.code), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INT AS distance
            FROM coded q, coded r WHERE q.id % 50 = 0),
        ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank, neighbor_id, distance FROM pairs)
        SELECT * FROM ranked WHERE rank <= 10""",
    "op4_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)])
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
        classes AS (SELECT min(doc_id) AS c, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
        shingles AS (SELECT c, len(s) AS n, unnest(s) AS g FROM classes),
        links AS (
            SELECT a.c AS x, b.c AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(c, r) AS (SELECT c, c FROM classes UNION SELECT b.y, r.r FROM reach r JOIN sides b ON b.x = r.c WHERE r.r <= b.y),
        roots AS (SELECT c, min(r) AS r FROM reach GROUP BY c)
        SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(roots.r, sets.doc_id) AS component_id, sets.doc_id = coalesce(roots.r, sets.doc_id) AS kept
        FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s AND len(sets.s) > 0 LEFT JOIN roots ON roots.c = classes.c""",
    "op7_url_verdicts": """
        WITH parts AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
        lowered AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split),
        rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (
            SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
            FROM lowered JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(fits.verdict, 'allow') AS verdict FROM lowered LEFT JOIN fits USING (page_id)""",
}
