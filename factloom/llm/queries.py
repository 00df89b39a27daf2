"""The registered query of each corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import crosstok, decontaminate, exact_dedup, language, licenses, media, mixing, pii, quality, simhash, suffix_dedup, url_filter, whitening
from factloom.llm.common import held_out, table

#: (host, path, action) of the rules that the URL query applies.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    told = language.identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return told.select("doc_id", "held_out", "lang_pred", "score")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprints(media.encode(table(spark, sf_dir, "documents")))


#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = "/opt/tokenizers"


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned, _ = crosstok.align(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    spelled = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.select("doc_id", *crosstok.NUMBERS, spelled.alias("groups_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_source_mix": op7_source_mix,
    "op8_licenses": op8_licenses,
    "op9_language": op9_language,
    "op10_media": op10_media,
    "op11_alignment": op11_alignment,
    "op12_whitening": op12_whitening,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL = {
    "op1_url_filter": r"""
        WITH cut AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        ruled AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
                WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
                WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
            FROM cut)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IS NULL OR rule = 'example.com/en/7' THEN 'allow' ELSE 'block' END AS verdict
        FROM ruled""",
    "op13_exact_dedup": r"""
        WITH cut AS (SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
               doc_id = first_value(doc_id) OVER best AS kept, sha256(bare) AS text_sha256
        FROM cut WINDOW best AS (PARTITION BY bare ORDER BY chars DESC, doc_id)""",
}
