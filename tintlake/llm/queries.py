"""The driver's queries over the operators of this subpackage, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tintlake.llm import decontaminate, html_text, jaccard_join, packing, progressive, quality, secret_scan, toxicity, url_filter, warc
from tintlake.llm.shared import table

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "block"), ("org/es/", "block")]


def tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = warc.build_index(warc.write_archives(table(spark, sf_dir, "pages")))
    return warc.read_captures(directory, keep_payload=False).drop("url")


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = progressive.store(table(spark, sf_dir, "documents"))
    return progressive.load(media).drop("error")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "expected_grade", "tail_probability", "keep")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_extraction, op2_warc, op3_progressive_jpeg, op4_secret_scan, op5_quality_classifier, op6_url_filter, op7_toxicity, op8_jaccard_join, op9_decontamination, op10_best_two_fit)}

ORACLE_SQL: dict[str, str] = {
    "op6_url_filter": r"""
        with parts as (
            select page_id, coalesce(nullif(regexp_extract(url, '://([^/?#]*)', 1), ''), '') as raw_host,
                coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
        hosts as (select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts),
        rules(host_part, path_part, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        fits as (
            select page_id, max_by(host_part || path_part, length(host_part || path_part)) as rule, max_by(verdict, length(host_part || path_part)) as verdict
            from hosts join rules on (host = host_part or ends_with(host, '.' || host_part)) and starts_with(path, path_part) group by page_id)
        select h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') as verdict from hosts h left join fits f using (page_id)""",
}
