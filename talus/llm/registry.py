"""Queries of this subpackage, one for each operator, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm import op10_decontaminate as op10
from talus.llm import op1_url_filters as op1
from talus.llm import op2_substring_dedup as op2
from talus.llm import op3_chat_format as op3
from talus.llm import op4_warc as op4
from talus.llm import op5_token_counts as op5
from talus.llm import op6_quality_classifier as op6
from talus.llm import op7_simhash as op7
from talus.llm import op8_quality_rules as op8
from talus.llm import op9_sentencepiece as op9
from talus.llm import sql
from talus.llm.storage import keep
from talus.llm.tables import read
from talus.llm.vocabulary import default_model


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    edges = keep(op1.page_edges(pages), "links")
    return op1.judge(pages.select("page_id", "url"), URL_RULES, edges).select("page_id", "host", "path", "rule", "verdict")


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on pages with a table of redirects: each url redirects to its path on one mirror, so pages with the same path
    are aliases of each other and of the mirror's page, and what blocks one of them blocks those that no rule fits."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    url = F.col("url")
    mirror = F.concat(F.lit("http://mirror.example.net"), op1.path_of(url))
    redirects = pages.select(op1.alias_key(url).alias("src"), op1.alias_key(mirror).alias("dst"))
    return op1.judge(pages, URL_RULES, redirects).select("page_id", "host", "path", "rule", "verdict", "from_alias")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    order = ("turn", "copy")
    log = op3.stream(rows.union(more).withColumn("copy", F.row_number().over(same)), order)
    return op3.digest(op3.render(op3.fold(log, order), order))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = op4.write_packages(read(spark, sf_dir, "pages"), min_bytes=0)
    return op4.resolve(keep(op4.read_records(op4.record_ranges(packages), payloads=False), "records"))


def op5_token_counts(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return op5.count_tokens(docs, model_file or default_model(), drop=("text",))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    third = lambda doc_id: F.crc32(doc_id.cast("string").cast("binary")) % 3
    rules = op6.fit(docs, read(spark, sf_dir, "labels"), where=lambda doc_id: third(doc_id) != 1)
    scored = op6.classify(docs, rules, drop=("text",))
    return scored.select("doc_id", F.coalesce(third(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = keep(op7.fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",)), "simhash")
    text = F.lower(F.lpad(F.hex("simhash"), 16, "0"))
    return op7.near_duplicates(marked).select("doc_id", text.alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return op8.judge(docs, op8.train(docs, read(spark, sf_dir, "labels")), drop=("text",))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return op9.digest(docs, model_file or default_model(), drop=("text",))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return op10.decontaminate(docs, read(spark, sf_dir, "benchmark"), drop=("text",))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "url_aliases": url_aliases,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_chat_format": op3_chat_format,
        "op4_warc": op4_warc,
        "op5_token_counts": op5_token_counts,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_simhash": op7_simhash,
        "op8_quality_rules": op8_quality_rules,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {name: getattr(sql, name.upper()) for name in queries() if hasattr(sql, name.upper())}
