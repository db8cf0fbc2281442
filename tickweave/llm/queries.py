"""The queries of the training-data operators, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import decontamination, license_scan, line_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokens():
    import public_tokenizers

    from tickweave.llm.packing import Tokens

    return Tokens(public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickweave.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickweave.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), word_tokens(), 4096)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickweave.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=24)


OP1_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents),
r as (
  select doc_id, norm,
         first_value(doc_id) over (partition by norm order by length(text) desc, doc_id) as keep_id,
         count(*) over (partition by norm) as group_size
  from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op7_sharding": op7_sharding,
}
ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL}


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickweave.llm.ngram_join import Similarity, ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), Similarity(n=4, num=85, den=100))


QUERIES["op9_ngram_jaccard_join"] = op9_ngram_jaccard_join


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickweave.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickweave.llm.decontamination import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickweave.llm.line_dedup import drop_common_lines

    return drop_common_lines(table(spark, sf_dir, "documents"))


QUERIES |= {"op5_license_scan": op5_license_scan, "op8_decontamination": op8_decontamination, "op10_line_dedup": op10_line_dedup}
ORACLE_SQL |= {"op5_license_scan": license_scan.ORACLE_SQL, "op8_decontamination": decontamination.ORACLE_SQL, "op10_line_dedup": line_dedup.ORACLE_SQL}


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickweave.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality")
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out_quality().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickweave.llm import language_id

    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out_language().alias("held_out"), "lang_pred", "score")


QUERIES |= {"op3_quality_classifier": op3_quality_classifier, "op6_language_id": op6_language_id}


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickweave.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES["op2_html_extraction"] = op2_html_extraction
