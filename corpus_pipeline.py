"""A corpus from raw documents to packed sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.

Null or empty texts, very long ones and empty tables follow the operators'
rules, and columns of any name pass through.  Of rows repeated with one id and
equal text one stays after exact deduplication, of rows with one id and other
texts each is decided by its own text there.  The later stages decide by id:
rows of one id stay or go together, and a null id is never dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import decontamination, exact_dedup, ngram_join, packing, quality
from tickweave.llm.queries import table, word_tokens
from tickweave.workspace import drop_tables, materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.7 or more."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality")
    return quality.keep_good(docs, model, 0.7)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``ids`` (a column doc_id)."""
    return docs.alias("all").join(ids.alias("gone"), F.col("all.doc_id") == F.col("gone.doc_id"), "left_anti")


def one_per_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that stays of each group of equal texts."""
    decided = materialise(exact_dedup.exact_dedup(docs), "decided")
    several = decided.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    several = materialise(several, "several")
    single = without(docs.where(F.col("doc_id").isNotNull()), decided.where("not kept").select("doc_id"))
    if several.isEmpty():
        return single
    # An id that occurs more than once: its rows are told apart by their texts.
    row, text = F.struct(*docs.columns).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.sha2(exact_dedup.normalised(F.col("text")), 256).alias("digest"), F.char_length(text).alias("points"))
    kept = decided.where("kept").join(several, decided["doc_id"].eqNullSafe(several["doc_id"]), "left_semi").select("doc_id", "text_sha256").distinct()
    rows = rows.join(kept, rows["id"].eqNullSafe(kept["doc_id"]) & (rows["digest"] == kept["text_sha256"]), "left_semi")
    once = rows.groupBy("id", "digest").agg(F.max_by("row", "points").alias("row")).select("row.*")
    return without(single, several).unionByName(once)


def one_per_component(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of near duplicates (five words, similarity 0.8)."""
    groups = ngram_join.ngram_components(docs, ngram_join.Similarity(n=5, num=80, den=100))
    return without(docs, groups.where("doc_id <> component_id").select("doc_id").distinct())


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens."""
    return packing.pack(docs, word_tokens(), 4096)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", one_per_text),
    ("n-gram Jaccard join", one_per_component),
    ("benchmark decontamination", no_benchmark),
    ("best-fit packing", packed),
]

#: No SQL: the classifier, the components and the plan of the packing are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        docs = materialise(result, name.replace(" ", "-"))
        drop_tables(result)  # what the stage read and wrote on the way
    return STAGES[-1][1](spark, docs, sf_dir)
