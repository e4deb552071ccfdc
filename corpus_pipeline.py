"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes every stage to the shared folder and reads it again, so that a lost executor
costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontamination, jaccard, langid, lz_dedup, packing
from helixframe.llm.shared import discard, materialize
from helixframe.llm.tokens import public_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents a language model can judge: texts with a letter, when some language was learned."""
    carried = docs.select(F.struct(*docs.columns).alias("_row"))
    found = langid.identify(carried, langid.train(docs), text="_row", inside="text")
    return found.where("accepted").select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each near-duplicate class the text of the smallest doc_id; rows without one are kept.

    Different texts under one doc_id are judged each by itself, so that only linked or equal ones go. Of
    linked texts under the smallest doc_id the one of the smallest hash stays, and of rows equal in doc_id
    and text the first as JSON; null text is empty.
    """
    repeated = materialize(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if repeated.isEmpty():
        classes = jaccard.near_duplicates(docs)
        lost = classes.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
        return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)
    # texts under a repeated doc_id go by a hash of both
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("_row")).join(repeated.withColumn("_again", F.lit(True)), "doc_id", "left")
    key = F.when(F.col("_again"), F.xxhash64("doc_id", F.coalesce("_row.text", F.lit("")))).otherwise(F.col("doc_id"))
    keyed = materialize(rows.select(key.alias("doc_id"), "_again", "_row"), "keyed")
    classes = materialize(jaccard.near_duplicates(keyed.select("doc_id", F.col("_row.text").alias("text"))), "classes")
    given = keyed.where("_again").select("doc_id", F.col("_row.doc_id").alias("given")).distinct()
    named = classes.where("doc_id is not null").join(given, "doc_id", "left")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.coalesce("given", "doc_id").alias("given"), "doc_id"))["doc_id"].alias("doc_id")).select("doc_id")
    kept = keyed.join(first, "doc_id", "left_semi")
    once = keyed.where("doc_id is null").unionByName(kept.where("_again is null")).select("_row")
    more = kept.where("_again").groupBy("doc_id").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row")
    return once.unionByName(more).select("_row.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that a smaller doc_id has; a document of which nothing stays goes."""
    found = lz_dedup.remove_passages(docs, with_text=True, carry=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    out = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return out.select(*(columns.get(c, F.col("others")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or a near copy of one.

    Null and empty texts hold none and stay, as do rows with a null doc_id. Rows that share a doc_id go
    together if one of them holds an item.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontamination.find_leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece, with its place.

    Null and empty texts are one piece of their end id; repeated rows and rows with a null doc_id are
    packed as often as they occur.
    """
    return packing.pack(docs, public_path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontaminate), ("packing", pack)]

#: SQL cannot express the stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
