"""A corpus pipeline of five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``.

Nulls and repeats: every row is judged by its own id and text, so a rejected row goes though it has no id, and a good one
stays though a bad one has its id. Rows without words fail the quality rules. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, jaccard_join, packing, quality_rules, secret_scan
from quillgraph.llm.common import beside, table, written
from quillgraph.llm.queries import vocabulary


def _key():
    """A row by its id and text, so that rows without an id, and several texts with one id, are judged apart."""
    return F.xxhash64("doc_id", "text", "lang")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not use."""
    while name in docs.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents under their keys, for operators that answer by doc_id."""
    return docs.select(_key().alias("doc_id"), "text", "lang")


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The documents whose key is not among ``gone`` (doc_id)."""
    key = _free(docs, "key")
    rejected = beside(written(gone.select(F.col("doc_id").alias(key)).distinct(), name))
    return docs.withColumn(key, _key()).join(rejected, key, "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _without(docs, quality_rules.judge(_keyed(docs)).filter(~F.col("kept")), "rejected")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id (any, if none has one). Five words, similarity 0.8.

    Rows that are repeated whole are copies, too. Documents without words stay.
    """
    placed = written(jaccard_join.place_documents(docs, words=5, percent=80).filter("component is not null").select("doc_id", "digest", "component"), "placed")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    kept = placed.groupBy("component").agg(F.min(rank).alias("kept"), F.count("*").alias("rows"))
    others = placed.join(kept.filter("rows > 1"), "component").filter(~rank.eqNullSafe(F.col("kept"))).select("doc_id", "digest").distinct()
    twice = placed.groupBy("doc_id", "digest").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id", "digest")
    id, digest = _free(docs, "id"), _free(docs, "digest")
    name = lambda df: beside(df.select(F.col("doc_id").alias(id), F.col("digest").alias(digest)))
    same = (F.col(digest) == jaccard_join.digest()) & F.col(id).eqNullSafe(docs["doc_id"].cast("long"))
    left = docs.join(name(written(others, "copies")), same, "left_anti")
    repeated = name(written(twice, "repeated"))
    once = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, same, "left_anti").unionByName(once).select(docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontaminate.find_leaks(_keyed(docs), table(spark, sf_dir, "benchmark")), "leaks")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's characters are masked; n_chars stays right, as a mask has as many characters."""
    _, findings, _ = secret_scan.scan(docs.select(F.col("doc_id").alias("path"), "text"))
    blob, found = _free(docs, "blob"), _free(docs, "found")
    held = beside(written(findings.select(F.col("blob").alias(blob), F.col("found").alias(found)), "findings"), 100_000)
    own = docs.withColumn(blob, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    return secret_scan.mask(own.join(held, blob, "left"), "text", found).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into windows of 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", leaks), ("secret scans", secrets), ("packing", pack)]

#: Perplexities, edit distances and tokens are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
