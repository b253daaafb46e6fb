"""A corpus pipeline: each stage applies one operator to all that the last one kept.

Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, exact_dedup, langid, minhash, mixing
from keelson.llm.staging import materialise

#: None: language ID, near-duplicates and BPE are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def of_ids(docs: DataFrame, kept: DataFrame, *also: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id, and columns ``also``, are those of a row of ``kept``; null equals null."""
    ids = kept.select(*[F.col(c).alias(f"_kept_{c}") for c in ("doc_id", *also)])
    same = [docs[c].eqNullSafe(ids[f"_kept_{c}"]) for c in ("doc_id", *also)]
    return docs.join(ids, reduce(and_, same), "left_semi").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; a missing language is filled in with the predicted one.

    Without a labelled row to learn from no language can be told, and all documents with a letter stay.
    """
    model = langid.fit(docs.where(langid.fold() != 1))
    if not model.labels:
        return docs.where(langid.has_letter(F.col("text")))
    said = langid.predict(docs, model, carry=True).where(F.col("lang_pred") != langid.UND)
    row = F.col("row")
    return said.select(*[F.coalesce(row[c], F.col("lang_pred")).alias(c) if c == "lang" else row[c].alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest doc_id stays.

    The verdict is that of a doc_id and its text, so rows that share a doc_id and differ in text have their own.
    """
    digest = free(docs, "text_sha256")
    kept = exact_dedup.content_sort(docs, keep="largest").where("kept").withColumnRenamed("text_sha256", digest)
    return of_ids(docs.withColumn(digest, exact_dedup.digest_of(F.col("text"))), kept, digest).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the smallest doc_id, of a null one only where there is no other.

    Rows get numbers of their own first: a doc_id may repeat or be null.
    """
    row = free(docs, "_row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    said = minhash.near_duplicates(rows, id_col=row).select(row, F.col("component_id").alias("_component")).join(rows.select(row, "doc_id"), row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row))[row]
    kept = said.groupBy("_component").agg(first.alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for; repeats are rows of the same doc_id."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of them and of their decoded text."""
    return bpe.bpe_encode(docs, bpe.default_path())


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
