"""Exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters and sorted on disk, so that equal texts lie next to each
other; neighbours are compared in full and one identifier of each run stays. A text travels once. What is joined
afterwards are a digest, an identifier and a count.

A text that more than a thousandth of all rows share would fill a partition of its own. Its rows are dealt to as many
parts as it has such shares (skew.py), and the parts' results, at most 2000 rows whatever the table, are merged by full text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import skew
from keelson.llm.staging import documents, materialise

#: Characters of a text that splitters are made of.
SPLIT_CHARS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digest_of(text: Column) -> Column:
    """``text_sha256`` of a text: that of its lower-cased form."""
    return F.sha2(F.encode(lower_ascii(text), "UTF-8"), 256)


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "smallest" or "largest": which identifier of equal texts stays.
    Null texts equal empty ones. Repeated identifiers stay as rows of their own
    and are all kept if theirs is the identifier that stays. A null identifier
    stays only where equal texts have no other; all such rows are then kept. An empty
    table gives an empty one. Texts of any length are compared as a whole.
    Other columns are ignored, whatever their names.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("_id"), lower_ascii(F.col(text_col)).alias("_norm")).withColumn("_h", F.xxhash64("_norm"))
    keyed = materialise(rows.select("_id", "_h", F.sha2(F.encode("_norm", "UTF-8"), 256).alias("text_sha256")))
    large = skew.large_keys(keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("n")), ["_h"], keyed.count())
    # The driver sees a sample of the splitting keys, so these hold the first characters only; order and equality are
    # those of whole texts. All splitting keys are grouping keys: the runs need no further exchange.
    keys = ["_head", "_h", "_part", "_parts"]
    head = lower_ascii(F.substring(F.col(text_col), 1, SPLIT_CHARS))
    texts = docs.select(F.col(id_col).alias("_id"), head.alias("_head"), lower_ascii(F.col(text_col)).alias("_norm")).withColumn("_h", F.xxhash64("_norm"))
    placed = skew.dealt(texts, ["_h"], large).repartitionByRange(*keys).sortWithinPartitions(*keys, "_norm")
    # first() needs the rows in order: it keeps the sort, and makes Spark compare neighbours.
    runs = placed.groupBy(*keys, "_norm").agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.first("_norm").alias("_text"))
    small = runs.select(F.sha2(F.encode("_text", "UTF-8"), 256).alias("text_sha256"), F.when(F.col("_parts") > 0, F.col("_text")).alias("_dealt"), "_parts", "keep_id", "n")
    whole = small.groupBy("text_sha256", "_dealt", "_parts").agg(best("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # Rows of a text that was dealt out meet a copy of its result in each part.
    every_part = whole.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest("_parts", F.lit(1)) - 1)))
    out = skew.dealt(keyed, ["_h"], large).select("_id", "text_sha256", "_part").join(every_part.select("text_sha256", "_part", "keep_id", "group_size"), ["text_sha256", "_part"])
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(documents(spark, sf_dir), keep="largest")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
