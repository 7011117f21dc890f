"""Labelled rows for operators that learn: the fold that may be learned from, and bounded samples of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that are only scored: crc32 of doc_id as text, modulo 5, is 0 (a null doc_id counts as empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of every document that may be learned from; one that is labelled 0 and 1 counts as 1."""
    usable = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    return usable.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))


def label_counts(labels: DataFrame, column: str) -> tuple[int, int]:
    """Learnable documents with label 0 and 1."""
    r = learnable(labels, column).agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    return int(r[0]), int(r[1])


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, text_bytes: int, class_bytes: int) -> DataFrame:
    """(doc_id, y, text): at most per_class learnable documents of each class, those of least hash, of texts up to text_bytes
    long, as many as hold class_bytes together. Ids are chosen in the narrow label table; only they (a bounded number) are
    broadcast to find their texts. Of several rows with one doc_id the least text counts, so the result is bounded."""
    order = (F.xxhash64("doc_id", F.lit(column)), F.col("doc_id"))
    usable = learnable(labels, column)
    ids = usable.filter("y = 0").orderBy(*order).limit(per_class).unionByName(usable.filter("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= text_bytes)
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("_so_far", so_far).filter(F.col("_so_far") <= class_bytes).select("doc_id", "y", "text")
