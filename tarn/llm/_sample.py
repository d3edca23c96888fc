"""Bounded training samples, drawn alike at every size and partitioning of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo: which rows may be learned from. Null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def draw(rows: DataFrame, most: int, column: str = "doc_id") -> DataFrame:
    """At most ``most`` of the distinct rows, those whose ids hash lowest.

    Ids hash evenly, so a threshold set from the number of ids leaves about ``1.25 * most + 500``
    of them before anything is sorted; repeats (a hot id, say) are put together before the shuffle.
    """
    n = rows.agg(F.approx_count_distinct(column, 0.03)).first()[0]
    share = (1.25 * most + 500) / max(n, 1)
    h = F.xxhash64(F.lit(17), column)
    if share < 1:
        rows = rows.where(h < F.lit(int(-(2**63) + share * 2**64)))
    return rows.distinct().orderBy(h, *rows.columns).limit(most)


def texts_of(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """docs joined with drawn rows on doc_id, and ``text_hash``; drawn is broadcast, which its bound allows."""
    own = F.broadcast(drawn.withColumnRenamed("doc_id", "drawn_id"))
    met = docs.join(own, F.col("doc_id") == F.col("drawn_id")).drop("drawn_id")
    return met.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def one_each(rows: DataFrame, by: list[str], *values: str) -> DataFrame:
    """Of rows alike in ``by`` the smallest by text_hash, then values: an id that repeats counts once."""
    least = F.min(F.struct("text_hash", *values)).alias("least")
    return rows.groupBy(*by).agg(least).select(*by, *(F.col(f"least.{v}").alias(v) for v in values))
