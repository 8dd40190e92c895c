"""Exact deduplication: 128-bit content hash, one stable row per text, bytes compared.

DataFrame operations only. Texts never meet in one task per group: the first aggregate
keys on (hash, text) and so combines copies before the shuffle, and documents find their
group again through a join of narrow rows, which adaptive execution splits at hot hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut


def _content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], extra: list[Column]) -> DataFrame:
    norm = docs.select(*extra, F.col(id_col).alias("__id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__norm"))
    return norm.withColumn("__hash", digest(F.col("__norm")))


def _groups(keyed: DataFrame, keep: str) -> tuple[DataFrame, bool]:
    """(hash, text or null, keep_id, size) per distinct text, and whether any hash collides.

    The text is carried only for hashes that more than one text shares, so the table is
    narrow unless the hash is weak.
    """
    best = F.max if keep == "max" else F.min
    texts = keyed.groupBy("__hash", "__norm").agg(F.count(F.lit(1)).alias("__size"), best("__id").alias("__keep"))
    alone = texts.groupBy("__hash").agg(F.count(F.lit(1)).alias("__texts"), best("__keep").alias("__keep"), F.sum("__size").alias("__size"))
    alone = cut(alone)
    if alone.where("__texts > 1").isEmpty():
        return alone.select("__hash", F.lit(None).cast("string").alias("__same"), "__keep", "__size"), False
    shared = texts.join(alone.where("__texts > 1").select("__hash"), "__hash", "left_semi").select("__hash", F.col("__norm").alias("__same"), "__keep", "__size")
    return cut(alone.where("__texts = 1").select("__hash", F.lit(None).cast("string").alias("__same"), "__keep", "__size").union(shared)), True


def _matched(keyed: DataFrame, groups: DataFrame, collides: bool, how: Column | None = None) -> DataFrame:
    groups = groups.withColumnRenamed("__hash", "__of")
    on = F.col("__hash") == F.col("__of")
    if collides:
        on = on & (F.col("__same").isNull() | (F.col("__same") == F.col("__norm")))
    return keyed.join(groups, on if how is None else on & how)


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether an id stands on more than one row; reads the id column alone."""
    return not docs.groupBy(F.col(id_col).alias("__id")).count().where("count > 1").isEmpty()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Callable[[Column], Column] = _content_hash) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null
    and empty texts form one group. keep says whether the smallest ("min") or largest
    ("max") id of equal texts stays. Rows that repeat both id and text count towards
    group_size, and exactly one of them is kept. A null id is never preferred; a group of
    null ids only has keep_id null and one kept row. digest may be any hash: texts that
    share a hash are told apart by their bytes. Other columns are ignored. Empty in, empty out.
    """
    keyed = _keyed(docs, id_col, text_col, digest, []).withColumn("__sha", F.sha2(F.col("__norm").cast("binary"), 256))
    groups, collides = _groups(keyed, keep)
    found = _matched(keyed if collides else keyed.drop("__norm"), groups, collides)
    kept = F.col("__id").eqNullSafe(F.col("__keep"))
    if _repeats(docs, id_col):
        first = F.row_number().over(Window.partitionBy("__id", "__sha").orderBy(F.lit(1)))
        kept = kept & (first == 1)
    return found.select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), kept.alias("kept"), F.col("__sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Callable[[Column], Column] = _content_hash) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    keyed = _keyed(docs, id_col, text_col, digest, [whole])
    groups, collides = _groups(keyed.drop("__row"), keep)
    found = _matched(keyed if collides else keyed.drop("__norm"), groups, collides, F.col("__id").eqNullSafe(F.col("__keep")))
    if _repeats(docs, id_col):
        found = found.dropDuplicates(["__id", "__hash"] + (["__norm"] if collides else []))
    return found.select("__row.*")
