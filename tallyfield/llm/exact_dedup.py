"""Exact dedup by 128-bit content hash, with the bytes compared inside every group.

Only DataFrame functions. Rows are grouped by hash *and* text, so the bytes are compared by the aggregate itself:
map-side it folds a task's copies into one row, a hot text costs each task one row, and equal hashes of
different bytes come out as different groups. The rows then find their group by the hash alone; only where a
hash has several texts (tests use a weak hash for that) are they matched by the text as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import rewritten


def content_hash(text: Column) -> Column:
    """128 bits as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                     hash_of=content_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text equals the empty one. ``keep`` is ``"min"`` or
    ``"max"``: which id stays. Null ids never stay while the group has another id. Rows that repeat an id
    and a text each count in group_size; each of them is kept if its id is the one that stays. An empty
    table gives no rows. Other columns are not read.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    light = rewritten(rows.select("doc_id", hash_of(F.col("text")).alias("h"),
                                  F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")))
    members = rows.withColumn("h", hash_of(F.col("text")))
    classes = rewritten(
        members.groupBy("h", "text").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .drop("text"))
    collided = rewritten(classes.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"))
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    if collided.isEmpty():  # every hash has one text: the texts are not moved again
        return _marked(light.join(classes.select("h", "keep_id", "group_size"), "h", "left").select(*columns))
    alone = classes.join(collided, "h", "left_anti").select("h", "keep_id", "group_size")
    simple = light.join(collided, "h", "left_anti").join(alone, "h", "left").select(*columns)
    apart = (members.join(collided, "h", "left_semi").groupBy("h", "text")
             .agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
             .join(members.select("doc_id", F.col("h").alias("own_h"), F.col("text").alias("own")),
                   (F.col("h") == F.col("own_h")) & (F.col("text") == F.col("own")))
             .select("doc_id", "keep_id", "group_size",
                     F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")))
    return _marked(simple.unionByName(apart))


def _marked(whole: DataFrame) -> DataFrame:
    size = F.coalesce("group_size", F.lit(1))
    keep_id = F.when(size == 1, F.col("doc_id")).otherwise(F.col("keep_id"))
    return whole.select("doc_id", keep_id.alias("keep_id"), size.cast("long").alias("group_size"),
                        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")
