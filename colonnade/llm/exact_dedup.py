"""Exact deduplication by skew-safe combining.

Copies meet in three steps, each a grouping on the whole normalised text (digest first, content
always compared): within a task before anything moves (partial aggregation), within salted digest
groups, and between the salts' winners. A group of any size thus arrives at a reducer as one row
per task, and as one row per salt at the last step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.llm.common import BLANKS, fresh, staged

#: Groups with at least this share of all rows (so at most 1,000 of them) are joined by broadcast.
HEAVY_SHARE = 1_000


def normalised(text):
    """Text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: its digests, `keep_id` (smallest id) and `group_size`."""
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("_salt"))
    salted = rows.groupBy("_salt", "_text").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    whole = salted.groupBy("_text").agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    return whole.select(F.sha2("_text", 256).alias("_digest"), F.xxhash64("_text").alias("_second"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of `docs`: id, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Null texts equal empty ones. Of equal texts the smallest id stays; a null id stays only in a
    group of null ids. Rows that repeat both id and text are one group, of which one row stays.
    Only the id and the text are read, so other columns may have any name. An empty table gives
    no rows.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col), F.sha2(text, 256).alias("_digest"), F.xxhash64(text).alias("_second"))
    groups = staged(winners(docs, id_col, text_col, salts), "winners")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    shared = groups.where("group_size > 1")
    is_heavy = F.col("group_size") * HEAVY_SHARE >= total
    key = ["_digest", "_second"]
    heavy = F.broadcast(shared.where(is_heavy).select(*key, F.col("keep_id").alias("_heavy"), F.col("group_size").alias("_heavy_size")))
    first = rows.join(heavy, key, "left")
    # rows of heavy groups are done; they meet nothing in the next join and need not gather on their key
    spread = F.when(F.col("_heavy_size").isNotNull(), F.concat(F.lit("done"), F.xxhash64(id_col).cast("string"))).otherwise(F.col("_digest"))
    light = shared.where(~is_heavy).select(F.col("_digest").alias("_to"), F.col("_second").alias("_to_second"), "keep_id", "group_size")
    both = first.withColumn("_from", spread).join(light, (F.col("_from") == F.col("_to")) & (F.col("_second") == F.col("_to_second")), "left")
    size = F.coalesce("_heavy_size", "group_size", F.lit(1))
    keep = F.when(F.col("_heavy_size").isNotNull(), F.col("_heavy")).when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col(id_col))
    marked = staged(both.select(id_col, keep.alias("keep_id"), size.cast("long").alias("group_size"), F.col("_digest").alias("text_sha256")), "marked")
    stays = F.col(id_col).eqNullSafe(F.col("keep_id"))
    tied = stays & (F.col("group_size") > 1)
    once = F.row_number().over(Window.partitionBy("text_sha256", id_col).orderBy("group_size")) == 1
    columns = [id_col, "keep_id", "group_size", "kept", "text_sha256"]
    plain = marked.where(~tied).withColumn("kept", stays)
    return plain.select(*columns).unionByName(marked.where(tied).withColumn("kept", once).select(*columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of repeated rows one stays."""
    groups = exact_groups(docs, id_col, text_col, salts).where("kept")
    key, digest = fresh(docs, "_key"), fresh(docs, "_digest")
    name = lambda column: F.coalesce(F.col(column).cast("string"), F.lit(""))
    named = docs.withColumns({digest: F.sha2(normalised(F.col(text_col)), 256), key: name(id_col)})
    kept = groups.select(name(id_col).alias(key), F.col("text_sha256").alias(digest))
    return named.join(kept, [key, digest], "left_semi").dropDuplicates([key, digest]).drop(key, digest)
