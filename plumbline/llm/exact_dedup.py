"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, materialise, text_or_empty

_SHIFT = 2**65  # more than any id makes
_TOP = 2**63


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """Length and id as one decimal, whose maximum is the longest text and then the smallest id; a null id is last.

    A decimal fits Spark's mutable aggregation buffers, so that the group-by stays a hash aggregate.
    """
    low = F.coalesce(F.lit(Decimal(_TOP)) - doc_id.cast("decimal(20,0)"), F.lit(Decimal(0)))
    return (n_chars.cast("decimal(18,0)") * F.lit(Decimal(_SHIFT)) + low).cast("decimal(38,0)")


def _unrank(rank: Column) -> tuple[Column, Column]:
    low = (rank % F.lit(Decimal(_SHIFT))).cast("decimal(20,0)")
    n_chars = ((rank - low) / F.lit(Decimal(_SHIFT))).cast("bigint")
    return n_chars, F.when(low > 0, (F.lit(Decimal(_TOP)) - low).cast("bigint"))


def default_digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest=default_digest) -> DataFrame:
    """One row per row of docs: the id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical without ASCII white space; null is the empty text. Of equal
    texts the row with the most code points in its own text stays, then that with the smallest id (a null
    id last). Rows that repeat the winner in id and length are interchangeable: one of them is kept.

    Three stages combine the groups, and each compares whole contents, not digests alone:
    each task deduplicates its own rows (partial aggregation by digest, salt and content, where the salt
    is the task's number), salted groups are merged, then the winners of the salts. A group that holds a
    third of all rows reaches a merging task with one row per task at most. Rows then find their group by
    digest and a second fingerprint, in a join whose large partitions Spark splits; should two contents
    share both, the rows are matched by content. Which of a group's best rows stays is a minimum over row
    numbers, which is combined in each task before it is shuffled. So nothing gathers a group's rows.
    Extra columns are ignored; an empty table gives an empty result.
    """
    content = F.translate(text_or_empty(F.col(text_col)), SPACES, "")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.length(text_or_empty(F.col(text_col))).cast("bigint").alias("_chars"),
        content.alias("_content"),
    ).withColumn("_digest", digest(F.col("_content")))
    local = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("_digest", "_salt", "_content").agg(
        F.count(F.lit(1)).alias("_n"), F.max(_rank(F.col("_chars"), F.col("doc_id"))).alias("_rank")
    )
    merged = salted.groupBy("_digest", "_content").agg(F.sum("_n").alias("_n"), F.max("_rank").alias("_rank"))
    finger, length = F.xxhash64("_content"), F.length("_content")
    number = F.monotonically_increasing_id()
    groups = materialise(merged.select("_digest", finger.alias("_finger"), length.alias("_length"), "_n", "_rank", number.alias("_group")), "copies")
    rows = rows.withColumn("_finger", finger).withColumn("_length", length)
    keys = ["_digest", "_finger", "_length"]
    if groups.groupBy(*keys).count().filter("count > 1").limit(1).count():
        keys, groups = ["_digest", "_content"], materialise(merged.withColumn("_group", number), "copies")
    found = rows.select("doc_id", "_chars", *keys).join(groups.select(*keys, "_n", "_rank", "_group"), keys)
    keep_chars, keep_id = _unrank(F.col("_rank"))
    found = found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.col("_n").cast("bigint").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & (F.col("_chars") == keep_chars)).alias("_best"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
        "_group",
    )
    found = materialise(found.withColumn("_row", number), "copy-rows")
    stays = found.filter("_best").groupBy("_group").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("_stays"))
    found = found.join(stays, "_row", "left")
    return found.select("doc_id", "keep_id", "group_size", F.coalesce("_stays", F.lit(False)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that copy_groups keeps, with all their columns.

    A kept row is found by its id and content; rows that repeat it in both, and differ only in white
    space or other columns, are reduced to one by a window over those few rows.
    """
    kept = copy_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"))
    rows = docs.withColumn("_sha", default_digest(F.translate(text_or_empty(F.col(text_col)), SPACES, "")))
    rows = rows.withColumn("_key", F.col(id_col).cast("bigint"))
    on = rows["_key"].eqNullSafe(kept["_id"]) & (rows["_sha"] == kept["_sha"])
    once = rows.join(kept, on, "left_semi")
    longest = Window.partitionBy("_key", "_sha").orderBy(F.desc(F.length(text_or_empty(F.col(text_col)))))
    return once.withColumn("_nth", F.row_number().over(longest)).filter("_nth = 1").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import table

    return copy_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents
), w AS (
  SELECT doc_id, sha256(c) AS text_sha256, row_number() OVER p AS k, first_value(doc_id) OVER p AS keep_id, count(*) OVER (PARTITION BY c) AS group_size
  FROM n WINDOW p AS (PARTITION BY c ORDER BY length(t) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM w
"""
