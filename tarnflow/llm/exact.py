"""Exact deduplication with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stored, text_or_empty


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the white space [\\x20\\x09-\\x0D]; null counts as empty, and empty texts form
    one group. Of equal texts the one with the most code points stays, then the smallest doc_id. Repeated rows (the same
    doc_id and text) count each; all of them carry kept when their doc_id is the one that stays. Other columns are ignored.

    The first aggregation groups by the 128-bit content hash *and* the text, so that the bytes decide: a hash collision
    makes two groups. Copies are counted before the shuffle, so a text that holds a third of all rows sends one row a
    task. The second works on digests. Members find their group by both digests; Spark splits hot ones of that join.
    """
    base = docs.select("doc_id", text_or_empty().alias("t"))
    norm = F.translate("t", SPACES, "")
    keyed = base.select("doc_id", F.char_length("t").alias("n"), norm.alias("norm"))
    counted = keyed.groupBy(F.unhex(F.md5("norm")).alias("h"), "norm", "n").agg(F.count("*").alias("c"), F.min("doc_id").alias("d"))
    groups = stored(
        counted.select("h", F.unhex(F.sha2("norm", 256)).alias("s"), "n", "c", "d")
        .groupBy("h", "s")
        .agg(F.sum("c").alias("group_size"), F.max_by("d", F.struct("n", (-F.col("d")).alias("m"))).alias("keep_id")),
        "groups",
    )
    members = keyed.select("doc_id", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("s"))
    return members.join(groups, ["h", "s"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("s")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns: one of each group of equal texts, also where a row is repeated whole."""
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_keep"]), "left_semi")
    # A doc_id says too little where it is repeated: rows are told apart by their text's digest, and one of each is left.
    sha = F.sha2(F.translate(text_or_empty(), SPACES, ""), 256)
    same = Window.partitionBy("doc_id", "_own").orderBy(F.char_length(text_or_empty()).desc(), "text")
    told = docs.withColumn("_own", sha).withColumn("_turn", F.row_number().over(same)).where("_turn = 1").drop("_turn")
    return told.join(kept.distinct(), told["doc_id"].eqNullSafe(kept["_keep"]) & (told["_own"] == kept["_sha"]), "left_semi").drop("_own")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
