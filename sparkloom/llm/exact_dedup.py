"""Exact dedup with a heavy-hitter split, in DataFrame functions alone.

1. Digests (SHA-256 of the whole text, and a 64-bit hash for counting) are computed once and written to the checkpoint
   folder: 40 bytes a row, so the text is read once.
2. A Misra-Gries style frequent-items sketch over the 64-bit hashes names up to ``top_k`` candidates. Its size is fixed
   by ``tracked``, whatever the input.
3. Candidates are counted exactly (map-side partial sums); those with at least ``heavy_min`` rows are the winners, at
   most ``top_k`` of them. They are broadcast, and their rows get their group's result on the map side, unshuffled.
4. All other rows are shuffled by digest. The sketch finds every hash with more than N / tracked rows or so; a group that
   it misses is small against N and only travels the ordinary way: the split decides the cost, never the result.

Defined results: null text counts as empty; of equal texts the largest id stays; a null id is smaller than any other;
of repeated rows with the same id and text one stays. An empty table gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Most winners that are broadcast, counters of the sketch, and rows that make a digest heavy.
TOP_K, TRACKED, HEAVY_MIN = 256, 2048, 128


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("h"))


def winners(rows: DataFrame, top_k: int = TOP_K, tracked: int = TRACKED, heavy_min: int = HEAVY_MIN) -> DataFrame:
    """The verified heavy digests: (digest, keep_id, group_size), at most top_k rows."""
    found = rows.agg(F.expr(f"approx_top_k(h, {int(top_k)}, {int(tracked)})").alias("top")).select(F.explode("top").alias("x")).select(F.col("x.item").alias("h")).where("h is not null")
    exact = rows.join(F.broadcast(found), "h", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return exact.where(F.col("group_size") >= heavy_min).orderBy(F.desc("group_size"), "digest").limit(top_k)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top_k: int = TOP_K, tracked: int = TRACKED, heavy_min: int = HEAVY_MIN) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = checkpointed(digests(docs, id_col, text_col))
    heavy = checkpointed(winners(rows, top_k, tracked, heavy_min))
    dealt = rows.join(F.broadcast(heavy), "digest", "left")
    first = F.row_number().over(Window.partitionBy("digest").orderBy(F.desc_nulls_last("doc_id")))
    group = Window.partitionBy("digest")
    light = dealt.where("group_size is null").select(
        "doc_id", F.max("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"), (first == 1).alias("kept"), "digest"
    )
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    heavy_rows = dealt.where("group_size is not null")
    dropped = heavy_rows.where(~stays).select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "digest")
    # Only rows that carry the id that stays: one for each winner, or more where a row is repeated.
    chosen = heavy_rows.where(stays).select("doc_id", "keep_id", "group_size", (first == 1).alias("kept"), "digest")
    out = light.unionByName(dropped).unionByName(chosen)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns."""
    found = checkpointed(exact_dedup(docs, id_col, text_col, **options))
    again = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), F.sum(F.col("kept").cast("int")).alias("stay")).where("times > 1")
    kept = found.where("kept").join(again, found["doc_id"].eqNullSafe(again["doc_id"]), "left_anti").select(F.col("doc_id").alias("__kept_id"))
    whole = docs.join(kept, docs[id_col].eqNullSafe(kept["__kept_id"]), "left_semi")
    # Ids that occur more than once are told apart by their text; only their rows are shuffled by it.
    several = again.where("stay > 0").select(F.col("doc_id").alias("__kept_id"))
    repeated = docs.join(several, docs[id_col].eqNullSafe(several["__kept_id"]), "left_semi").withColumn("__text_digest", F.lower(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)))
    stay = found.where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_digest"))
    repeated = repeated.join(stay, repeated[id_col].eqNullSafe(stay["__kept_id"]) & (F.col("__text_digest") == F.col("__kept_digest")), "left_semi").dropDuplicates([id_col, "__text_digest"])
    return whole.unionByName(repeated.drop("__text_digest"))


ORACLE = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""
