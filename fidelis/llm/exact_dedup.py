"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

Normalised texts are cut where their content says so (a lazy regular expression with a
least and a greatest length), so equal texts are cut alike wherever they lie. Chunks are
deduplicated across the corpus and get identifiers: the 64-bit hash of the chunk, which is
verified by counting the different chunk contents behind each hash; contents that share a
hash get an ordinal besides. A document is then the ordered list of its identifiers (its
recipe), and grouping compares these short lists; texts themselves move once, as distinct
chunks, to verify the identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fidelis.llm.common import SPACE_CLASS, with_groups

#: A chunk ends after MIN_CHUNK characters at the next pair of boundary characters, or
#: after MAX_CHUNK. The class takes about a fifth of letters, in any script.
MIN_CHUNK, MAX_CHUNK = 512, 4096
_BOUNDARY = "[aeh.0-9\\u0430\\u0435\\u0627\\u0644\\u7684\\u306e][nrst,\\u043d\\u0442\\u0646\\u4e00\\u3002]"
_CHUNK = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:(?<={_BOUNDARY})|\\z)|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    """Text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", "")


def chunks(norm: Column) -> Column:
    """The content-defined chunks of a normalised text, in order; none if it is empty."""
    return F.regexp_extract_all(norm, F.lit(_CHUNK), F.lit(0))


def chunk_hash(content: Column) -> Column:
    return F.xxhash64(content)


def _collisions(parts: DataFrame) -> DataFrame:
    """(hash, content, ordinal) of chunk contents that share a hash with another content."""
    distinct = parts.select(F.explode("_chunks").alias("_content")).distinct().select(
        chunk_hash(F.col("_content")).alias("_hash"), "_content"
    )
    shared = distinct.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash")
    return distinct.join(shared, "_hash").select(
        "_hash", "_content", F.row_number().over(Window.partitionBy("_hash").orderBy("_content")).alias("_ordinal")
    )


def _key(doc_id: Column) -> Column:
    """doc_id without nulls, for joins and windows that share one partitioning."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, _len, text_sha256, _recipe) of each row; recipes are equal iff normalised texts are.

    Verifying the identifiers is a job of its own: it finds the hashes that stand for more
    than one chunk content. Where there are none, as is usual, a hash is the identifier;
    else the rows that hold such chunks get the contents' ordinals joined in.
    """
    parts = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.length(F.coalesce("text", F.lit(""))).alias("_len"),
        normalised(F.col("text")).alias("_norm"),
    ).select(
        "doc_id",
        "_len",
        F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
        chunks(F.col("_norm")).alias("_chunks"),
    )
    hashes = F.transform("_chunks", lambda c: chunk_hash(c))
    shared = _collisions(parts)
    if shared.isEmpty():
        return parts.select("doc_id", "_len", "text_sha256", hashes.alias("_recipe"))
    touched = (
        parts.select(_key(F.col("doc_id")).alias("_k"), "text_sha256", F.posexplode("_chunks").alias("_pos", "_content"))
        .withColumn("_hash", chunk_hash(F.col("_content")))
        .join(shared, ["_hash", "_content"])
        .groupBy("_k", "text_sha256")
        .agg(F.map_from_entries(F.collect_set(F.struct("_pos", "_ordinal"))).alias("_ordinals"))
    )
    return (
        parts.select("doc_id", _key(F.col("doc_id")).alias("_k"), "_len", "text_sha256", hashes.alias("_hashes"))
        .join(touched, ["_k", "text_sha256"], "left")
        .select(
            "doc_id",
            "_len",
            "text_sha256",
            # hash, ordinal, hash, ordinal, ... : two documents agree in all or differ
            F.flatten(
                F.transform(
                    "_hashes", lambda h, i: F.array(h, F.coalesce(F.col("_ordinals")[i], F.lit(0)).cast("long"))
                )
            ).alias("_recipe"),
        )
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; null counts as
    empty, and empty texts form one group. Of a group the row with the most code points
    stays, then the one with the smallest doc_id (a null doc_id comes last). A row that
    repeats another with doc_id and all is a copy as well: one of them is kept. An empty
    table gives no rows. Columns beside doc_id and text are ignored.

    Rows alike in doc_id, length and text are first counted, as one row stands for them;
    groups of any size are then split by a salt from doc_id, summed up salt by salt and
    over the salts, and the result goes back to the rows by (recipe, salt).
    """
    order = F.struct(-F.col("_len"), F.col("doc_id").isNull(), F.col("doc_id"))
    alike = recipes(docs).groupBy("doc_id", "_len", "text_sha256", "_recipe").agg(F.count("*").alias("_c"))
    rows = with_groups(
        alike,
        ["_recipe"],
        F.col("doc_id"),
        [F.min(order).alias("_best"), F.sum("_c").alias("_n")],
        [F.min("_best").alias("_best"), F.sum("_n").alias("group_size")],
    )
    return rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))).alias("_i")).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("_i") == 1) & (order == F.col("_best"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that exact_groups keeps, with all their columns.

    Decisions are joined by doc_id; the rows of one doc_id that have several texts are told
    apart by text_sha256; of rows that share both, the longest stays, of these the one of
    smallest text, and of rows repeated whole any one.
    """
    kept = exact_groups(docs).filter("kept").select(_key(F.col("doc_id")).alias("_k"), F.col("text_sha256").alias("_s"))
    rows = docs.select(
        F.struct("*").alias("_row"),
        _key(F.col("doc_id")).alias("_k"),
        F.length(F.coalesce("text", F.lit(""))).alias("_len"),
        F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("_s"),
    )
    # within a kept (doc_id, text) only a repeated doc_id has more than one row
    first = F.row_number().over(Window.partitionBy("_k", "_s").orderBy(F.desc("_len"), F.col("_row.text"))) == 1
    return rows.join(kept, ["_k", "_s"], "left_semi").withColumn("_first", first).filter("_first").select("_row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept,
  sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id)
"""
