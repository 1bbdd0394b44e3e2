"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import saved

#: Most (length, prefix hash) groups that are broadcast; more of them are joined by a shuffle of narrow rows.
BROADCAST_GROUPS = 1 << 20
#: Characters that the prefix hash covers.
PREFIX = 256


def _length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _head(text: Column) -> Column:
    return F.xxhash64(F.substring(text, 1, PREFIX))


def _surviving(docs: DataFrame) -> DataFrame:
    """(n_bytes, head) of the groups that still have two rows after the first two levels."""
    lengths = docs.groupBy("n_bytes").count().filter("count > 1").select("n_bytes")
    n = lengths.count()
    side = F.broadcast(lengths) if n <= BROADCAST_GROUPS else lengths
    heads = docs.select("n_bytes", "head").join(side, "n_bytes", "left_semi")
    return heads.groupBy("n_bytes", "head").count().filter("count > 1").select("n_bytes", "head")


def exact_duplicates(docs: DataFrame, *, with_digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, and text_sha256 if asked.

    Texts are equal when byte for byte identical; a null text counts as empty.  Of
    equal texts the row with the largest id is kept.  The full hash is computed
    only for rows whose length and prefix hash occur twice (all rows when their
    digest is a result).  Copies meet as partial aggregates, and the join that
    hands each row its group can split a hot group, so no task holds a group.

    Rows that repeat both id and text count in group_size and are flagged alike.
    Null ids lose to any other; where a group has only null ids, all are flagged as kept.
    An empty table gives an empty one.  Other columns are not read.
    """
    flags = _flagged(docs, with_digest, id_col, text_col)
    return flags.select("doc_id", "keep_id", "group_size", "kept", *([F.col("digest").alias("text_sha256")] if with_digest else []))


def _flagged(docs: DataFrame, all_digests: bool, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_bytes, head, digest (null where no other text has its length and head, unless all are asked for), keep_id, group_size, kept."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _length(text).alias("n_bytes"), _head(text).alias("head"))
    heads = saved(_surviving(rows.select("n_bytes", "head")))
    few = heads.count() <= BROADCAST_GROUPS
    digest = F.sha2("text", 256)
    if all_digests:
        hashed = rows.select("doc_id", "n_bytes", "head", digest.alias("digest"))
        survivors = hashed.join(F.broadcast(heads) if few else heads, ["n_bytes", "head"], "left_semi")
    elif few:
        marked = rows.join(F.broadcast(heads.withColumn("again", F.lit(True))), ["n_bytes", "head"], "left")
        hashed = marked.select("doc_id", "n_bytes", "head", F.when(F.col("again"), digest).alias("digest"))
        survivors = hashed.filter(F.col("digest").isNotNull())
    else:
        hashed = rows.select("doc_id", "n_bytes", "head", digest.alias("digest"))
        survivors = hashed.join(heads, ["n_bytes", "head"], "left_semi")
    groups = survivors.groupBy("n_bytes", "digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = saved(groups)  # else the join would keep the aggregate's partitions, and a hot group could not be split
    out = hashed.select("doc_id", "n_bytes", "head", "digest").join(groups, ["n_bytes", "digest"], "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", "n_bytes", "head", "digest", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"))


def without_exact_duplicates(docs: DataFrame, *, broadcast_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, the one with the largest id, with all its columns.

    A null text is an empty one, and null ids lose to any other.  Of rows that repeat
    both id and text (or that all have a null id and equal texts) one stays, any one.
    Only texts whose length and prefix hash occur twice are hashed in full: what is
    dropped is told by id, length, prefix hash and then the digest, broadcast while it
    is little and joined by a shuffle beyond that.  Other columns, whatever their names, are
    carried along.  An empty table gives an empty one.
    """
    copies = _flagged(docs, False, id_col, text_col).filter("group_size > 1").select("doc_id", "n_bytes", "head", "digest", "kept")
    copies = saved(copies.groupBy("doc_id", "n_bytes", "head", "digest", "kept").agg(F.count("*").alias("rows")))
    lost, again = copies.filter(~F.col("kept")), copies.filter(F.col("kept") & (F.col("rows") > 1))
    kept = _matching(docs, lost, "left_anti", broadcast_ids, id_col, text_col)
    if again.isEmpty():
        return kept
    single = _matching(kept, again, "left_anti", broadcast_ids, id_col, text_col)
    several = _matching(kept, again, "left_semi", broadcast_ids, id_col, text_col)
    several = several.withColumn("_named_text", F.coalesce(several[text_col].cast("string"), F.lit("")))
    return single.unionByName(several.dropDuplicates([id_col, "_named_text"]).drop("_named_text"))


def _matching(docs: DataFrame, named: DataFrame, how: str, broadcast_ids: int, id_col: str, text_col: str) -> DataFrame:
    """docs with or without the rows that named tells; a text's digest is computed where id, length and prefix hash agree."""
    side = named.select(*(F.col(k).alias(f"_named_{k}") for k in ("doc_id", "n_bytes", "head", "digest")))
    side = F.broadcast(side) if side.count() <= broadcast_ids else side
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    same = docs[id_col].eqNullSafe(side["_named_doc_id"]) & (_length(text) == side["_named_n_bytes"]) & (_head(text) == side["_named_head"])
    return docs.join(side, same & F.startswith(F.sha2(text, 256), side["_named_digest"]), how)
