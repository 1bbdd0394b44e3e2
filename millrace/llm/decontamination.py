"""Benchmark passages in training documents, found and removed with built-in functions only.

A window is 10 consecutive words of a benchmark item, or the whole of a shorter
one.  Whatever the place of a window of L words in a document, it covers one whole
block of (L + 1) // 2 words when the document is cut into such blocks from its
start.  So the scan looks up only these disjoint blocks in the hash set of the
benchmark's word n-grams, and full windows are verified in the documents that hit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import saved

#: Most benchmark n-grams, and most candidate documents, that are broadcast; more are joined by shuffles.
BROADCAST_GRAMS = 1 << 19
BROADCAST_DOCS = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """The words of a text in lower case (A-Z only), joined by one space."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _GAP, " "))


def _n_words(norm: Column) -> Column:
    return F.when(norm == "", F.lit(0)).otherwise(F.regexp_count(norm, F.lit(" ")) + 1).cast("long")


def _blocks(norm: Column, n: int) -> Column:
    """Disjoint runs of n words from the start on."""
    return F.regexp_extract_all(norm, F.lit(r"(?<![^ ])[^ ]++(?: [^ ]++){%d}" % (n - 1)), F.lit(0))


def _windows(norm: Column, n: int) -> Column:
    """Runs of n words from every word on."""
    return F.regexp_extract_all(norm, F.lit(r"(?<![^ ])(?=([^ ]++(?: [^ ]++){%d}))" % (n - 1)), F.lit(1))


def _placed(norm: Column, n: int) -> Column:
    """Windows with their first word's position."""
    return F.transform(_windows(norm, n), lambda gram, at: F.struct(gram.alias("gram"), at.alias("at"), F.lit(n).alias("n")))


@dataclass
class _Benchmark:
    windows: DataFrame  # gram, item_id: distinct
    grams: DataFrame  # block: distinct
    lengths: list[int]
    small: bool


def _benchmark(items: DataFrame, window: int, item_col: str, text_col: str) -> _Benchmark:
    rows = items.select(F.col(item_col).alias("item_id"), normalised(F.col(text_col)).alias("norm")).withColumn("n", _n_words(F.col("norm"))).filter("n > 0")
    rows = saved(rows.withColumn("n", F.least("n", F.lit(window))))
    lengths = sorted(r.n for r in rows.select("n").distinct().collect())
    none = F.array().cast("array<string>")
    whole, part = none, none
    for n in lengths:
        whole = F.when(F.col("n") == n, _windows(F.col("norm"), n)).otherwise(whole)
        part = F.when(F.col("n") == n, _windows(F.col("norm"), (n + 1) // 2)).otherwise(part)
    windows = rows.select("item_id", F.explode(whole).alias("gram")).distinct()
    grams = rows.select(F.explode(part).alias("block")).distinct()
    return _Benchmark(windows, grams, lengths, bool(lengths) and max(windows.count(), grams.count()) <= BROADCAST_GRAMS)


def _hint(side: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(side) if small else side


def _scanned(rows: DataFrame, mark: _Benchmark) -> DataFrame:
    """doc_id, print, n_words, times (rows alike), candidate: one pass over all texts; a document that holds no gram of the benchmark in its blocks holds no window."""
    cut = rows.select("doc_id", "print", normalised(F.col("text")).alias("norm"))
    sizes = sorted({(n + 1) // 2 for n in mark.lengths})
    blocks = F.concat(*(_blocks(F.col("norm"), b) for b in sizes), F.array(F.lit("")))
    counted = cut.select("doc_id", "print", _n_words(F.col("norm")).alias("n_words"), blocks.alias("blocks"))  # below the explosion, which would count words for every block
    each = counted.select("doc_id", "print", "n_words", F.explode("blocks").alias("block"))
    found = each.join(_hint(mark.grams.withColumn("known", F.lit(True)), mark.small), "block", "left")
    return found.groupBy("doc_id", "print").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("block") == "").alias("times"), F.coalesce(F.max("known"), F.lit(False)).alias("candidate"))


def _candidates(rows: DataFrame, mark: _Benchmark) -> DataFrame:
    """doc_id, print of the documents of which a block is a gram of the benchmark."""
    cut = rows.select("doc_id", "print", normalised(F.col("text")).alias("norm"))
    sizes = sorted({(n + 1) // 2 for n in mark.lengths})
    blocks = F.concat(*(_blocks(F.col("norm"), b) for b in sizes))
    return cut.select("doc_id", "print", F.explode(blocks).alias("block")).join(_hint(mark.grams, mark.small), "block", "left_semi").select("doc_id", "print").distinct()


def _hits(rows: DataFrame, mark: _Benchmark, candidates: DataFrame) -> DataFrame:
    """(doc_id, print, at, n, item_id) for every occurrence of a window in the candidates; rows has doc_id, print and text."""
    candidates = candidates.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"))
    side = _hint(candidates, candidates.count() <= BROADCAST_DOCS)
    own = rows.join(side, rows["doc_id"].eqNullSafe(side["_id"]) & (rows["print"] == side["_print"]), "left_semi").select("doc_id", "print", normalised(F.col("text")).alias("norm"))
    every = F.concat(*(_placed(F.col("norm"), n) for n in mark.lengths))
    placed = own.select("doc_id", "print", F.explode(every).alias("w")).select("doc_id", "print", "w.gram", "w.at", "w.n")
    return placed.join(_hint(mark.windows, mark.small), "gram").select("doc_id", "print", "at", "n", "item_id")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print"))


def hit_spans(docs: DataFrame, items: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, first, last, item_id: the word positions (from 0, last included) of every window found.

    Null and empty texts and items have no words, hence no spans.  Rows that repeat id
    and text give their spans once; a null id is an id like any other.  Texts of any
    length are searched whole; other columns are not read; an empty table, or an empty
    benchmark, gives an empty one.
    """
    mark = _benchmark(items, window, item_col, item_text_col)
    rows = _rows(docs, id_col, text_col)
    if not mark.lengths:
        return rows.select("doc_id", F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(None).cast(items.schema[item_col].dataType).alias("item_id")).filter("false")
    return _hits(rows, mark, saved(_candidates(rows, mark))).select("doc_id", F.col("at").alias("first"), (F.col("at") + F.col("n") - 1).alias("last"), "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, item_ids (sorted strings), contaminated.

    A word inside any occurrence of a window is hit.  A null or empty text has no
    words and no hits, nor has an item without words any windows; an empty
    benchmark leaves every document clean.  A row's result depends on its id and
    text alone, so repeated rows get equal results and null ids are allowed.
    """
    mark = _benchmark(items, window, item_col, item_text_col)
    rows = _rows(docs, id_col, text_col)
    none = F.array().cast("array<string>")
    if not mark.lengths:
        return rows.select("doc_id", _n_words(normalised(F.col("text"))).alias("n_words"), F.lit(0).cast("long").alias("n_hit"), none.alias("item_ids"), F.lit(False).alias("contaminated"))
    base = saved(_scanned(rows, mark))
    hits = saved(_hits(rows, mark, base.filter("candidate")))
    order = Window.partitionBy("doc_id", "print").orderBy("at")
    spans = hits.groupBy("doc_id", "print", "at").agg(F.max("n").alias("n"))
    before = F.coalesce(F.max(F.col("at") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("at") + F.col("n") - F.greatest("at", "before"))
    covered = spans.withColumn("before", before).groupBy("doc_id", "print").agg(F.sum(new).alias("n_hit"))
    named = hits.select("doc_id", "print", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id", "print").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    same = covered["doc_id"].eqNullSafe(named["doc_id"]) & (covered["print"] == named["print"])
    found = covered.join(named, same).select(covered["doc_id"].alias("_id"), covered["print"].alias("_print"), "n_hit", "item_ids")
    out = base.join(found, base["doc_id"].eqNullSafe(found["_id"]) & (base["print"] == found["_print"]), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), (hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns.

    Null and empty texts stay, and with an empty benchmark all documents do.  Rows that
    repeat id and text stay or go together; a null id is an id like any other.  Texts of
    any length are searched whole.  Other columns, whatever their names, are carried
    along; an empty table gives an empty one.
    """
    mark = _benchmark(items, window, item_col, item_text_col)
    if not mark.lengths:
        return docs
    rows = _rows(docs, id_col, text_col)
    bad = saved(_hits(rows, mark, saved(_candidates(rows, mark))).select(F.col("doc_id").alias("_bad_id"), F.col("print").alias("_bad_print")).distinct())
    side = _hint(bad, bad.count() <= BROADCAST_DOCS)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.join(side, docs[id_col].eqNullSafe(side["_bad_id"]) & (F.xxhash64(text) == side["_bad_print"]), "left_anti")
