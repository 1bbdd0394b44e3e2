"""Token counts of whole texts without merging what is known to be one token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import WordBpe, default_path, word_bpe
from millrace.llm.textcore import buffer_of, tidied


def token_counts(docs: DataFrame, *, tokenizer: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens, n_shortcut, over_limit.

    Which vocabulary strings encode alone as one token is proven offline, once on the
    driver with the library itself; their hashes (8 bytes for each string of the
    vocabulary, whatever the input) go to the workers.  Pre-tokens equal to one of them count
    as one; only the rest is merged, each distinct pre-token once (n_shortcut is
    how many took the short way).  No row moves: the operator is one pass.

    A null or empty text has 0 bytes and 0 tokens.  Rows are counted each for
    itself, so repeated rows and null ids stay as they are.  An empty table gives
    an empty one; other columns are not read.
    """
    path = tokenizer or default_path()
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "n_shortcut"))])

    whole = docs.sparkSession.sparkContext.broadcast(WordBpe(path).whole_tokens())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            tokens, short = bpe.counts(data, offsets, whole.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(short)], names=schema.names)

    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(count), schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
