"""Token ids of a corpus in shard files in ascending id order, and their reader."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import default_path, word_bpe
from millrace.llm.elias_fano import Shard, pack_shard
from millrace.llm.shared import partitions_for, shared_dir
from millrace.llm.textcore import buffer_of, slices

_MANIFEST = "partition int, part int, path string, n_docs long, n_tokens long"


def _files(uri: str):
    """The file system of a URI that every executor reaches, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, body: bytes) -> None:
    system, path = _files(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(body)


def write_tokens(docs: DataFrame, folder: str, *, end_id: int = 2, tokenizer: str | None = None, shard_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, str, int, int]]:
    """Encode all documents into shard files under folder; returns their manifest in order.

    Rows are dealt out by ranges of the id and sorted within each, so the files in
    (partition, part) order hold the corpus in ascending id order.  A null text is
    empty and holds end_id alone; null ids come first; repeated rows each appear.
    The manifest has one row for each file of up to shard_tokens ids: partition,
    part, path, documents, ids.  Ids must be integers.  A text of any length lies in
    one file.  An empty table writes no file and has an empty manifest; other columns are not read.
    """
    path = tokenizer or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        k, attempt = task.partitionId(), task.taskAttemptId()
        bpe, part, held = word_bpe(path), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal part, held
            known = np.concatenate([x[0] for x in held])
            n_null = sum(x[1] for x in held)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([x[2] for x in held]))])
            ids = np.concatenate([x[3] for x in held])
            # Each attempt writes names of its own, and the manifest lists those of the one that counts: a lost or doubled attempt leaves whole files alone.
            name = f"{folder}/tokens-{k:06d}-{part:05d}-{attempt}.mrt"
            _put(name, pack_shard(known, n_null, bounds, ids))
            row = pa.RecordBatch.from_pydict({"partition": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "path": [name], "n_docs": [len(bounds) - 1], "n_tokens": [len(ids)]})
            part, held = part + 1, []
            return row

        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for a, b in slices(offsets):
                ids, at = bpe.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(at) + 1
                out = np.full(len(ids) + b - a, end_id, dtype=np.uint32)
                ends = np.cumsum(n) - 1
                inside = np.ones(len(out), dtype=bool)
                inside[ends] = False
                out[inside] = ids
                key = batch.column(0).slice(a, b - a)
                held.append((key.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), key.null_count, n, out.astype(np.uint16) if not len(out) or out.max() < 1 << 16 else out))
                if sum(len(x[3]) for x in held) >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions_for(rows, 32 << 20), "doc_id").sortWithinPartitions("doc_id")
    return sorted((r.partition, r.part, r.path, r.n_docs, r.n_tokens) for r in ordered.mapInArrow(write, _MANIFEST).collect())


def read_tokens(spark: SparkSession, manifest: list[tuple[int, int, str, int, int]], *, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32, and ids (binary, unsigned 32-bit little-endian) if asked.

    start counts the ids of all documents before it; it is the running sum of the
    manifest plus the document's own boundary.  Null and repeated ids come as they were
    written; an empty manifest gives an empty table.
    """
    starts, total = [], 0
    for i, (_, _, path, _, n) in enumerate(manifest):
        starts.append((i, path, total))
        total += n
    fields = [("doc_id", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField(c, t) for c, t in (*fields, *([("ids", T.BinaryType())] if with_ids else []))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                system, name = _files(path)
                with system.open_input_file(name) as f:
                    shard = Shard(f.read())
                for a in range(0, shard.n_docs, 4096):
                    b = min(shard.n_docs, a + 4096)
                    at = shard.bounds.values(a, b + 1)
                    nulls = max(0, min(b, shard.n_null) - a)
                    known = shard.known.values(max(0, a - shard.n_null), max(0, b - shard.n_null)) + shard.base
                    raw = [shard.ids[x:y].astype("<u4").tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                    columns = [pa.array([None] * nulls + known.tolist(), pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array(raw, pa.binary())] if with_ids else [])], names=schema.names)

    files = spark.createDataFrame(starts, "n int, path string, base long")
    return files.repartitionByRange(max(1, len(starts)), "n").mapInArrow(read, schema) if starts else spark.createDataFrame([], schema)


def token_files(docs: DataFrame, *, folder: str | None = None, **options) -> DataFrame:
    """write_tokens() into folder (a new one in the cluster's shared folder by default), then read_tokens()."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, folder or shared_dir(spark), **options))
