"""First-fit-decreasing packing of documents into sequences of one length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import default_path, word_bpe
from millrace.llm.textcore import buffer_of, slices, tidied, tidied_group

Piece = tuple[int, int, int]


class Tournament:
    """Free space of up to n bins; finds the first bin with enough of it in log2(n) steps."""

    def __init__(self, n: int, capacity: int) -> None:
        self.size = 1 << max(0, n - 1).bit_length()
        self.most = [capacity] * (2 * self.size)

    def take(self, need: int) -> int:
        """The first bin with need free, which is then taken from it."""
        most, i = self.most, 1
        while i < self.size:
            i *= 2
            if most[i] < need:
                i += 1
        leaf = i - self.size
        most[i] -= need
        while i > 1:
            i //= 2
            most[i] = max(most[2 * i], most[2 * i + 1])
        return leaf


def pack(lengths: list[int], capacity: int) -> list[list[Piece]]:
    """Sequences of (document, start, length) that hold every token of documents of these lengths once.

    Full stretches of capacity tokens are sequences of their own.  What is left of
    each document goes by first-fit decreasing into bins.  The emptiest bins are
    then cut up to fill the gaps of the fullest ones, and the one bin that stays
    partly filled is cut into powers of two, so nothing needs padding.
    """
    full = [[(d, k, capacity)] for d, n in enumerate(lengths) for k in range(0, n - n % capacity, capacity)]
    rest = sorted(((n % capacity, d) for d, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    tree, bins = Tournament(len(rest), capacity), {}
    for n, d in rest:
        bins.setdefault(tree.take(n), []).append((d, lengths[d] - n, n))
    open_bins = sorted(((sum(p[2] for p in b), k, b) for k, b in bins.items()), key=lambda x: (-x[0], x[1]))
    held = [[used, b] for used, _, b in open_bins]
    i, j = 0, len(held) - 1
    while i < j:
        if held[i][0] == capacity:
            i += 1
            continue
        d, start, n = held[j][1].pop()
        take = min(n, capacity - held[i][0])
        if n > take:
            held[j][1].append((d, start, n - take))
        held[i][1].append((d, start + n - take, take))
        held[i][0] += take
        held[j][0] -= take
        if not held[j][0]:
            j -= 1
    out = full + [b for used, b in held[: j + 1] if used == capacity]
    if held and held[j][0] < capacity:
        out += _powers_of_two(held[j][1], held[j][0])
    return out


def _powers_of_two(pieces: list[Piece], total: int) -> list[list[Piece]]:
    out, queue = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        own, need = [], 1 << bit
        while need:
            d, start, n = queue.pop()
            take = min(n, need)
            own.append((d, start, take))
            if n > take:
                queue.append((d, start + take, n - take))
            need -= take
        out.append(own)
    return out


def packed(docs: DataFrame, *, length: int = 2048, end_id: int = 1, group_docs: int = 1024, group_bytes: int = 16 << 20, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most length tokens.

    Documents are dealt at random (by a hash of the row and of the partition that it
    is read in, so that repeated rows spread too) into groups of about group_docs, or
    of about group_bytes of text where documents are long; each group is packed for
    itself, so no state is shared and a hot source or language spreads over all groups.
    One shuffle moves the token ids.

    Rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A
    null text is empty and still has its end id, hence one piece.  Repeated rows and
    rows with a null id are documents of their own.  Of equally long rests the lesser
    place in the group goes first.  Other columns are not read.  An empty table gives no rows.
    """
    path = tokenizer or default_path()
    key = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-n // group_docs), -(-(size or 0) // group_bytes))
    encoded = T.StructType([T.StructField("pack_group", T.LongType()), T.StructField("doc_id", key), T.StructField("ids", T.BinaryType())])
    schema = T.StructType([T.StructField("doc_id", key), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        kind = np.dtype("<u2") if bpe.library.get_vocab_size() < 1 << 16 else np.dtype("<u4")
        for batch in batches:
            data, offsets = buffer_of(batch.column(2))
            for a, b in slices(offsets):
                ids, at = bpe.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids, tail = ids.astype(kind), np.array([end_id], dtype=kind).tobytes()
                raw = [ids[x:y].tobytes() + tail for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(raw, pa.binary())], names=encoded.names)

    def pack_group(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending")]))
        kind = np.dtype("<u2") if word_bpe(path).library.get_vocab_size() < 1 << 16 else np.dtype("<u4")
        group = table.column("pack_group")[0].as_py()
        ids = [np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column("ids")]
        rows = [(d, s, n, k, at) for k, own in enumerate(pack([len(x) for x in ids], length)) for (d, s, n), at in zip(own, np.cumsum([0, *(p[2] for p in own)]).tolist(), strict=False)]
        d, s, n, k, at = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        crc = np.array([zlib.crc32(ids[i][a : a + m].astype("<u4").tobytes()) for i, a, m in zip(d, s, n, strict=True)], dtype=np.int64)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        columns = [table.column("doc_id").combine_chunks().take(pa.array(d)), *(pa.array(x) for x in (s, n, crc, sizes[d], k + (group << 32), at))]
        return pa.Table.from_arrays(columns, names=schema.names)

    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(groups)).alias("pack_group"), "doc_id", "text")
    return dealt.mapInArrow(tidied(encode), encoded).groupBy("pack_group").applyInArrow(tidied_group(pack_group), schema)
