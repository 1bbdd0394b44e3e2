"""Arrays packed into a few shuffled rows: slices of texts send to parts of the hash space, and parts answer slices.

A slice is a run of a task's rows.  Its name holds its content, so when a task is run
again on rows in another order it makes other slices, which the receiver notices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textcore import mix

#: Bytes of text for each part of the hash space, of which one task holds the hashes.
PART_BYTES = 6 << 20
CHANGED = "rows came in another order when a task was run again; write the input out first"


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts_for(rows: DataFrame) -> int:
    """Parts of the hash space for the texts of rows."""
    return -(-text_bytes(rows) // PART_BYTES) or 1


def part_edges(parts: int, bits: int = 64) -> np.ndarray:
    """The least hash of each part but the first."""
    return np.array([-(-(k << bits) // parts) for k in range(1, parts)], dtype=np.uint64)


def slice_name(task: int, seq: int, ids: np.ndarray, prints: np.ndarray) -> int:
    """A name for the seq-th slice of a task, of rows with these ids and text hashes."""
    place = np.arange(len(ids), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    content = mix(prints + mix(ids.view(np.uint64) + np.uint64(1)) * place).sum()
    return int((mix(np.array([content ^ np.uint64((task << 32) + seq)])) >> np.uint64(1))[0])


def packed(*columns: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed: the high bytes of small or even numbers cost little."""
    import zstandard

    head = np.array([len(columns), *(x for c in columns for x in (c.itemsize, len(c)))], dtype="<i8").tobytes()
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *planes]))


def unpacked(raw: pa.Buffer, kinds: str) -> list[np.ndarray]:
    """The arrays of packed(), of these dtype codes."""
    import zstandard

    body = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
    sizes = body[8 : 8 + 16 * len(kinds)].view("<i8").reshape(-1, 2)
    at, out = 8 + 16 * len(kinds), []
    for kind, (item, n) in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.ascontiguousarray(body[at : at + item * n].reshape(item, n).T).reshape(-1).view(kind))
        at += item * n
    return out


def steps_of(x: np.ndarray) -> np.ndarray:
    """Differences of ascending hashes; np.cumsum() undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))
