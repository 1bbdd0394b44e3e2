"""Passages that repeat across documents, found by level-wise doubling, and their removal.

The first level asks which windows of a few words occur in two documents.  The next
length is at most twice the one before, and at the end `width`: of its windows only
those whose first and last stretch of the length before repeat are candidates, and
only candidates go on, until no length or no candidate is left.  At the last length a
window repeats when it also starts in a document with a smaller id.

Texts are written once, in slices of a few MB.  A level sends each slice's distinct
hashes to the parts of the hash space, in packed rows, and a part answers with one
bit a hash.  A hash costs a slice one entry however often it holds it, so no hash is
hot.  What a slice knows between levels is one bit a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.packed import PART_BYTES, packed, part_edges, steps_of, unpacked
from millrace.llm.shared import saved
from millrace.llm.textcore import Words, buffer_of, slices, tidied, tidied_group, window_hashes, words

#: The longest windows of the first level, in words.
FIRST = 8
#: Bits of a hash beyond those that number the corpus's words: where only candidates are asked for, one in 2^SPARE more passes by chance.
SPARE = 10

_TEXT, _STATE = -1, -2
_SLICE = "slice long, part int, body binary, text binary, n_bytes long"
_ROWS = "slice long, part int, body binary"
_KEPT = "doc_id long, text string, n_words long, n_removed long, removed array<struct<first:int,last:int>>"


def lengths_up_to(width: int) -> list[int]:
    """The levels' lengths: halves of width, rounded up, down to FIRST at most, the shortest first."""
    out = [width]
    while out[0] > FIRST:
        out.insert(0, -(-out[0] // 2))
    return out


def _sliced(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, text) in slices: packed ids, which of them are null, text sizes, and the compressed bytes of all texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for a, b in slices(offsets):
                ids = batch.column(0).slice(a, b - a)
                known = np.asarray(ids.is_valid()).astype(np.uint8)
                body = packed(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known, np.diff(offsets[a : b + 1]))
                text = zstandard.ZstdCompressor(level=3).compress(data[offsets[a] : offsets[b]].tobytes())
                columns = [pa.array([name], pa.int64()), pa.array([_TEXT], pa.int32()), pa.array([body], pa.binary()), pa.array([text], pa.binary()), pa.array([int(offsets[b] - offsets[a])], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "part", "body", "text", "n_bytes"])
                name += 1

    return saved(rows.mapInArrow(tidied(cut), _SLICE))


@dataclass
class _Slice:
    ids: np.ndarray
    known: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    words: Words

    @classmethod
    def read(cls, body: pa.Buffer, text: pa.Buffer) -> _Slice:
        import zstandard

        ids, known, sizes = unpacked(body, "qBq")
        data = np.frombuffer(zstandard.decompress(text), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return cls(ids, known.astype(bool), data, offsets, words(data, offsets, lower=False))

    def candidates(self, length: int, before: int, repeats: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(word position, document) of the windows of this length that may repeat; repeats: where windows of length before do."""
        bounds = self.words.bounds
        n = np.diff(bounds)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(doc))
        may = self.known[doc] & (n[doc] >= width) & (at + length <= bounds[1:][doc])
        if repeats is not None:
            step = min(length - before, len(may))
            may &= repeats & np.concatenate([repeats[step:], np.zeros(step, dtype=bool)])
        at = np.flatnonzero(may)
        return at, doc[at]


@dataclass
class _Asked:
    """Windows of one length in one slice: their hashes in order, which windows have which, and the least id that holds each."""

    at: np.ndarray  # of each window, in the order of hashes
    doc: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, own: _Slice, at: np.ndarray, doc: np.ndarray, length: int, bits: int) -> _Asked:
        h = window_hashes(own.words.hashes, length)[at] >> np.uint64(64 - bits)
        order = np.argsort(h, kind="stable")
        h, at, doc = h[order], at[order], doc[order]
        if not len(h):
            return cls(at, doc, at, h, at, at)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        ids = own.ids[doc]
        return cls(at, doc, first, h[first], np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first))

    def each(self, of_hash: np.ndarray) -> np.ndarray:
        """What is known of a hash, for every window."""
        return np.repeat(of_hash, np.diff(np.append(self.first, len(self.at))))

    def rows(self, parts: int, bits: int, last: bool) -> tuple[list[int], list[bytes]]:
        """Parts, and what they are asked."""
        cut = np.concatenate([[0], np.searchsorted(self.hashes, part_edges(parts, bits)), [len(self.hashes)]])
        used = np.flatnonzero(np.diff(cut))
        own = self.least if last else (self.least < self.most).astype(np.uint8)
        return used.tolist(), [packed(steps_of(self.hashes[a:b]), own[a:b]) for a, b in zip(cut[used], cut[used + 1], strict=True)]


def _answer(last: bool, table: pa.Table) -> pa.Table:
    """For each slice that asked, a bit a hash: whether another document holds it, or at the last length one with a smaller id."""
    found = [unpacked(x.as_buffer(), "Qq" if last else "QB") for x in table.column("body")]
    at = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])])
    h, own = np.concatenate([np.cumsum(x[0]) for x in found]), np.concatenate([x[1] for x in found])
    del found
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    del ordered
    times = np.diff(np.append(first, len(h)))
    bit = np.empty(len(h), dtype=bool)
    if last:
        bit[order] = np.repeat(np.minimum.reduceat(own[order], first), times) < own[order]
    else:
        bit[order] = np.repeat((times > 1) | (np.maximum.reduceat(own[order], first) > 0), times)
    bodies = [np.packbits(bit[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    sizes = np.diff(at).astype("<u4")
    return pa.table([table.column("slice"), table.column("part"), pa.array([n.tobytes() + x for n, x in zip(sizes, bodies, strict=True)], pa.binary())], names=["slice", "part", "body"])


def _opened(table: pa.Table, level: int, lengths: list[int], bits: list[int]) -> tuple[int, _Slice, _Asked, np.ndarray]:
    """(name, slice, its windows of this level, the answer to each of their hashes)."""
    part = table.column("part").to_numpy()
    rows = {p: i for i, p in enumerate(part.tolist())}
    own = _Slice.read(table.column("body")[rows[_TEXT]].as_buffer(), table.column("text")[rows[_TEXT]].as_buffer())
    repeats = None
    if _STATE in rows:
        repeats = np.unpackbits(np.frombuffer(table.column("body")[rows[_STATE]].as_buffer(), dtype=np.uint8), count=len(own.words.hashes)).astype(bool)
    before = lengths[level - 1] if level else 0
    asked = _Asked.of(own, *own.candidates(lengths[level], before, repeats, lengths[-1]), lengths[level], bits[level])
    bits_of = [np.empty(0, dtype=bool)]
    for p in sorted(p for p in rows if p >= 0):
        raw = table.column("body")[rows[p]].as_buffer()
        n = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
        bits_of.append(np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=4), count=n).astype(bool))
    return table.column("slice")[0].as_py(), own, asked, np.concatenate(bits_of)


def _kept(own: _Slice, asked: _Asked, smaller: np.ndarray, width: int) -> pa.Table:
    """_KEPT rows of a slice: a window goes where another slice, or the slice itself, holds it under a smaller id."""
    gone = asked.each(smaller) | (asked.each(asked.least) < own.ids[asked.doc]) if len(asked.at) else np.empty(0, dtype=bool)
    edge = np.zeros(len(own.words.hashes) + 1, dtype=np.int64)
    np.add.at(edge, asked.at[gone], 1)
    np.add.at(edge, asked.at[gone] + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    bounds = own.words.bounds
    turn = np.zeros(len(covered) + 1, dtype=bool)
    turn[bounds] = True
    new = covered & (turn[:-1] | ~np.concatenate([[False], covered[:-1]]))
    end = covered & (turn[1:] | ~np.concatenate([covered[1:], [False]]))
    starts, ends = np.flatnonzero(new), np.flatnonzero(end)
    run_doc = np.searchsorted(bounds, starts, side="right") - 1
    sums = np.concatenate([[0], np.cumsum(covered)])
    n_words, n_removed = np.diff(bounds), np.diff(sums[bounds])
    texts = []
    for d in range(len(n_words)):
        found = own.data[own.offsets[d] : own.offsets[d + 1]].tobytes().split()
        if n_removed[d]:
            found = [found[i] for i in np.flatnonzero(~covered[bounds[d] : bounds[d + 1]])]
        texts.append(b" ".join(found))
    runs = pa.StructArray.from_arrays([pa.array((x - bounds[run_doc]).astype(np.int32)) for x in (starts, ends)], names=["first", "last"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(run_doc, np.arange(len(n_words) + 1)).astype(np.int32)), runs)
    columns = [pa.array(own.ids, mask=~own.known), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words.astype(np.int64)), pa.array(n_removed.astype(np.int64)), lists]
    return pa.table(columns, names=["doc_id", "text", "n_words", "n_removed", "removed"])


def without_repeats(docs: DataFrame, *, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text (the kept words, one space between), n_words, n_removed, removed (runs of word positions).

    A word goes when a window of width words covers it that also starts in a
    document with a smaller id, judged on the input.  Words are runs of bytes that
    are not white space.  A null or empty text has no words; a document of fewer
    than width words loses none.  Of equal documents only the one with the
    smallest id keeps its text.  Rows with a null id neither lose words nor make
    others lose them; rows with one id are one document, so repeated rows keep or
    lose the same words.  Other columns are not read.  An empty table gives an empty
    one.  Windows are told apart by 64-bit hashes.  Ids must be integers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cut = _sliced(rows)
    size = cut.agg(F.sum("n_bytes")).first()[0] or 0
    parts, lengths = -(-size // PART_BYTES) or 1, lengths_up_to(width)
    bits = [min(64, size.bit_length() + SPARE)] * (len(lengths) - 1) + [64]

    def ask(name: int, own: _Slice, level: int, repeats: np.ndarray | None) -> pa.RecordBatch:
        before, last = lengths[level - 1] if level else 0, level == len(lengths) - 1
        asked = _Asked.of(own, *own.candidates(lengths[level], before, repeats, width), lengths[level], bits[level])
        used, bodies = asked.rows(parts, bits[level], last)
        if repeats is not None:
            used, bodies = [*used, _STATE], [*bodies, np.packbits(repeats).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array(bodies, pa.binary())], names=["slice", "part", "body"])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                yield ask(name, _Slice.read(body.as_buffer(), text.as_buffer()), 0, None)

    def answering(last: bool):
        def answer(table: pa.Table) -> pa.Table:
            return _answer(last, table)

        return answer

    def onward(level: int):
        def step(table: pa.Table) -> pa.Table:
            name, own, asked, repeated = _opened(table, level, lengths, bits)
            repeats = np.zeros(len(own.words.hashes), dtype=bool)
            repeats[asked.at[asked.each(repeated)] if len(asked.at) else asked.at] = True
            return pa.Table.from_batches([ask(name, own, level + 1, repeats)])

        return step

    def end(table: pa.Table) -> pa.Table:
        _, own, asked, smaller = _opened(table, len(lengths) - 1, lengths, bits)
        return _kept(own, asked, smaller, width)

    texts, none = cut.select("slice", "part", "body", "text"), F.lit(None).cast("binary").alias("text")
    asking = cut.select("slice", "body", "text").mapInArrow(tidied(start), _ROWS)
    state = None
    for level in range(len(lengths)):
        last = level == len(lengths) - 1
        answers = asking.filter("part >= 0").groupBy("part").applyInArrow(tidied_group(answering(last)), _ROWS)
        known = answers if state is None else answers.unionByName(state)
        gathered = texts.unionByName(known.select("slice", "part", "body", none)).groupBy("slice")
        if last:
            return gathered.applyInArrow(tidied_group(end), _KEPT)
        asking = saved(gathered.applyInArrow(tidied_group(onward(level)), _ROWS))
        state = asking.filter(F.col("part") == _STATE)
    raise AssertionError
