"""Language identification by compression.

Each language has a dictionary of raw text.  A text is encoded with every
dictionary; the one that makes it smallest names the language, and a narrow margin
rejects the answer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.textcore import tidied

UNKNOWN = "und"
_GAP = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Whether the document is kept from learning: crc32 of its id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _plain(text: str) -> str:
    """Letters in lower case; everything between them is one space."""
    return _GAP.sub(" ", text.lower()).strip()


@dataclass
class LanguageId:
    """A dictionary for each language, the most frequent first, and how texts are encoded with them.

    block: bytes that are encoded at a time, whatever the length of the text.
    short: a frame of few bytes holds them as they are, so texts of at most so many
    are encoded four times over, and their words and pairs of words by themselves.  min_margin: by how much of
    the least size the second must exceed it.  sharpness: of the score, by byte.
    """

    dictionaries: dict[str, bytes]
    level: int = 6
    block: int = 2048
    short: int = 512
    min_margin: float = 0.002
    sharpness: float = 0.35
    _encoders: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoders": {}}

    def sizes(self, text: str) -> dict[str, int]:
        """Encoded bytes of the whole text under each language; of equal ones the more frequent language wins."""
        if not self._encoders:
            import zstandard

            for name, raw in self.dictionaries.items():
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._encoders[name] = zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        plain = _plain(text)
        raw = plain.encode()
        n = max(1, math.ceil(len(raw) / self.block))
        step = math.ceil(len(raw) / n)
        parts = [raw[k : k + step] for k in range(0, len(raw), step)] if raw else []
        if len(raw) <= self.short:
            words = plain.split(" ")
            parts = [b" ".join([raw] * 4)] + [f" {w} ".encode() * 12 for w in words] + [f" {v} {w} ".encode() * 8 for v, w in zip(words, words[1:], strict=False)]
        return {name: sum(len(e.compress(p)) for p in parts) for name, e in self._encoders.items()}

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score from 0 to 1, margin); UNKNOWN, 0, 0 for a text without letters or a model without languages."""
        if not text or not self.dictionaries or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, 0.0
        order = sorted((n, k, name) for k, (name, n) in enumerate(self.sizes(text).items()))
        least = order[0][0]
        score = 1 / sum(math.exp(max(-700.0, -self.sharpness * (n - least))) for n, _, _ in order)
        margin = (order[1][0] - least) / max(1, least) if len(order) > 1 else 1.0
        return order[0][2], score, margin

    def identify(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row for each document: doc_id, held_out, lang_pred, score, margin, rejected.

        A null text or one without a letter is UNKNOWN with score 0 and rejected, as
        is an answer with a margin under min_margin (its lang_pred stays).  Only the
        text is looked at.  One pass, no shuffle; an empty table gives an empty one.
        """
        known = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())])
        model = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [model.value.predict(t.as_py()) for t in batch.column(1)]
                columns = list(zip(*found, strict=True)) if found else [(), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())], names=known.names)

        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), known)
        return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", ((F.col("lang_pred") == UNKNOWN) | (F.col("margin") < self.min_margin)).alias("rejected"))

    def accepted(self, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
        """The documents that are not rejected, with all their columns, in one pass.

        Null and empty texts, and texts without a letter, go.  Only the text decides,
        so rows that repeat it stay or go together, and null ids don't matter.  A text
        that two languages encode in equally many bytes has no margin and goes.  Other
        columns, whatever their names, are carried along; an empty table gives an empty one.
        """
        place = docs.columns.index(text_col)
        model = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [model.value.predict(t.as_py()) for t in batch.column(place)]
                yield batch.filter(pa.array([name != UNKNOWN and margin >= model.value.min_margin for name, _, margin in found], pa.bool_()))

        return docs.mapInArrow(tidied(run), docs.schema)


def fit(docs: DataFrame, *, sample_docs: int = 600, piece_chars: int = 400, dictionary_bytes: int = 1 << 17, languages: int = 512, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> LanguageId:
    """Learn dictionaries from labelled documents that are not held out.

    A bounded sample is enough and is the documented limit: of each label about
    sample_docs documents, chosen by a hash of their id, and of each a piece of
    piece_chars characters at a place that the hash chooses; a dictionary ends at
    dictionary_bytes.  Labels are counted over all documents, and no label is left
    out: a table with more than `languages` of them raises ValueError, since every
    worker holds a dictionary for each.  Null texts, null labels and null ids (of
    which nobody can tell whether they are held out) teach nothing; rows that repeat
    an id teach once.  Of labels with equal counts the lesser name comes first.  An
    empty table gives a model that answers UNKNOWN.  Only the three columns are read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages + 1).collect()
    if len(counts) > languages:
        raise ValueError(f"more than {languages} labels; raise languages")
    if not counts:
        return LanguageId({}, **options)
    span = 1 << 40
    cuts = docs.sparkSession.createDataFrame([(r.lang, min(span, math.ceil(span * sample_docs / r["count"]))) for r in counts], "lang string, cut long")
    order = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    chosen = rows.withColumn("order", order).join(F.broadcast(cuts), "lang").filter("order < cut")
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - piece_chars + 1)) + 1
    pieces = chosen.select("lang", "order", F.substring("text", start.cast("int"), F.lit(piece_chars)).alias("piece"))
    pieces = pieces.groupBy("lang", "order").agg(F.min("piece").alias("piece")).collect()
    parts: dict[str, list[str]] = {}
    rank = {r.lang: k for k, r in enumerate(counts)}
    for r in sorted(pieces, key=lambda r: (r.lang, r.order, r.piece)):
        parts.setdefault(r.lang, []).append(_plain(r.piece))
    return LanguageId({name: " ".join(p).encode()[:dictionary_bytes] for name, p in sorted(parts.items(), key=lambda x: rank[x[0]])}, **options)
