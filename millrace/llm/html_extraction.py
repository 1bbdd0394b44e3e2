"""The main text of web pages.

Boosted trees give every node of a page's tree the odds of holding main text; the
choice for the whole tree is then made at once, so that nothing is taken from
inside what is left out, and a container is taken when what it holds is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.boosting import Boosted, boost
from millrace.llm.dom import decode, features, parse
from millrace.llm.page_maker import PageMaker

#: Nodes whose odds are computed together.
_NODES = 50_000


def labelled(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, whether a node holds main text) of so many made-up pages."""
    maker, rows, labels = PageMaker(seed), [], []
    for _ in range(pages):
        nodes = parse(maker.page())
        held = [False] * len(nodes)
        for k, node in enumerate(nodes):
            node.index = k
            if "\x02" in node.text:
                node.text = node.text.replace("\x02", "").replace("\x03", "")
                node.chars = len(node.text)
                held[k] = True
        for node in reversed(nodes):
            if held[node.index] and node.parent:
                held[node.parent.index] = True
        rows += features(nodes)
        labels += held
    return np.array(rows), np.array(labels, dtype=float)


@lru_cache(maxsize=2)
def model(pages: int = 700, seed: int = 11) -> Boosted:
    """The trees, trained on a bounded number of made-up pages."""
    return boost(*labelled(pages, seed))


def blocks(page: str, trees: Boosted) -> list[str]:
    """The blocks of one page's main text, in page order."""
    nodes = parse(page)
    chosen = decode(nodes, trees.logits(np.array(features(nodes))))
    return [n.text for n, yes in zip(nodes, chosen, strict=True) if yes and n.tag == "#text"]


def _texts(pages: list[str | None], trees: Boosted) -> Iterator[str]:
    held, rows = [], []

    def flush() -> Iterator[str]:
        logits, at = trees.logits(np.array(rows)) if rows else [], 0
        for nodes in held:
            chosen = decode(nodes, logits[at : at + len(nodes)])
            at += len(nodes)
            yield "\n\n".join(n.text for n, yes in zip(nodes, chosen, strict=True) if yes and n.tag == "#text")

    for page in pages:
        nodes = parse(page or "")
        held.append(nodes)
        rows += features(nodes)
        if len(rows) >= _NODES:
            yield from flush()
            held, rows = [], []
    yield from flush()


def extracted(pages: DataFrame, *, trees: Boosted | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block is one space, and
    blocks are joined by an empty line.  A null or empty page, and one without main
    text, has an empty text.  Each row is read for itself: no shuffle, whole pages,
    repeated rows stay.  An empty table gives an empty one.
    """
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType())])
    shared = pages.sparkSession.sparkContext.broadcast(trees or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(_texts(part.column(2).to_pylist(), shared.value)), pa.string())], names=schema.names)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, schema)
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
