"""Exact n-gram Jaccard join and its connected groups.

A document's set of word n-grams is a set of 64-bit hashes.  Two documents of n and
m grams link when 100 * intersection >= threshold * union.  Grams are ordered by how
many documents hold them, over all documents: a linked pair shares one of the rarest
grams of both (prefix filter).  A gram that one document alone holds can't be
shared, so it only fills the prefix.  A pair must fit in length, and at its first
common gram both must have enough grams left (positional filter) and enough of them
in their prefixes; how the sets spread over fixed ranges of hashes bounds their
overlap once more (suffix filter).  A pair that passes is verified once, on full sets.

Counting: every slice of texts sends its distinct grams, packed, to the parts of the
hash space, and a part returns the count of each gram that is held twice.  A gram
costs a slice one entry however many of its documents hold it, so no gram is hot.

No group is ever expanded into all its pairs.  Each prefix gram has one hub, the
document with the smallest share of grams of its own, and a round tries every
document with the hub that it has most grams in common with.  What remains outside
its hub's component is compared as classes: documents of one component with equal
size, prefix and position are one row.  Only classes that pass all bounds are
expanded, and no pair that a round has tested is tested again.  That step leaves no
untested pair between two components, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.packed import CHANGED, packed, part_edges, parts_for, slice_name, steps_of, unpacked
from millrace.llm.shared import saved
from millrace.llm.textcore import buffer_of, mix, ragged, slices, tidied, tidied_group, window_hashes, words

#: Most documents of a slice.
SLICE_DOCS = 1 << 15
#: Ranges of hashes that the suffix filter compares.
RANGES = 32
#: Most document ids that are broadcast; more are joined by a shuffle.
BROADCAST_DOCS = 1 << 20
#: While the classes that pass stand for more than DIRECT pairs a posting, further rounds with hubs come first, ROUNDS at most; either way every pair between components is tested.
ROUNDS, DIRECT = 3, 32
#: How often hubs of hubs are followed between rounds; what that leaves apart is only compared again.
JUMPS = 3

_MANY = 0xFFFF


def gram_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct gram hashes of all texts, n + 1 offsets); a text of fewer words has one gram, its whole."""
    w = words(data, offsets, lower=True)
    n = np.diff(w.bounds)
    grams = window_hashes(w.hashes, width)
    docs = len(offsets) - 1
    out, sizes = [], np.zeros(docs, dtype=np.int64)
    for d in range(docs):
        a, b = w.bounds[d], w.bounds[d + 1]
        if n[d] >= width:
            own = np.unique(grams[a : b - width + 1])
        elif n[d]:
            own = window_hashes(w.hashes[a:b], int(n[d]))
        else:
            own = grams[:0]
        out.append(own)
        sizes[d] = len(own)
    return np.concatenate(out) if out else grams[:0], np.concatenate([[0], np.cumsum(sizes)])


def prefix_length(n: np.ndarray, threshold: int) -> np.ndarray:
    """Rarest grams of a set of n of which a linked set must share one."""
    return n - -(-n * threshold // 100) + (n > 0)


_SENT = "part int, slice long, own boolean, body binary"
_ANSWERED = "slice long, own boolean, entries long, body binary"
_SIGNED = "doc_id long, n long, sign long, sign2 long, alone long, prefix array<long>, spread array<int>"


def _sent(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """For each slice of the rows (doc_id, text): its distinct grams by part, and one row of what it knows of its documents.

    A gram comes with its document's place in the slice, or with _MANY and the number of its documents; who they are stays in the slice's own row.
    """
    edges = part_edges(parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for a, b in ((x, min(x + SLICE_DOCS, to)) for at, to in slices(offsets) for x in range(at, to, SLICE_DOCS)):
                grams, bounds = gram_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                n = np.diff(bounds)
                doc = np.repeat(np.arange(b - a), n)
                spread = np.bincount(doc * RANGES + (grams >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64), minlength=(b - a) * RANGES).astype(np.uint32)
                signs = []
                for salt in (0x1B873593CC9E2D51, 0x52DCE729DA3ED6C5):
                    x = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(grams ^ np.uint64(salt)))])
                    signs.append(x[bounds[1:]] - x[bounds[:-1]])
                order = np.argsort(grams, kind="stable")
                grams, doc = grams[order], doc[order].astype(np.uint16)
                first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else order
                held = np.diff(np.append(first, len(grams)))
                distinct, holder = grams[first], np.where(held > 1, np.uint16(_MANY), doc[first])
                many = np.flatnonzero(held > 1)
                ids = batch.column(0).slice(a, b - a)
                known = np.asarray(ids.is_valid())
                numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                name = slice_name(task, seq, numbers, signs[0])
                seq += 1
                own = packed(np.array([len(distinct)]), numbers, known.astype(np.uint8), n, *signs, spread, steps_of(distinct[many]), held[many].astype(np.uint32), doc[ragged(first[many], held[many])])
                cut = np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]])
                used = np.flatnonzero(np.diff(cut))
                bodies = [packed(steps_of(distinct[x:y]), holder[x:y], held[x:y][holder[x:y] == _MANY].astype(np.uint32)) for x, y in zip(cut[used], cut[used + 1], strict=True)]
                columns = [pa.array([*used.tolist(), name % parts], pa.int32()), pa.array([name] * (len(used) + 1), pa.int64()), pa.array([False] * len(used) + [True]), pa.array([*bodies, own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "slice", "own", "body"])

    return rows.mapInArrow(tidied(send), _SENT)


def _answers(table: pa.Table) -> pa.Table:
    """Of one part's grams those that two documents hold, with that count, for every slice; slices' own rows pass."""
    names, own = table.column("slice").to_numpy(), table.column("own").to_numpy()
    bodies = [x.as_buffer() for x in table.column("body")]
    asked = np.flatnonzero(~own)
    grams, holders, counts = [], [], []
    for i in asked:
        steps, holder, many = unpacked(bodies[i], "QHI")
        held = np.ones(len(steps), dtype=np.uint32)
        held[holder == _MANY] = many
        grams.append(np.cumsum(steps))
        holders.append(holder)
        counts.append(held)
    out = [(int(names[i]), True, 0, bodies[i].to_pybytes()) for i in np.flatnonzero(own)]
    if len(asked):
        sizes = [len(x) for x in grams]
        gram, holder, held = np.concatenate(grams), np.concatenate(holders), np.concatenate(counts)
        del grams, holders, counts
        order = np.argsort(gram, kind="stable")
        ordered = gram[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        del ordered
        total = np.empty(len(gram), dtype=np.int64)
        total[order] = np.repeat(np.add.reduceat(held[order], first, dtype=np.int64), np.diff(np.append(first, len(gram))))
        del order, first, held
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i, a, b in zip(asked, at[:-1], at[1:], strict=True):
            keep = a + np.flatnonzero(total[a:b] > 1)
            out.append((int(names[i]), False, int(b - a), packed(steps_of(gram[keep]), holder[keep], total[keep])))
    columns = list(zip(*out, strict=True))
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["slice", "own", "entries", "body"])


def _selected(table: pa.Table, threshold: int) -> pa.Table:
    """_SIGNED rows of one slice's documents."""
    own = np.flatnonzero(table.column("own").to_numpy())
    bodies = [x.as_buffer() for x in table.column("body")]
    if len(own) != 1:
        raise RuntimeError(CHANGED)
    total, numbers, known, n, sign, sign2, spread, steps, held, docs = unpacked(bodies[own[0]], "qqBqQQIQIH")
    if total[0] != sum(table.column("entries").to_pylist()):
        raise RuntimeError(CHANGED)
    many, starts = np.cumsum(steps), np.cumsum(held, dtype=np.int64) - held
    parts = [unpacked(x, "QHq") for i, x in enumerate(bodies) if i != own[0]]
    gram = np.concatenate([np.empty(0, dtype=np.uint64), *(np.cumsum(p[0]) for p in parts)])
    holder = np.concatenate([np.empty(0, dtype=np.uint16), *(p[1] for p in parts)])
    count = np.concatenate([np.empty(0, dtype=np.int64), *(p[2] for p in parts)])
    one, several = np.flatnonzero(holder != _MANY), np.flatnonzero(holder == _MANY)
    at = np.searchsorted(many, gram[several])
    times = held[at].astype(np.int64)
    doc = np.concatenate([holder[one], docs[ragged(starts[at], times)]]).astype(np.int64)
    gram = np.concatenate([gram[one], np.repeat(gram[several], times)])
    count = np.concatenate([count[one], np.repeat(count[several], times)])
    order = np.lexsort((gram, count, doc))
    doc, gram = doc[order], gram[order]
    shared = np.bincount(doc, minlength=len(n))
    alone = n - shared
    place = np.arange(len(doc)) - (np.cumsum(shared) - shared)[doc]
    keep = place + alone[doc] < prefix_length(n, threshold)[doc]
    sizes = np.bincount(doc[keep], minlength=len(n))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(gram[keep].view(np.int64)))
    ranged = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * RANGES + 1, RANGES, dtype=np.int32)), pa.array(spread.astype(np.int32)))
    ids = pa.array(numbers, mask=known == 0)
    return pa.table([ids, pa.array(n), pa.array(sign.view(np.int64)), pa.array(sign2.view(np.int64)), pa.array(alone), lists, ranged], names=["doc_id", "n", "sign", "sign2", "alone", "prefix", "spread"])


def _signatures(rows: DataFrame, width: int, threshold: int) -> DataFrame:
    """doc_id, n, sign and sign2 (equal for equal sets), alone (grams that no other document holds), prefix (the rarest of the others, rarest first), spread (grams in each range)."""
    sent = _sent(rows, width, parts_for(rows))
    answered = sent.groupBy("part").applyInArrow(tidied_group(_answers), _ANSWERED)
    return answered.groupBy("slice").applyInArrow(tidied_group(lambda table: _selected(table, threshold)), _SIGNED)


@dataclass
class _Corpus:
    docs: DataFrame  # doc_id, text
    reps: DataFrame  # doc, spread: of each set that shares a gram of its prefix
    width: int
    threshold: int


def _sets(c: _Corpus, ids: DataFrame) -> DataFrame:
    """doc_id, grams (all of them) of the documents in ids."""
    width = c.width

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for a, b in slices(offsets):
                grams, bounds = gram_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(grams.view(np.int64)))], names=["doc_id", "grams"])

    side = F.broadcast(ids) if ids.count() <= BROADCAST_DOCS else ids
    return c.docs.join(side, "doc_id", "left_semi").mapInArrow(tidied(extract), "doc_id long, grams array<long>").dropDuplicates(["doc_id"])


def _needed(threshold: int) -> Column:
    """Least intersection of linked sets of n and m: ceil(threshold * (n + m) / (100 + threshold))."""
    return F.ceil((F.col("n") + F.col("m")) * threshold / F.lit(100 + threshold) - F.lit(1e-9)).cast("long")


def _may_start(threshold: int) -> Column:
    """Whether the gram at position i of n and j of m can be the first that two linked sets have in common.

    Both must be long enough together, have enough grams from there on, and have as
    many prefix grams from there on (r of s, q of t come before) as they must have in
    common: the longer suffix behind a prefix holds at most ceil(threshold * larger) - 1.
    """
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * threshold
    reach = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= _needed(threshold)
    behind = F.ceil(F.greatest("n", "m") * threshold / F.lit(100) - F.lit(1e-9)) - 1
    return fits & reach & (F.least(F.col("s") - F.col("r"), F.col("t") - F.col("q")) >= _needed(threshold) - behind)


def _close(threshold: int) -> Column:
    """Suffix filter of (n, m, sx, sy): how far the sets spread apart bounds their difference from below."""
    apart = F.aggregate(F.zip_with("sx", "sy", lambda p, q: F.abs(p - q)), F.lit(0), lambda total, v: total + v)
    return apart <= F.col("n") + F.col("m") - 2 * _needed(threshold)


def _verified(c: _Corpus, pairs: DataFrame) -> DataFrame:
    """Of the pairs (x, y, n, m) those that link: x, y as they are."""
    sx = c.reps.select(F.col("doc").alias("x"), F.col("spread").alias("sx"))
    sy = c.reps.select(F.col("doc").alias("y"), F.col("spread").alias("sy"))
    pairs = saved(pairs.join(sy, "y").join(sx, "x").filter(_close(c.threshold)).select("x", "y", "n", "m"))
    ids = pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct()
    sets = saved(_sets(c, saved(ids)))
    left = sets.select(F.col("doc_id").alias("x"), F.col("grams").alias("gx"))
    right = sets.select(F.col("doc_id").alias("y"), F.col("grams").alias("gy"))
    both = pairs.join(right, "y").join(left, "x")
    common = F.size(F.array_intersect("gx", "gy"))
    return both.filter(common * 100 >= (F.col("n") + F.col("m") - common) * c.threshold).select("x", "y")


_LEFT = {"doc": "x", "n": "n", "at": "i", "s": "s", "r": "r"}
_RIGHT = {"doc": "y", "n": "m", "at": "j", "s": "t", "r": "q"}


def _side(postings: DataFrame, names: dict[str, str], *more: Column) -> DataFrame:
    return postings.select("gram", *(F.col(k).alias(v) for k, v in names.items()), *more)


def _hub_pairs(postings: DataFrame, threshold: int) -> DataFrame:
    """x, y, n, m: for each document y the one hub, of those of its grams, with which it may link by most grams.

    The order of hubs is one for all grams, so chains of hubs have no cycles.
    """
    hubs = postings.groupBy("gram").agg(F.min(F.struct("own", F.xxhash64("doc").alias("o"), *_LEFT)).alias("hub"))
    hubs = hubs.select("gram", "hub.own", "hub.o", *(F.col(f"hub.{k}").alias(v) for k, v in _LEFT.items()))
    met = _side(postings, _RIGHT).join(hubs, "gram").filter((F.col("x") != F.col("y")) & _may_start(threshold))
    pairs = met.groupBy("x", "y").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("own").alias("own"), F.first("o").alias("o"), F.count("*").alias("c"))
    best = pairs.groupBy("y").agg(F.min(F.struct((-F.col("c")).alias("c"), "own", "o", "x", "n", "m")).alias("b"))
    return best.select("b.x", "y", "b.n", "b.m")


def _hung(links: DataFrame) -> DataFrame:
    """doc, component of every linked document: the end of its chain of hubs (x of y), as far as JUMPS doublings follow it."""
    up = links.groupBy(F.col("y").alias("doc")).agg(F.min("x").alias("component"))
    for _ in range(JUMPS):
        over = up.select(F.col("doc").alias("_d"), F.col("component").alias("_c"))
        up = up.join(over, F.col("component") == F.col("_d"), "left").select("doc", F.coalesce("_c", "component").alias("component"))
    tops = up.select("component").distinct().select(F.col("component").alias("doc"), "component")
    return up.union(tops.join(up.select("doc"), "doc", "left_anti"))


def _classes(postings: DataFrame) -> DataFrame:
    """Postings of one gram that are alike in all that _may_start() looks at, with their component (null for documents in none) and how many they are."""
    return postings.groupBy("gram", "n", "at", "s", "r", "component").agg(F.count("*").alias("docs"))


def _expanded(classes: DataFrame, postings: DataFrame, names: dict[str, str], component: str) -> DataFrame:
    """The documents of one side of the class pairs."""
    own = _side(postings, names, F.col("component").alias(component))
    same = [F.col(f"p.{k}") == F.col(f"c.{k}") for k in ("gram", *(v for v in names.values() if v not in "xy"))]
    joined = classes.alias("c").join(own.alias("p"), [*same, F.col(f"p.{component}").eqNullSafe(F.col(f"c.{component}"))])
    return joined.select("c.*", F.col(f"p.{names['doc']}"))


def _links(c: _Corpus, postings: DataFrame) -> DataFrame:
    """x, y: verified links that connect what all links connect; postings has gram, doc, n, at, s, r, own."""
    n_postings = postings.count()
    tested = saved(_hub_pairs(postings, c.threshold))
    links = saved(_verified(c, tested))
    for rounds in range(ROUNDS + 1):
        placed = saved(postings.join(_hung(links), "doc", "left"))
        hubs = placed.groupBy("gram").agg(F.min(F.struct("own", F.xxhash64("doc").alias("o"), F.coalesce("component", "doc").alias("main"))).alias("h")).select("gram", F.col("h.main").alias("main"))
        rest = saved(placed.join(hubs, "gram").filter(F.coalesce("component", "doc") != F.col("main")).drop("main"))
        left, right = (_classes(p) for p in (rest, placed))
        left = left.select("gram", *(F.col(k).alias(v) for k, v in _LEFT.items() if k != "doc"), F.col("component").alias("cx"), F.col("docs").alias("dx"))
        right = right.select("gram", *(F.col(k).alias(v) for k, v in _RIGHT.items() if k != "doc"), F.col("component").alias("cy"), F.col("docs").alias("dy"))
        apart = F.col("cx").isNull() | F.col("cy").isNull() | (F.col("cx") != F.col("cy"))
        classes = saved(left.join(right, "gram").filter(apart & _may_start(c.threshold)))
        cost = classes.agg(F.sum(F.col("dx").cast("double") * F.col("dy"))).first()[0]
        if cost is None:
            return links
        if rounds < ROUNDS and cost > DIRECT * n_postings:
            more = saved(_hub_pairs(rest, c.threshold).join(tested, ["x", "y"], "left_anti"))
            tested = tested.unionByName(more)
            links = saved(links.unionByName(_verified(c, more)))
            continue
        met = _expanded(_expanded(classes, rest, _LEFT, "cx"), placed, _RIGHT, "cy").filter("x != y")
        flip = F.col("x") > F.col("y")
        once = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.when(flip, F.col("m")).otherwise(F.col("n")).alias("n"), F.when(flip, F.col("n")).otherwise(F.col("m")).alias("m")).distinct()
        known = tested.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        return links.unionByName(_verified(c, once.join(known, ["x", "y"], "left_anti")))
    raise AssertionError


def near_duplicate_groups(docs: DataFrame, *, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Words are runs of bytes that are not white space, A-Z in lower case; a
    document of fewer than width words has its whole word sequence as its one
    gram; one without words (or with a null text) has an empty set and links with
    nothing.  threshold is in percent.  Equal sets are one node from the start, so
    exact copies, however many, cost no pairs.  Repeated rows are equal sets.  A
    null id is nobody's: such a row gets component_id null.  Ids must be integers;
    texts of one id that differ are one document of which one text's links count
    for verification, so ids should be unique.  An empty table gives an empty one.
    Gram identity is a 64-bit hash, set identity two sums of 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = saved(_signatures(rows, width, threshold))
    key = ["n", "sign", "sign2"]
    known = signed.filter("n > 0 and doc_id is not null")
    firsts = known.groupBy(*key).agg(F.min("doc_id").alias("doc"))
    live = known.filter(F.size("prefix") > 0)
    reps = saved(live.groupBy(*key).agg(F.min("doc_id").alias("doc"), F.first("spread").alias("spread"), F.first("prefix").alias("prefix"), F.first("alone").alias("alone")))
    postings = reps.select("doc", "n", "alone", F.posexplode("prefix").alias("at", "gram")).withColumn("at", F.col("at") + F.col("alone"))
    often = postings.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1").select("gram")
    shared = postings.join(often, "gram")
    by_doc = Window.partitionBy("doc")
    shared = shared.select("gram", "doc", "n", "at", (F.col("alone") / F.col("n")).alias("own"), F.count("*").over(by_doc).alias("s"), (F.row_number().over(by_doc.orderBy("at")) - 1).cast("long").alias("r"))
    c = _Corpus(rows.filter(F.col("doc_id").isNotNull()), reps.select("doc", "spread"), width, threshold)
    labels = components(_links(c, saved(shared)))
    named = firsts.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").select(*key, F.coalesce("component", "doc").alias("component_id"))
    flags = signed.select("doc_id", *key).join(named, key, "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return flags.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def without_near_duplicates(docs: DataFrame, *, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    A null or empty text is a group of its own, and a row with a null id stays.
    Rows that repeat an id are one document and stay or go together (exact dedup
    leaves one of those that repeat the text as well).  Other columns, whatever
    their names, are carried along; an empty table gives an empty one.
    """
    groups = near_duplicate_groups(docs, width=width, threshold=threshold, id_col=id_col, text_col=text_col)
    drop = saved(groups.filter("doc_id != component_id").select(F.col("doc_id").alias("_drop_id")).distinct())
    side = F.broadcast(drop) if drop.count() <= BROADCAST_DOCS else drop
    return docs.join(side, docs[id_col] == side["_drop_id"], "left_anti")
