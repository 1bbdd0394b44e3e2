"""Document scores by masked pseudo-likelihood.

A window network sees the two words on each side of a position and predicts the
word there; a document's score is the sum of these conditional log-probabilities
over all its words.  The network is trained with numpy on every document: each task
descends on its own rows from the shared weights, and the tasks' weights are averaged
in a tree, so neither rows nor one task's share ever meet on the driver.

The network's vocabulary grows with the input.  A word outside it is scored as its
bucket's probability times the word's share of the bucket, (n or 1) / (bucket's
words + 1) with the counts of all documents: the bucket's sum with one unseen word is 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import shared_dir
from millrace.llm.textcore import HashMap, buffer_of, mix, slices, words

#: The smallest vocabulary: CLASSES of CLASS_SIZE, of which one is the border of a text and a sixteenth, rounded down to a power of two, are buckets of hashed rare words.
CLASSES, CLASS_SIZE = 32, 32
VOCABULARY = CLASSES * CLASS_SIZE
#: Classes, and words in each, for the fourth root of the number of words: the vocabulary grows with its square root.
GROWTH = 2 / 3
#: How many words' counts go to every worker at most; the others' are joined.
COUNTED = 1 << 16
OFFSETS = (-2, -1, 1, 2)
WIDTH, BATCH, RATE = 16, 8192, 0.1
#: How many positions are scored at once.
AT_ONCE = 4 * BATCH
#: How many tasks' weights one task averages.
FAN_IN = 16


def _initial(counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights that predict the words' frequencies whatever stands around."""
    rng = np.random.default_rng(seed)
    side = math.isqrt(len(counts))
    share = (counts + 1.0).reshape(side, side)
    by_class = share.sum(axis=1)
    out = {
        "seen": rng.normal(0, 0.3, (len(OFFSETS), len(counts), WIDTH)),
        "bias": np.zeros(WIDTH),
        "to_class": rng.normal(0, 0.1, (WIDTH, side)),
        "class_bias": np.log(by_class / by_class.sum()),
        "to_word": rng.normal(0, 0.1, (side, side, WIDTH)),
        "word_bias": np.log(share / by_class[:, None]),
    }
    return {k: v.astype(np.float32) for k, v in out.items()}


#: Scores that stay within this of 0 are exponentiated as they are: neither their exponentials nor a sum of these leave the range of a float.
NEAR = 75.0


def _with_ones(h: np.ndarray) -> np.ndarray:
    """h with a column of ones, so that one product adds the bias too."""
    out = np.ones((len(h), h.shape[1] + 1), dtype=h.dtype)
    out[:, :-1] = h
    return out


def _exponentials(x: np.ndarray, near: bool) -> np.ndarray:
    """Probabilities up to a factor for each row, in x's place; scores that aren't near 0 are first taken from their row's greatest."""
    if not near:
        x -= x.max(axis=1, keepdims=True)
    return np.exp(x, out=x)


def _segment_sum(ids: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, the sums of their rows)."""
    order = np.argsort(ids.astype(np.uint16) if size <= 1 << 16 else ids, kind="stable")
    own = ids[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], np.add.reduceat(values[order], first, axis=0)


def network(w: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray, gradient: bool) -> tuple[np.ndarray, dict]:
    """(log-probability of each target, gradients of the mean loss if asked); around has a row for each offset.

    The gradient of "seen" is, for each offset, the words that were seen and the rows of these alone.
    """
    n = len(target)
    classes, class_size, width = w["to_word"].shape
    cls, own = np.divmod(target.astype(np.int32), np.int32(class_size))
    # positions are worked on by class of their target
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=classes))]).tolist()
    around, cls, own = np.take(around, order, axis=1), cls[order], own[order]
    h = np.take(w["seen"][0], around[0], axis=0)
    for k in range(1, len(OFFSETS)):
        h += np.take(w["seen"][k], around[k], axis=0)
    h += w["bias"]
    np.tanh(h, out=h)
    # |h| is at most 1, so this bounds every score
    near = bool((np.abs(w["to_class"]).sum(axis=0) + np.abs(w["class_bias"])).max() < NEAR and (np.abs(w["to_word"]).sum(axis=2) + np.abs(w["word_bias"])).max() < NEAR)
    one = np.ones(max(classes, class_size), dtype=h.dtype)
    at = np.arange(n) * classes + cls
    h1 = _with_ones(h)
    p = _exponentials(h1 @ np.concatenate([w["to_class"], w["class_bias"][None]]), near)
    p_sum = p @ one[:classes]
    p_own = p.ravel()[at]
    in_q = own + np.arange(n) * class_size
    q_sum, q_own = np.empty(n, dtype=h.dtype), np.empty(n, dtype=h.dtype)
    to_word = np.concatenate([w["to_word"], w["word_bias"][:, :, None]], axis=2)
    room = np.empty((int(np.diff(bounds).max(initial=0)), class_size), dtype=h.dtype)
    grads: dict[str, np.ndarray] = {}
    if gradient:
        back, of_word = np.empty((n, width), dtype=h.dtype), np.zeros_like(to_word)
    for c in range(classes):
        a, b = bounds[c], bounds[c + 1]
        if a == b:
            continue
        q = _exponentials(np.dot(h1[a:b], to_word[c].T, out=room[: b - a]), near)
        total = np.dot(q, one[:class_size], out=q_sum[a:b])
        flat, pick = q.ravel(), in_q[a:b] - a * class_size
        q_own[a:b] = flat[pick]
        if gradient:
            # (probability - whether it is the target) times the row's sum; the sum is taken out of the narrower factors
            flat[pick] -= total
            np.dot(q.T, h1[a:b] / total[:, None], out=of_word[c])
            np.dot(q, w["to_word"][c], out=back[a:b])
    log_p = np.empty(n, dtype=h.dtype)
    log_p[order] = np.log(np.maximum(p_own / p_sum, 1e-30)) + np.log(np.maximum(q_own / q_sum, 1e-30))
    if gradient:
        of_word /= n
        grads["to_word"], grads["word_bias"] = of_word[:, :, :-1], of_word[:, :, -1]
        p.ravel()[at] -= p_sum
        of_class = (h1 / p_sum[:, None]).T @ p / n
        grads["to_class"], grads["class_bias"] = of_class[:-1], of_class[-1]
        to_h = p @ w["to_class"].T
        to_h /= p_sum[:, None]
        back /= q_sum[:, None]
        to_h += back
        to_h *= 1 - h * h
        to_h /= n
        grads["bias"] = to_h.sum(axis=0)
        grads["seen"] = [_segment_sum(around[k], to_h, w["seen"].shape[1]) for k in range(len(OFFSETS))]
    return log_p, grads


@dataclass
class Scorer:
    """Frequent words and the network's weights.

    vocabulary: hashes of the frequent words, the most frequent first; as many as fit have an id of their own.
    counts: how often each of them was seen; in_bucket: words seen in each bucket; table: all words' counts as Parquet.
    Without counts, a word outside the vocabulary has its bucket's probability.
    """

    vocabulary: np.ndarray
    weights: dict[str, np.ndarray]
    counts: np.ndarray | None = None
    in_bucket: np.ndarray | None = None
    table: str | None = None
    _map: HashMap | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_map": None}

    @property
    def size(self) -> int:
        return self.weights["seen"].shape[1]

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place among the frequent ones, or -1."""
        if self._map is None:
            self._map = HashMap(13)
            self._map.add(self.vocabulary)
        return self._map.find(hashes).astype(np.int64)

    def ids(self, hashes: np.ndarray, found: np.ndarray) -> np.ndarray:
        others = _buckets(self.size)
        rare = self.size - others + (hashes % np.uint64(others)).astype(np.int64)
        return np.where((found >= 0) & (found < self.size - others - 1), found + 1, rare).astype(np.int32)

    def positions(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids with two borders around every text, where the words stand in them, words of each text)."""
        return self._placed(data, offsets)[:3]

    def _placed(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(positions, and the words' hashes and places among the frequent ones)."""
        w = words(data, offsets, lower=True)
        n = np.diff(w.bounds)
        where = np.arange(len(w.hashes)) + 2 * (1 + np.repeat(np.arange(len(n)), n))
        row = np.zeros(len(w.hashes) + 2 * (len(n) + 1), dtype=np.int32)
        found = self.found(w.hashes)
        row[where] = self.ids(w.hashes, found)
        return row, where, n, w.hashes, found

    def log_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum over each text's words, number of them); a word outside the frequent ones counts as seen once."""
        return self._sums(data, offsets)[:2]

    def _sums(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log_probabilities, and the text and hash of each word that stands outside the frequent ones)."""
        row, where, n, hashes, found = self._placed(data, offsets)
        out = np.empty(len(where))
        for a in range(0, len(where), AT_ONCE):
            at = where[a : a + AT_ONCE]
            out[a : a + AT_ONCE] = network(self.weights, np.stack([row[at + k] for k in OFFSETS]), row[at], False)[0]
        rest = np.flatnonzero(found < 0)
        if self.counts is not None:
            first = self.size - len(self.in_bucket)
            ids = row[where]
            bucketed = np.flatnonzero(ids >= first)
            out[bucketed] -= np.log(self.in_bucket + 1.0)[ids[bucketed] - first]
            counted = bucketed[found[bucketed] >= 0]
            out[counted] += np.log(self.counts[found[counted]])
        sums = np.concatenate([[0.0], np.cumsum(out)])
        bounds = np.concatenate([[0], np.cumsum(n)])
        return sums[bounds[1:]] - sums[bounds[:-1]], n, np.repeat(np.arange(len(n)), n)[rest], hashes[rest]


def _buckets(size: int) -> int:
    """A power of two, so that signed and unsigned hashes have the same remainder."""
    return 1 << ((size // 16).bit_length() - 1)


class _Descent:
    """Adagrad from given weights."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = {k: v.copy() for k, v in weights.items()}
        self.seen = {k: np.full_like(v, 1e-8) for k, v in weights.items()}
        self.n = 0

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        _, grads = network(self.w, around, target, True)
        for k, (ids, g) in enumerate(grads.pop("seen")):
            total = self.seen["seen"][k][ids] + g * g
            self.seen["seen"][k][ids] = total
            self.w["seen"][k][ids] -= RATE * g / np.sqrt(total)
        for k, g in grads.items():
            self.seen[k] += g * g
            self.w[k] -= RATE * g / np.sqrt(self.seen[k])
        self.n += len(target)


_WEIGHTS = "n long, weights binary"


def _packed(weights: dict[str, np.ndarray], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.concatenate([weights[k].ravel() for k in sorted(weights)]).astype(np.float32).tobytes()], pa.binary())], names=["n", "weights"])


def _unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for own, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(raw.as_buffer(), dtype=np.float32).astype(np.float64) * own
            total, n = x if total is None else total + x, n + own
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "weights"])


def _round(texts: DataFrame, scorer: Scorer, rounds: int, k: int) -> dict[str, np.ndarray]:
    """The average of all tasks' weights after each has learned every rounds-th position, from the k-th on, of its rows."""
    model = texts.sparkSession.sparkContext.broadcast(scorer)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        descent = _Descent(own.weights)
        for batch in batches:
            data, offsets = buffer_of(batch.column(0))
            for a, b in slices(offsets):
                row, where, _ = own.positions(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                where = where[k::rounds]
                for x in range(0, len(where), BATCH):
                    at = where[x : x + BATCH]
                    descent.step(np.stack([row[at + o] for o in OFFSETS]), row[at])
        if descent.n:
            yield _packed(descent.w, descent.n)

    learned = texts.mapInArrow(train, _WEIGHTS)
    n = texts.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        learned = learned.repartition(n).mapInArrow(_average, _WEIGHTS)
    parts = learned.collect()
    if not parts:
        return scorer.weights
    total = sum(p.n for p in parts)
    return _unpacked(sum(np.frombuffer(p.weights, dtype=np.float32).astype(np.float64) * (p.n / total) for p in parts), scorer.weights)


def train(docs: DataFrame, *, rounds: int = 2, text_col: str = "text") -> Scorer:
    """Count the words of all documents, then learn from all of them.

    Every word of every document is a target once: round k takes the positions k,
    k + rounds, ...  What is gathered is the word counts (a shuffle of each task's
    distinct words) and the weights of every task; both grow with the input.  On the
    driver meet the counts of at most COUNTED words and of the buckets.
    """
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(0))
            for a, b in slices(offsets):
                h, n = np.unique(words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True).hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    spark, table = docs.sparkSession, shared_dir(docs.sparkSession)
    texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).write.parquet(table)
    counted = spark.read.schema("word long, n long").parquet(table)
    tier = F.floor(F.log2("n") * 8)
    tiers = counted.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy(F.desc("tier")).collect()
    side = max(CLASSES, round(GROWTH * sum(t.n for t in tiers) ** 0.25))
    size, others = side * side, _buckets(side * side)
    most = max(COUNTED, size)
    least = min((t.tier for t, total in zip(tiers, np.cumsum([t.words for t in tiers]), strict=True) if total <= most), default=1 << 20)
    top = counted.filter(tier >= least).toArrow()
    vocabulary, counts = top["word"].to_numpy(), top["n"].to_numpy()
    order = np.lexsort((vocabulary, -counts))
    vocabulary, counts = vocabulary[order].view(np.uint64), counts[order].astype(np.float64)
    known = size - others - 1
    in_bucket = np.zeros(others)
    for b in counted.groupBy(F.pmod("word", F.lit(others)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        in_bucket[b.bucket] = b.n
    np.subtract.at(in_bucket, (vocabulary[:known] % np.uint64(others)).astype(np.int64), counts[:known])
    first = np.ones(size)
    first[1 : len(counts[:known]) + 1] = counts[:known]
    first[-others:] = in_bucket
    scorer = Scorer(vocabulary, _initial(first), counts, in_bucket, table)
    for k in range(rounds):
        scorer = replace(scorer, weights=_round(texts, scorer, rounds, k))
    return scorer


def scored(docs: DataFrame, scorer: Scorer, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, log_prob (natural, summed), mean_log_prob.

    A null or empty text has 0 tokens, log_prob 0 and mean_log_prob null.  Whole
    texts are scored, each row for itself; an empty table gives an empty one.  The
    counts of words outside the frequent ones come by a join on the word; no such word
    is frequent, so no key is hot, and those seen once add nothing.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("word", T.LongType()), T.StructField("times", T.IntegerType())])
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            data, offsets = buffer_of(batch.column(2))
            for a, b in slices(offsets):
                total, n, text, word = own._sums(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row = batch.column(0).slice(a, b - a)
                keys = row.to_numpy().astype(np.uint64)
                yield pa.RecordBatch.from_arrays([row, batch.column(1).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(total), pa.array(mix(keys.copy()).view(np.int64)), pa.array(np.zeros(b - a, dtype=np.int32))], names=schema.names)
                if own.table is None or not len(word):
                    continue
                order = np.lexsort((word, text))
                text, word = text[order], word[order]
                start = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (word[1:] != word[:-1])]))
                times = np.diff(np.append(start, len(word))).astype(np.int32)
                for x in range(0, len(start), 1 << 17):
                    at = start[x : x + (1 << 17)]
                    none = pa.nulls(len(at))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[text[at]].view(np.int64)), none.cast(batch.column(1).type), none.cast(pa.int64()), none.cast(pa.float64()), pa.array(word[at].view(np.int64)), pa.array(times[x : x + (1 << 17)])], names=schema.names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, schema)
    if scorer.table is None:
        rows = rows.select("doc_id", "n_tokens", "log_prob")
    else:
        seen = docs.sparkSession.read.schema("word long, n long").parquet(scorer.table).filter("n > 1")
        part = rows.join(seen.hint("merge"), "word", "left").groupBy("row")
        more = F.coalesce(F.sum(F.col("times") * F.ln("n")), F.lit(0.0))
        rows = part.agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), (F.max("log_prob") + more).alias("log_prob")).drop("row")
    return rows.withColumn("mean_log_prob", F.try_divide("log_prob", "n_tokens"))
