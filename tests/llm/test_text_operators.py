"""Operators whose results SQL or a brute-force version gives."""

import hashlib
import random
import re

import pytest

from millrace.llm.decontamination import contamination, decontaminated, hit_spans
from millrace.llm.exact_dedup import exact_duplicates, without_exact_duplicates
from millrace.llm.ngram_join import near_duplicate_groups, without_near_duplicates
from millrace.llm.queries import ORACLES, QUERIES
from millrace.llm.substring_dedup import without_repeats
from tests.conftest import SMALL
from tests.helpers import same

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    same(QUERIES[name](spark, SMALL), duck.sql(ORACLES[name]))


def made_texts(seed: int, n: int = 60) -> list[str | None]:
    """Few words, so that shingles and passages recur; copies, near copies, shared passages, empty and null texts."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["É", "The", "x,y"]
    text = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b)))
    out: list[str | None] = [None, "", " \t\n", "one", "One", "two words", "a  b\tc", text(200, 300)]
    passage = text(30, 30)
    while len(out) < n:
        kind = r.random()
        if kind < 0.2:
            out.append(r.choice(out))
        elif kind < 0.5:
            base = (r.choice(out) or text(20, 60)).split(" ")
            base[r.randrange(len(base))] = r.choice(words)
            out.append(" ".join(base))
        elif kind < 0.7:
            out.append(f"{text(3, 30)} {passage} {text(3, 30)}")
        else:
            out.append(text(5, 80))
    return out


def frame(spark, texts, extra=True):
    rows = [(k * 3, t, "clash", 5) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, group_size int").repartition(5)
    return df if extra else df.select("doc_id", "text")


def shingles(text, width):
    w = _WORD.findall((text or "").translate(_LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_groups(docs, width, threshold):
    sets = {d: shingles(t, width) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("width", "threshold", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_near_duplicates(spark, width, threshold, seed):
    texts = made_texts(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_groups(frame(spark, texts), width=width, threshold=threshold).collect()}
    assert got == brute_groups([(k * 3, t) for k, t in enumerate(texts)], width, threshold)


def test_a_group_of_near_copies_without_links_to_its_hub(spark):
    base = [f"t{k}" for k in range(120)]
    texts = []
    for k in range(40):
        own = base.copy()
        for j in range(k % 8):
            own[(k * 7 + j * 11) % 120] = f"u{k}_{j}"
        texts.append(" ".join(own))
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(frame(spark, texts), width=3, threshold=90).collect()}
    assert got == {d: c for d, (_, c) in brute_groups([(k * 3, t) for k, t in enumerate(texts)], 3, 90).items()}


def test_near_duplicates_keep_one_row_and_all_columns(spark):
    df = frame(spark, ["a b c d e f g", "a b c d e f g", None, None, "z"])
    kept = without_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 6, 9, 12]


def brute_repeats(docs, width=13):
    words = {d: _WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for k in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][k : k + width]), d)
    out = {}
    for d, w in words.items():
        gone = {p for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < d for p in range(k, k + width)}
        out[d] = (" ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone))
    return out


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_substring_dedup(spark, seed):
    texts = made_texts(seed)
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in without_repeats(frame(spark, texts)).collect()}
    assert got == brute_repeats([(k * 3, t) for k, t in enumerate(texts)])


def brute_hits(docs, items, window=10):
    listed = [(i, _PLAIN.findall((t or "").translate(_LOWER))) for i, t in items]
    wins = {}
    for i, w in listed:
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, named = _PLAIN.findall((t or "").translate(_LOWER)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    named |= found
        out[d] = (len(w), len(hit), sorted(named))
    return out


def test_contamination(spark):
    texts = made_texts(7, 50) + ["a-b c d e f g h i j k l", "alone", "É" * 3, "x" * 50_000, "k1 k2 k3 " * 4]
    items = [(k, " ".join((texts[-1 - k % 40] or "").split()[:17])) for k in range(12)] + [(20, "alone"), (21, None), (22, "..."), (23, "A-B C d E f g h i J K"), (24, "K1 K2"), (23, "w1 w2 w3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in contamination(df, bench).collect()}
    want = brute_hits([(k * 3, t) for k, t in enumerate(texts)], items)
    assert got == want
    assert {r.doc_id for r in decontaminated(df, bench).collect()} == {d for d, (_, n, _) in want.items() if not n}
    assert {r.doc_id for r in hit_spans(df, bench).collect()} == {d for d, (_, n, _) in want.items() if n}


def test_an_empty_benchmark_leaves_all_clean(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    df = frame(spark, ["a b", None])
    assert [r.contaminated for r in contamination(df, bench).collect()] == [False, False]
    assert decontaminated(df, bench).count() == 2 and hit_spans(df, bench).count() == 0


def test_exact_duplicates(spark):
    texts = made_texts(8)
    docs = {k * 3: t or "" for k, t in enumerate(texts)}
    df = frame(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in exact_duplicates(df, with_digest=True).collect()}
    for d, t in docs.items():
        group = [x for x, y in docs.items() if y == t]
        assert got[d] == (max(group), len(group), d == max(group), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in exact_duplicates(df).collect()} == {d: v[:3] for d, v in got.items()}
    kept = without_exact_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, v in got.items() if v[2]}


def test_one_id_with_two_texts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id long, text string")
    assert sorted(map(tuple, without_exact_duplicates(df).collect())) == [(1, "b"), (2, "a")]


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df).collect()) == [(0, 1, 4, False), (0, 1, 4, False), (1, 1, 4, True), (1, 1, 4, True), (2, 2, 1, True)]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicate_groups(df).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 2)]
    assert without_repeats(df).count() == 5 and contamination(df, df.select(df.doc_id.alias("item_id"), "text")).count() == 5


def test_empty_tables(spark):
    none = frame(spark, ["x"]).filter("false")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for df in (near_duplicate_groups(none), without_near_duplicates(none), without_repeats(none), contamination(none, bench), decontaminated(none, bench), exact_duplicates(none), without_exact_duplicates(none)):
        assert df.count() == 0


def test_a_very_long_text(spark):
    r = random.Random(1)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(3000)) for _ in range(300_000)) + " " + "q" * 300_000
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "short text here")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicate_groups(df).select("doc_id", "component_id").collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.n_removed for r in without_repeats(df).collect()} == {1: 0, 2: 300_001, 3: 0}
    bench = spark.createDataFrame([(1, " ".join(long.split()[1000:1012]))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in contamination(df, bench).collect()} == {1: 12, 2: 12, 3: 0}
