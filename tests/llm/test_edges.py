"""Odd tables for every operator with a model or tokenizer, and models against brute force."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from millrace.llm import lm_scoring
from millrace.llm.html_extraction import extracted
from millrace.llm.language_id import LanguageId, fit
from millrace.llm.packing import packed
from millrace.llm.textcore import buffer_of, words
from millrace.llm.token_counts import token_counts
from millrace.llm.token_files import token_files
from tests.conftest import SMALL
from tests.llm.test_model_operators import crc, library

CLASHING = "doc_id long, text string, start string, length boolean, n_tokens int, score string, lang_pred int, held_out string, log_prob string, sequence_id string, n_bytes string, lang string"
LONG = "the house of the people and the cat " * 40_000


def odd(spark):
    """Repeated rows, one text under several ids, null and empty texts, a very long one, and columns named like the results."""
    rows = [(1, "the cat and the dog"), (1, "the cat and the dog"), (1, "the cat and the dog"), (2, "the cat and the dog"), (3, None), (4, ""), (5, LONG), (6, "12 ..")]
    return spark.createDataFrame([(*r, "x", True, 7, "s", 9, "h", "l", "q", "b", "en") for r in rows], CLASHING).repartition(3)


def models(docs):
    """The operators, each as a function of a table."""
    return {
        "language ID": lambda df: fit(docs).identify(df),
        "token files": token_files,
        "packing": lambda df: packed(df, group_docs=2),
        "token counts": token_counts,
        "LM scoring": lambda df: lm_scoring.scored(df, lm_scoring.train(docs, rounds=1)),
    }


@pytest.mark.parametrize("name", ["language ID", "token files", "packing", "token counts", "LM scoring"])
def test_empty_and_odd_tables(spark, name):
    docs = odd(spark)
    run = models(docs)[name]
    none = run(docs.filter("false"))
    found = run(docs)
    assert none.count() == 0 and none.schema.names == found.schema.names and len(set(found.columns)) == len(found.columns)
    rows = found.collect()
    if name != "packing":
        assert Counter(r.doc_id for r in rows) == {1: 3, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    by = {r.doc_id: r for r in rows}
    if name == "language ID":
        assert {d for d, r in by.items() if r.lang_pred == "und"} == {3, 4, 6} and len({(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2)}) == 1
    elif name == "token files":
        assert by[3].n_tokens == by[4].n_tokens == 1 and by[5].n_tokens == len(library([LONG])[0]) + 1
    elif name == "token counts":
        assert by[3].n_tokens == by[4].n_tokens == 0 and by[5].n_tokens == len(library([LONG])[0]) and by[5].over_limit
    elif name == "LM scoring":
        assert by[3].n_tokens == 0 and by[5].n_tokens == len(LONG.split()) and len({round(r.log_prob, 6) for r in rows if r.doc_id in (1, 2)}) == 1
    else:
        size = {1: 3 * (len(library(["the cat and the dog"])[0]) + 1), 3: 1, 4: 1, 5: len(library([LONG])[0]) + 1}
        assert all(sum(r.length for r in rows if r.doc_id == d) == n for d, n in size.items())


def test_pages_that_repeat_or_are_empty_or_long(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title of it</h1><p>" + "A long sentence about the river and its towns. " * 20 + "</p></article></body></html>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, "v", None, "x"), (3, None, "", "x"), (4, "w", page.replace("</article>", "<p>" + "More words on rivers. " * 100_000 + "</p></article>"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in extracted(df).collect()]
    assert sorted(p for p, *_ in got) == [1, 1, 2, 3, 4] and len({t for p, t, _ in got if p == 1}) == 1
    assert all(n == len(t) for _, t, n in got) and {t for p, t, _ in got if p in (2, 3)} == {""}
    assert next(n for p, _, n in got if p == 4) > 2_000_000 and extracted(df.filter("false")).count() == 0


def test_language_id_is_the_smallest_encoding(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    m = fit(docs)
    frames = {k: zstandard.ZstdCompressor(level=m.level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for k, d in m.dictionaries.items()}
    found = {r.doc_id: r for r in m.identify(docs).collect()}
    tested = 0
    for r in docs.collect():
        raw = re.sub(r"[\W\d_]+", " ", (r.text or "").lower()).strip().encode()
        if len(raw) <= m.short:
            continue
        n = -(-len(raw) // m.block)
        step = -(-len(raw) // n)
        sizes = {k: sum(len(e.compress(raw[a : a + step])) for a in range(0, len(raw), step)) for k, e in frames.items()}
        least, second = sorted(sizes.values())[:2]
        own = found[r.doc_id]
        assert sizes[own.lang_pred] == least and own.margin == pytest.approx((second - least) / least) and own.rejected == (own.margin < m.min_margin)
        tested += 1
    assert tested > 100


def test_language_id_ties_are_rejected(spark):
    m = LanguageId({"often": b"the house of the people", "seldom": b"the house of the people"})
    df = spark.createDataFrame([(1, "the people of the house " * 60)], "doc_id long, text string")
    row = m.identify(df).first()
    assert (row.lang_pred, row.margin, row.rejected) == ("often", 0.0, True) and m.accepted(df).count() == 0


def test_lm_scores_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower)) for r in docs.collect()}
    counts = Counter(w for t in texts.values() for w in t)
    scorer = lm_scoring.train(docs)
    hashes = dict(zip(counts, map(int, words(*buffer_of(pa.array([" ".join(counts)])), lower=True).hashes), strict=True))
    others = lm_scoring._buckets(scorer.size)
    frequent = {int(h): k for k, h in enumerate(scorer.vocabulary[: scorer.size - others - 1])}
    assert sorted((counts[w] for w in counts if hashes[w] in frequent), reverse=True) == sorted(counts.values(), reverse=True)[: len(frequent)]
    ids = {w: frequent[h] + 1 if (h := hashes[w]) in frequent else scorer.size - others + h % others for w in counts}
    in_bucket = Counter()
    for w, n in counts.items():
        in_bucket[ids[w]] += n
    w = {k: np.asarray(v, dtype=np.float64) for k, v in scorer.weights.items()}
    side = w["to_word"].shape[0]
    found = {r.doc_id: r for r in lm_scoring.scored(docs, scorer).collect()}
    for d in sorted(texts, key=lambda d: (len(texts[d]), d))[::25]:
        row, total = [0, 0, *(ids[x] for x in texts[d]), 0, 0], 0.0
        for p, x in enumerate(texts[d], 2):
            h = np.tanh(w["bias"] + sum(w["seen"][k][row[p + o]] for k, o in enumerate(lm_scoring.OFFSETS)))
            c, own = divmod(row[p], side)
            a, b = h @ w["to_class"] + w["class_bias"], w["to_word"][c] @ h + w["word_bias"][c]
            total += a[c] - np.log(np.exp(a).sum()) + b[own] - np.log(np.exp(b).sum())
            if row[p] >= scorer.size - others:
                total += np.log(counts[x] / (in_bucket[row[p]] + 1))
        assert found[d].n_tokens == len(texts[d]) and found[d].log_prob == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_pieces_of_the_pipeline_are_the_librarys_ids(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    own = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        own.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    wanted = dict(zip(own, library([texts[d] for d in own]), strict=True))
    for d, parts in own.items():
        ids, at = [*wanted[d], 1], 0
        for start, length, digest in sorted(parts):
            assert start == at and digest == crc(ids[start : start + length])
            at += length
        assert at == len(ids)
