"""Operators on tokens and models."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import lm_scoring
from millrace.llm.boosting import boost
from millrace.llm.bpe import default_path, word_bpe
from millrace.llm.elias_fano import EliasFano, Shard, pack_shard
from millrace.llm.html_extraction import blocks, extracted, model
from millrace.llm.language_id import LanguageId, fit
from millrace.llm.packing import pack, packed
from millrace.llm.page_maker import PageMaker
from millrace.llm.token_counts import token_counts
from millrace.llm.token_files import token_files, write_tokens

ODD = [None, "", " ", "he'll don't 'sun ''s", "<|endoftext|> a", "中文 é ÀB", "a" * 3000, "'s's", "x\x00y", "9'd½ ª", "tab\tand\nline"]


def frame(spark, texts=ODD):
    return spark.createDataFrame([(k * 2, t, "x", 7) for k, t in enumerate(texts)], "doc_id long, text string, start string, n_tokens int").repartition(3)


def library(texts):
    return [e.ids for e in word_bpe(default_path()).library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abzAZ09 \n\t'’!.é É×÷ÀßñÑ¿ª²½µ<|>\x85\xa0\x1cstremvld中", max_size=30), min_size=1, max_size=5))
def test_ids_are_the_librarys(texts):
    import pyarrow as pa

    from millrace.llm.textcore import buffer_of

    ids, at = word_bpe(default_path()).encode(*buffer_of(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library(texts)
    assert word_bpe(default_path()).counts(*buffer_of(pa.array(texts)))[0].tolist() == [len(x) for x in library(texts)]


def test_words_beyond_latin_leave_the_rest_to_the_shortcut():
    import pyarrow as pa

    from millrace.llm.textcore import buffer_of

    texts = ["the house of the people is “here” and  the <|endoftext|> end\u3000 of it", "", "the 中 of"]
    tokens, short = word_bpe(default_path()).counts(*buffer_of(pa.array(texts)))
    assert tokens.tolist() == [len(x) for x in library(texts)] and short[0] >= 8 and short[2] >= 1


def test_token_counts(spark):
    texts = [*ODD, "long words " * 100_000]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(spark, texts)).collect()}
    assert got == {k * 2: (len((t or "").encode()), len(e), len(e) > 2048) for k, (t, e) in enumerate(zip(texts, library(texts), strict=True))}


def test_token_files(spark):
    got = sorted(map(tuple, token_files(frame(spark), shard_tokens=40).collect()))
    at, want = 0, []
    for k, e in enumerate(library(ODD)):
        want.append((k * 2, at, len(e) + 1, crc([*e, 2])))
        at += len(e) + 1
    assert got == want


def test_token_files_with_null_and_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (5, "b"), (5, "b"), (-7, "c d")], "doc_id long, text string")
    rows = token_files(df).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, -7, 5, 5]
    files = write_tokens(df, f"file://{tmp_path}/t")
    shard = Shard(open(files[0][2].removeprefix("file://"), "rb").read())
    assert shard.doc_id(0) is None and sum(f[3] for f in files) == 4 and len(shard.tokens(0)) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(1, 1 << 40))
def test_elias_fano(steps, first):
    values = np.cumsum([first, *steps]).astype(np.int64)
    back, _ = EliasFano.read(b"junk" + EliasFano.of(values).tobytes(), 4)
    assert back.values().tolist() == values.tolist() == [back.select(i) for i in range(len(values))]
    a = len(values) // 3
    assert back.values(a, len(values) - a // 2).tolist() == values[a : len(values) - a // 2].tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2500, 20_000))
    assert len(EliasFano.of(values).tobytes()) * 8 / len(values) < 2 + np.log2(2500) + 1.5
    assert Shard(pack_shard(np.array([3, 9]), 1, np.array([0, 1, 1, 4]), np.array([70_000, 1, 2, 3]))).tokens(2).tolist() == [1, 2, 3]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60), st.sampled_from([64, 2048]))
def test_packing(lengths, capacity):
    seen = [set() for _ in lengths]
    for own in pack(lengths, capacity):
        total = sum(n for _, _, n in own)
        assert 0 < total <= capacity and (total == capacity or total & (total - 1) == 0)
        for d, s, n in own:
            new = set(range(s, s + n))
            assert not new & seen[d]
            seen[d] |= new
    assert [len(s) for s in seen] == lengths


def test_packed(spark):
    texts = [*ODD, "some more words " * 2000]
    pieces, want = packed(frame(spark, texts), group_docs=4).collect(), {k * 2: [*e, 1] for k, e in enumerate(library(texts))}
    for d, ids in want.items():
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces if r.doc_id == d)
        assert [s for s, *_ in own] == [sum(n for _, n, *_ in own[:k]) for k in range(len(own))] and sum(n for _, n, *_ in own) == len(ids)
        assert all(c == crc(ids[s : s + n]) and t == len(ids) for s, n, c, t in own)
    for q in {r.sequence_id for r in pieces}:
        own = sorted((r.offset, r.length) for r in pieces if r.sequence_id == q)
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = fit(docs).identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found[found.held_out].lang == found[found.held_out].lang_pred).mean() > 0.98
    assert found.rejected.mean() < 0.01 and found.score.between(0, 1).all()


def test_language_id_edges(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "12 %", "en"), (None, "the cat and the dog", "en"), (4, "le chat et le chien", "fr"), (5, "x", None), (6, "the of and to in", "en"), (7, "le la les des et", "fr")], "doc_id long, text string, lang string")
    m = fit(df)
    got = {r.doc_id: r for r in m.identify(df).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].rejected and got[1].score == 0
    assert set(m.dictionaries) <= {"en", "fr"} and got[None].held_out is False
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items() if d is not None)
    assert m.accepted(df).columns == df.columns and m.accepted(df).filter("text IS NULL").count() == 0
    assert LanguageId({}).predict("words") == ("und", 0.0, 0.0)
    assert fit(df.filter("false")).identify(df.filter("false")).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lm_scoring._initial(rng.integers(1, 50, lm_scoring.VOCABULARY).astype(float)).items()}
    around, target = rng.integers(0, lm_scoring.VOCABULARY, (4, 40)), rng.integers(0, lm_scoring.VOCABULARY, 40)
    grads = lm_scoring.network(w, around, target, True)[1]
    seen = np.zeros_like(w["seen"])
    for k, (ids, rows) in enumerate(grads["seen"]):
        seen[k][ids] = rows
    grads["seen"] = seen
    c, o = divmod(int(target[0]), lm_scoring.CLASS_SIZE)
    for k, i in (("seen", (2, int(around[2][3]), 5)), ("bias", (4,)), ("to_class", (3, c)), ("class_bias", (c,)), ("to_word", (c, o, 2)), ("word_bias", (c, o))):
        step = []
        for e in (1e-3, -1e-3):
            w[k][i] += e
            step.append(lm_scoring.network(w, around, target, False)[0].astype(float).mean())
            w[k][i] -= e
        assert grads[k][i] == pytest.approx((step[1] - step[0]) / 2e-3, rel=2e-2, abs=2e-5)


def test_lm_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scorer = lm_scoring.train(docs.repartition(20))
    rows = {r.doc_id: r for r in lm_scoring.scored(docs, scorer).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and all(r.n_tokens == len(texts[d].split()) for d, r in rows.items())
    plain = lm_scoring.train(docs, rounds=0)
    assert sum(r.log_prob for r in rows.values()) > sum(r.log_prob for r in lm_scoring.scored(docs, plain).collect())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "the")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.scored(odd, scorer).collect()}
    assert (got[1].n_tokens, got[1].log_prob, got[1].mean_log_prob) == (0, 0.0, None) and got[3].n_tokens == 1 and got[3].log_prob < 0
    assert lm_scoring.scored(odd.filter("false"), lm_scoring.train(odd.filter("false"))).count() == 0


def test_lm_score_is_the_sum_of_its_positions():
    import pyarrow as pa

    from millrace.llm.textcore import buffer_of

    rng = np.random.default_rng(3)
    weights = lm_scoring._initial(rng.integers(1, 50, lm_scoring.VOCABULARY).astype(float))
    scorer = lm_scoring.Scorer(np.empty(0, dtype=np.uint64), weights)
    data = buffer_of(pa.array(["one two three", "four five"]))
    row, where, _ = scorer.positions(*data)
    total = sum(lm_scoring.network(weights, np.array([[row[p + o]] for o in lm_scoring.OFFSETS]), row[[p]], False)[0][0] for p in where[:3])
    assert scorer.log_probabilities(*data)[0][0] == pytest.approx(float(total), rel=1e-5)


def test_lm_rare_words_have_their_own_probability(spark, monkeypatch):
    words = [(f"w{k}", 1 + k % 7) for k in range(4000)]
    docs = spark.createDataFrame([(k, " ".join([w] * n)) for k, (w, n) in enumerate(words)], "doc_id long, text string").repartition(3)
    alone = spark.createDataFrame([(k, w) for k, (w, _) in enumerate(words)], "doc_id long, text string")
    found = []
    for counted in (1 << 16, 2000):
        monkeypatch.setattr(lm_scoring, "COUNTED", counted)
        scorer = lm_scoring.train(docs, rounds=0)
        assert (len(scorer.vocabulary) == 4000) == (counted > 4000)
        found.append({r.doc_id: r.log_prob for r in lm_scoring.scored(alone, scorer).collect()})
    assert 0.98 < sum(np.exp(list(found[1].values()))) <= 1.0 + 1e-6
    assert all(found[0][k] == pytest.approx(found[1][k], rel=1e-6) for k in found[0])
    assert sum(found[1][k] for k in range(6, 4000, 7)) > sum(found[1][k] for k in range(0, 4000, 7)) 


def test_lm_vocabulary_grows(spark):
    docs = spark.range(20).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 299999), x -> concat('w', x % 3000)), ' ') AS text")
    scorer = lm_scoring.train(docs, rounds=0)
    assert scorer.size == round(lm_scoring.GROWTH * 6_000_000**0.25) ** 2 > lm_scoring.VOCABULARY


def test_boosting_learns_an_interaction():
    x = np.random.default_rng(1).random((2000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    assert ((boost(x, y, trees=30).logits(x) > 0) == y).mean() > 0.95


def main_text(page):
    import html

    parts = re.findall("\x02(.*?)\x03", page, re.S)
    return [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]


def test_extraction_of_unseen_made_up_pages():
    maker, good = PageMaker(123), 0
    for _ in range(120):
        page = maker.page()
        good += blocks(re.sub("[\x02\x03]", "", page), model()) == main_text(page)
    assert good >= 108


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>More</a></li></ul></nav><article><h1>Title &amp; co</h1><p>First   line<br>goes on here, with some words.<p>Second one is long enough to read.</article><footer>&copy; site</footer>", "Title & co\n\nFirst line goes on here, with some words.\n\nSecond one is long enough to read."),
        ("<article><p>Only words here, and a few more of them.</p><script>var x = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --></article>", "Only words here, and a few more of them."),
    ],
)
def test_extraction_edges(spark, page, text):
    df = spark.createDataFrame([(1, "u", page, "x")], "page_id long, url string, html string, text string")
    row = extracted(df).first()
    assert (row.page_id, row.url, row.text, row.n_chars) == (1, "u", text, len(text))


@pytest.mark.parametrize(
    ("before", "inside", "kept"),
    [
        ("<html><head><title>T</title><meta charset=x>", "", ""),
        ("<html><head><title>T</title></head><body>", "<button>Share", "Share"),
        ("<html><head><title>T</title></head><body>", "<object data=x><param name=a>", ""),
        ("<html><head><title>T</title></head><body>", "<button>Share <div>it</div></button>", ""),
        ("<html><head><title>T</title></head><body>", "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>", "x=2"),
    ],
)
def test_extraction_with_optional_and_missing_end_tags(before, inside, kept):
    first, second = "The first line goes on here, with some words.", "Second one is long enough to read, and it has a few more words."
    page = f"{before}<article><h1>Title</h1><p>{first} {inside}</p><p>{second}</p></article><footer>site</footer>"
    want = ["Title", first, kept, second] if "<button>" in inside and kept else ["Title", f"{first} {kept}".strip(), second]
    assert blocks(page, model()) == want


def test_extraction_of_the_pages(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extracted(pages).collect()}
    for r in pages.collect():
        inner = r.html.partition("<article>")[2].partition("</article>")[0]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(b for b in want if b)
    assert extracted(pages.filter("false")).count() == 0


def test_a_deep_page(spark):
    deep = "<div>" * 3000 + "<p>inside, at last.</p>" + "</div>" * 3000 + "<p" * 50
    assert isinstance(blocks(deep, model()), list)
    assert isinstance(blocks("".join(random.Random(2).choice("<>/ap='\" &;!-") for _ in range(20_000)), model()), list)


@pytest.mark.parametrize("scale", [1.0, 200.0])
def test_lm_scores_near_zero_and_far_from_it(monkeypatch, scale):
    rng = np.random.default_rng(5)
    w = lm_scoring._initial(rng.integers(1, 50, lm_scoring.VOCABULARY).astype(float))
    w["to_class"] *= scale
    w["to_word"] *= scale
    around, target = rng.integers(0, lm_scoring.VOCABULARY, (4, 500)), rng.integers(0, lm_scoring.VOCABULARY, 500)
    plain = {k: v.astype(np.float64) for k, v in w.items()}
    h = np.tanh(plain["bias"] + sum(plain["seen"][k][around[k]] for k in range(4)))
    cls, own = np.divmod(target, lm_scoring.CLASS_SIZE)
    a, b = h @ plain["to_class"] + plain["class_bias"], np.einsum("nw,nsw->ns", h, plain["to_word"][cls]) + plain["word_bias"][cls]
    want = sum(np.maximum(x[np.arange(500), at] - x.max(axis=1) - np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)), np.log(1e-30)) for x, at in ((a, cls), (b, own)))
    found = []
    for near in (75.0, 0.0):
        monkeypatch.setattr(lm_scoring, "NEAR", near)
        log_p, grads = lm_scoring.network(w, around, target, True)
        assert np.allclose(log_p, want, rtol=1e-4, atol=1e-3) and np.allclose(lm_scoring.network(w, around, target, False)[0], want, rtol=1e-4, atol=1e-3)
        assert all(np.isfinite(grads[k]).all() for k in grads if k != "seen")
        found.append(grads)
    assert all(np.allclose(found[0][k], found[1][k], rtol=1e-3, atol=1e-5) for k in found[0] if k != "seen")
