"""The pipeline against a brute-force version of its stages."""

from pyspark.sql.functions import lit

import corpus_pipeline
from millrace.llm.language_id import fit
from tests.conftest import SMALL
from tests.llm.test_text_operators import brute_groups, brute_hits


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = fit(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [(d, t) for d, t in rows if (p := model.predict(t))[0] != "und" and p[2] >= model.min_margin]
    last = {t: d for d, t in sorted(kept)}
    kept = [(d, t) for d, t in kept if last[t] == d]
    groups = brute_groups(kept, 5, 80)
    kept = [(d, t) for d, t in kept if groups[d][1] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hits = brute_hits(kept, items)
    kept = {d for d, _ in kept if not hits[d][1]}
    pieces = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).schema.names == docs.schema.names


def odd_documents(spark, rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "CAST(NULL AS string) AS source", "CAST(NULL AS long) AS n_chars")
    extra = extra.select(*(extra[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
    return docs.unionByName(extra).withColumns({"keep_id": lit(7), "n": lit("x"), "component_id": lit(True), "kept": lit(1.5)})


def test_stages_on_odd_rows(spark):
    long = " ".join(f"the cat and the house {k}" for k in range(40_000))
    rows = [(None, None), (None, "a text of the house and the cat"), (None, "a text of the house and the cat"), (10**6, ""), (10**6 + 1, None), (10**6 + 2, "one"), (10**6 + 3, long), (10**6 + 4, long), (10**6 + 5, "same row"), (10**6 + 5, "same row"), (10**6 + 6, "12 34")]
    docs = odd_documents(spark, rows)
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert stage(spark, docs.filter("false"), SMALL).count() == 0
        if name != "packing":
            assert out.schema.names == docs.schema.names
        got[name] = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.select("doc_id").distinct().collect() if r.doc_id is None or r.doc_id >= 10**6)
        if name == "exact dedup":
            assert out.filter("doc_id IS NULL").count() == 1 and out.filter(f"doc_id = {10**6 + 5}").count() == 1
    assert not {10**6, 10**6 + 1, 10**6 + 6} & set(got["language ID"]) and 10**6 + 3 in got["language ID"]
    assert got["exact dedup"] == [-1, *(10**6 + k for k in (1, 2, 4, 5, 6))]
    assert got["n-gram Jaccard join"] == [-1, *(10**6 + k for k in (0, 1, 2, 3, 5, 6))]
    assert got["benchmark decontamination"] == got["packing"] == [-1, *(10**6 + k for k in range(7))]
