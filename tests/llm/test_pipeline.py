"""The pipeline against the same decisions made one document at a time."""

import collections
import os

import pytest

import corpus_pipeline
from jobscope.llm import packing, pii, toxicity
from jobscope.llm.words import shingles, words

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_pipeline(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    kept = {r["doc_id"]: r["text"] for r in docs.collect() if model.score(toxicity.word_ids(r["text"])) < 0.5}
    sets = {i: set(shingles(words(t)).tolist()) for i, t in kept.items()}
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(kept):
        for j in sorted(kept):
            if j < i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    items = [set(shingles(words(r["text"])).tolist()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {i: t for i, t in kept.items() if find(i) == i and not any(q and len(q & sets[i]) >= 0.8 * len(q) for q in items)}
    want = {}
    for i, t in left.items():
        for k, (s, n) in enumerate(packing.cut_points(len(packing.encode(pii.pseudonymized(t, pii.DEFAULT_KEY)[0])) + 1, 1024)):
            want[i, k] = (s, n)
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, and empty tables, stage by stage."""
    item = " ".join(f"item{i}" for i in range(20))
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, root string, score double, u string"
    more = ("i", "r", None, 0.5, "u")
    long = " ".join(f"w{i % 991}x{i % 17}" for i in range(30_000))
    texts = [None, "", "...", "...", long, item, "see a.b@x.org and password=deadbeef", "see a.b@x.org and password=deadbeef", "one two", "nasty words here"]
    rows = [(i, t, None, None, len(t or ""), *more) for i, t in enumerate(texts)] + [(6, texts[6], None, None, None, *more), (None, None, None, None, None, None, None, None, None, None), (None, "a text of its own", "en", "s", 1, *more)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 1, int(i == 9)) for i in range(10)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        if name != "packing":
            assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        if name == "packing":
            assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
            continue
        assert docs.columns == before.columns
        kept = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
        assert docs.filter("text is null").count() == 2
        if name == "near_duplicates":
            assert kept[6, texts[6]] == 1 and kept[7, texts[6]] == 0 and kept[2, "..."] == 1 and kept[3, "..."] == 0 and kept[None, "a text of its own"] == 1 and kept[4, long] == 1
        if name == "decontamination":
            assert kept[5, item] == 0 and kept[8, "one two"] == 1 and docs.count() == before.count() - 1
        if name == "personal_data":
            assert docs.count() == before.count() and not any(t and ("a.b@" in t or "deadbeef" in t) for _, t in kept)
