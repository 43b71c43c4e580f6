"""The whole pipeline on a small table, against what each stage promises."""

import corpus_pipeline
from quire.operators.skew import cut_lineage


def test_stages_follow_each_other_and_take_effect(spark, tmp_path):
    def words(tag, n):
        return " ".join(f"{tag}{i}" for i in range(n))

    shared = words("common", 60)
    secret = "token = \"0123456789abcdef0123456789abcdef01234567\""
    rows = [
        (0, words("a", 200), "en", "s0", 0), (1, words("a", 199) + " end", "en", "s0", 0),
        (2, "too short", "en", "s1", 9), (3, None, None, None, None),
        (4, words("b", 70) + " " + shared + " " + words("c", 50), "en", "s1", 0),
        (5, words("d", 90) + " " + shared + " " + words("e", 80), "en", "s2", 0),
        (6, words("f", 80) + " " + secret + " " + words("g", 30), "en", "s2", 0)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = cut_lineage(stage(spark, docs, "unused"), "t")
        if name != "packing":
            assert out.columns == docs.columns
        seen[name] = {r["doc_id"]: r for r in out.collect()}
        docs = out
    assert set(seen["quality rules"]) == {0, 1, 4, 5, 6}
    assert set(seen["near duplicates"]) == {0, 4, 5, 6}
    texts = {i: r["text"] for i, r in seen["repeated strings"].items()}
    assert "common30" not in texts[4] and "common30" not in texts[5]
    assert texts[0] == rows[0][1] and "b0 " in texts[4] and "c49" in texts[4]
    assert all(len(r["text"]) == r["n_chars"] for i, r in seen["secret scan"].items() if i in (4, 5, 6))
    assert "[SECRET]" in seen["secret scan"][6]["text"] and "0123456789" not in seen["secret scan"][6]["text"]
    assert seen["secret scan"][0]["text"] == rows[0][1]
    assert {i: r["n_tokens"] for i, r in seen["packing"].items()} == {
        i: len(r["text"].split()) for i, r in seen["secret scan"].items()}


def test_an_empty_table_goes_through(spark):
    docs = spark.createDataFrame(
        [], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, "unused"), "t")
    assert docs.count() == 0
