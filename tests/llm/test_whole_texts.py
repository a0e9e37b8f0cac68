"""Nothing is cut from what the models learn from or look at."""

from wordloom.llm.langid import training_rows


def test_long_texts_teach_whole(spark):
    text = "plain words here " * 6000 + "between the stretches " + "and plain words again " * 6000
    df = spark.createDataFrame([(1, "en", text), (2, "en", "short")], "doc_id long, lang string, text string")
    assert sorted(training_rows(df, "lang", 500), key=str) == sorted([("en", text), ("en", "short")], key=str)


def test_packing_ends_in_one_exchange(spark, monkeypatch):
    import numpy as np
    import public_tokenizers

    from wordloom.llm import packing

    monkeypatch.setattr(packing, "PIECES", 100)
    sizes = np.random.default_rng(5).integers(9, 11, 600).tolist()
    df = spark.createDataFrame([(i, " ".join(["a"] * n)) for i, n in enumerate(sizes)], "doc_id long, text string")
    out = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), capacity=64).toPandas()
    assert sorted(out["doc_id"]) == list(range(600))
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 64
    last = out["sequence_id"] // (1 << 56)
    assert last.max() > 0 and set(out["sequence_id"][last == last.max()] // (1 << 24) % (1 << 32)) == {0}
