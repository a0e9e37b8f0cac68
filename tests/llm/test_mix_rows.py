"""The mix stage takes what the cube method says, and leaves most texts where they are."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from wordloom.llm import mixing


def nodes(plan):
    yield plan
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def texts_shuffled(df):
    """Rows with a text that the exchanges of a plan, once run, have written."""
    found = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "ShuffleExchangeExec" and "text#" in n.output().toString()]
    return sum(n.metrics().apply("shuffleRecordsWritten").value() for n in found)


def rows(n):
    rng = random.Random(3)
    made = []
    for i in range(n):
        text = " ".join(rng.choices("abcde", k=rng.randrange(0, 30)))
        made.append((i, text, "en", rng.choice(["a", "b", "c", "d", None]), len(text)))
    made += [(None, f"no id {i % 5}", "en", "a", 7) for i in range(20)] + [(5, "twin", "en", "b", 4)] * 5 + [(6, None, "en", "b", None)]
    return made


@pytest.mark.parametrize("most", [mixing.MOST_SLOTS, 1])
def test_mix_leaves_texts_where_they_are(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_SLOTS", most)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = rows(4000)
        spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
        want = Counter()
        for r in mixing.mix_sources(docs).collect():
            want[r["doc_id"], r["source"], r["size"]] += r["copies"]
        out = corpus_pipeline.mix(spark, docs, "")
        taken = [tuple(r) for r in out.collect()]
        assert Counter((r[0], r[3], len((r[1] or "").split())) for r in taken) == +want
        assert set(taken) <= set(made)
        assert {n for r, n in Counter(taken).items() if made.count(r) == 1} <= {1, 2}
        # With one slot for all rows every text goes the exact way; else few do.
        assert texts_shuffled(out) >= len(made) if most == 1 else 0 < texts_shuffled(out) < 0.35 * len(made)
        assert sorted(map(repr, taken)) == sorted(repr(tuple(r)) for r in corpus_pipeline.mix(spark, docs, "").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
