"""The near-duplicate stage of the pipeline against brute-force Jaccard ratios."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from spanforge.llm import common, near_sets


def survivors(texts, threshold=0.8, size=5):
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for i, w in words.items()}
    comp = {i: i for i in texts}
    links = [(i, j) for i in sets for j in sets if i < j and min(len(sets[i]), len(sets[j])) >= threshold * max(len(sets[i]), len(sets[j])) and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9)]
    for _ in texts:
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return {i for i in comp if comp[i] == i}


@pytest.mark.parametrize("hot", [16, 1])
def test_near_stage_reaches_the_ratio(spark, monkeypatch, hot):
    monkeypatch.setattr(near_sets, "HOT", hot)
    monkeypatch.setattr(near_sets, "SAMPLE", 1)
    rng = np.random.default_rng(7)
    rows = {1000: None, 1001: "", 1002: "a b", 1003: "A  b", 1004: "a c"}
    for base in range(8):
        w = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for k in range(9):  # copies with up to four words changed: ratios on both sides of 0.8
            v = list(w)
            for at in rng.choice(len(v), k % 5, replace=False):
                v[at] = f"n{base}-{k}-{at}"
            rows[10 * base + k] = " ".join(v)
    want = survivors(rows)
    assert 8 < len(want) < 60
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows.items()], "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").toPandas()
    assert set(kept["doc_id"]) == want
    assert near_sets.near_duplicates(docs.limit(0)).count() == 0


def test_batches_of_whole_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 16)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    rows = spark.range(400, numPartitions=1).selectExpr("repeat('x', 4000) AS text").mapInArrow(sizes, "n long, size long")
    got = common.materialize(rows, "sizes").toPandas()
    assert got["n"].sum() == 400 and got["size"].max() < 4 << 16  # one batch of 1.6 MB otherwise
    assert spark.conf.get(name) == before
