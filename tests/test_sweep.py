"""Interval joins and nearest spans against brute force, on few and on very many spans of a document."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanforge.operators import match, sweep

S = "doc_id long, start long, end long, type string, tag string"


def rows(rng, n, docs, reach, longest, tag):
    out = []
    for k in range(n):
        s = rng.randint(0, reach)
        out.append((rng.choice(docs), s, s + rng.choice([0, 1, 2, rng.randint(0, longest)]), rng.choice("ab"), f"{tag}{k}"))
    return out


@pytest.mark.parametrize("stretch, pairs", [(1 << 16, 1 << 16), (4, 3), (7, 1)])
def test_overlap_join(spark, monkeypatch, stretch, pairs):
    monkeypatch.setattr(sweep, "STRETCH", stretch)
    monkeypatch.setattr(sweep, "PAIRS", pairs)
    rng = random.Random(stretch)
    left, right = (rows(rng, 150, [1, 2, None], 40, 30, t) for t in "lr")
    for touching in (False, True):
        got = sweep.overlap_join(spark.createDataFrame(left, S), spark.createDataFrame(right, S), ["doc_id", "type"], touching)
        assert got.columns == ["doc_id", "type", *(f"{x}_{c}" for x in "lr" for c in ("start", "end", "tag"))]
        want = sorted((x[0], x[3], x[4], y[4]) for x in left for y in right if x[0] and x[0] == y[0] and x[3] == y[3] and (max(x[1], y[1]) <= min(x[2], y[2]) if touching else max(x[1], y[1]) < min(x[2], y[2])))
        assert sorted((r["doc_id"], r["type"], r["l_tag"], r["r_tag"]) for r in got.collect()) == want
    none = spark.createDataFrame([], S)
    assert sweep.overlap_join(none, spark.createDataFrame(right, S), ["doc_id"]).count() == 0


def test_small_arrow_batches(spark):
    """The open spans go on from batch to batch."""
    rng = random.Random(8)
    left, right = (rows(rng, 300, [1], 500, 400, t) for t in "lr")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r["l_tag"], r["r_tag"]) for r in sweep.overlap_join(spark.createDataFrame(left, S), spark.createDataFrame(right, S), ["doc_id"]).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted((x[4], y[4]) for x in left for y in right if max(x[1], y[1]) < min(x[2], y[2]))


def test_nearest_spans():
    rng = random.Random(1)
    for _ in range(400):
        spans = [(s, s + rng.randint(0, 9)) for s in (rng.randint(0, 30) for _ in range(rng.randint(1, 12)))]
        queries = [(s, s + rng.randint(0, 9)) for s in (rng.randint(0, 30) for _ in range(rng.randint(0, 12)))]
        want = [min((abs(s - a) + abs(e - b), a, b) for a, b in spans) for s, e in queries]
        assert sweep.nearest_spans(queries, spans) == want


def test_twenty_thousand_spans_in_a_document(spark):
    """One document with 20,000 spans a side: overlaps, containment, nearest and matching stay
    far from all pairs (400 million)."""
    rng = random.Random(6)
    gold = [(1, s, s + rng.randint(1, 12), "t", "g") for s in rng.sample(range(400_000), 20_000)]
    pred = [(1, s, s + rng.randint(1, 12), "t", "p") for s in rng.sample(range(400_000), 20_000)] + [(1, 900_000 + k, 900_004 + k, "t", "far") for k in range(200)]
    g, p = spark.createDataFrame(gold, S).persist(), spark.createDataFrame(pred, S).persist()
    at = [[] for _ in range(401_000)]
    for _, s, e, *_ in gold:
        for x in range(s, e):
            at[x].append((s, e))
    want = sum(len({q for x in range(s, e) for q in at[x]}) for _, s, e, _, tag in pred if tag == "p")
    began = time.time()
    assert match.overlap_pairs(g, p).count() == want
    inside = match.contained(g, p.withColumn("k", F.col("start")), ["k"]).agg(F.sum("n")).first()[0]
    assert inside == sum(sum(a >= s and b <= e for a, b in {q for x in range(s, min(e, 401_000)) for q in at[x]}) for _, s, e, *_ in pred)
    near = {(r["start"], r["end"]): (r["cost"], r["g_start"], r["g_end"]) for r in match.nearest(p, g).collect()}
    ordered = sorted((s, e) for _, s, e, *_ in gold)
    for _, s, e, *_ in rng.sample(pred, 300):
        assert near[s, e] == min((abs(s - a) + abs(e - b), a, b) for a, b in ordered)
    n = match.matched_counts(g, p, threshold=0.5).first()["matched"]
    assert 0 < n < 20_000 and time.time() - began < 120
    for plan in (match.overlap_pairs(g, p), match.nearest(p, g), match.contained(g, p.withColumn("k", F.col("start")), ["k"])):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner" not in text and "Join Cross" not in text


def test_crowded_islands():
    """Long chains of spans that touch: matched without recursion and without a pass a span."""
    chain = [(k, k + 2) for k in range(0, 60_000, 2)]
    shifted = [(k + 1, k + 3) for k in range(0, 60_000, 2)]
    assert match._sweep(chain, shifted) == 30_000
    long = [(k, k + 10) for k in range(0, 30_000, 5)]
    assert match._augment(long[:-1], [(s + 5, e + 5) for s, e in long[:-1]], 1 / 3) == len(long) - 1
