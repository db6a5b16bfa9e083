"""Reduction and search of older outputs: phrases by one pattern, no surface reduced or sought twice in one step."""

import random

from pyspark.sql import functions as F

from spanforge.operators import legacy


def test_listed_phrase(spark):
    rng = random.Random(2)
    phrases = ["a.b", "ab", "abc", "b+", "c a", "(x"]
    texts = ["".join(rng.choices("aAbBc.+ (x", k=rng.randint(0, 12))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", legacy.listed_phrase(F.col("t"), phrases).alias("p"), legacy.listed_phrase(F.col("t"), []).alias("none")).collect()
    for r in got:
        at = [(r["t"].lower().find(p), -len(p)) for p in phrases if p in r["t"].lower()]
        want = None if not at else r["t"][min(at)[0] : min(at)[0] - min(at)[1]]
        assert r["p"] == want and r["none"] is None


def test_surfaces_are_reduced_once(spark):
    rows = spark.createDataFrame([(1, "Weakness", "an sql injection flaw")], "doc_id int, type string, surface string")
    plan = legacy.with_core(rows)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("CASE" in line for line in filters), "a filter must not reduce surfaces of its own"


def test_second_search_is_of_what_was_reduced_again(spark):
    text = "Alpha flaw. an alpha Server and Beta package 1.2, Beta 1.2 ALPHA"
    rows = [(1, "a", 40, 45, "Weakness", "ALPHA flaw."), (1, "b", 0, 1, "Configuration", "the Beta package 1.2"), (1, "c", 0, 1, "Weakness", "gamma"), (1, "d", 3, 9, "Weakness", "Alpha"), (2, "a", 0, 1, "Weakness", "x"), (3, "a", 0, 1, "Weakness", "y"), (None, "n", 0, 1, "Weakness", "x")]
    m = spark.createDataFrame(rows, "doc_id int, id string, start int, end int, type string, surface string")
    rel = spark.createDataFrame([], "doc_id int, id string, type string, head string, tail string")
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    sig = spark.createDataFrame([], "type string, head_type string, tail_type string")
    got, _ = legacy.legacy_clean(m, rel, docs, sig)
    assert sorted((r["doc_id"], r["id"], r["start"], r["end"], r["surface"]) for r in got.collect()) == [(1, "a", 59, 64, "ALPHA"), (1, "b", 32, 36, "Beta"), (1, "d", 0, 5, "Alpha")]
