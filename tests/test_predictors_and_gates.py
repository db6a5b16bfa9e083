"""Predictor registry, growing results, gates of repeated runs, the final choice."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from spanforge.operators import metrics, predictors, rank, stats
from spanforge.schema import dim_entity_type, dim_relation


def some_docs(spark, *ids):
    return spark.createDataFrame([(d, f"text {d}") for d in ids], "doc_id int, text string")


def words(calls):
    def predict(docs):
        calls.append(sorted(r["doc_id"] for r in docs.collect()))
        m = docs.where("doc_id <> 3").select("doc_id", F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(t).alias("type")) for i, t in (("A", "Vulnerability"), ("B", "Configuration"), ("C", "Unlisted"))))).alias("z"))
        m = m.select("doc_id", "z.id", "z.type", F.lit(0).alias("start"), F.lit(4).alias("end"))
        r = docs.where("doc_id <> 3").select("doc_id", F.explode(F.array(F.struct(F.lit("R1").alias("id"), F.lit("B").alias("tail")), F.struct(F.lit("R2").alias("id"), F.lit("C").alias("tail")))).alias("z"))
        return m, r.select("doc_id", "z.id", F.lit("affects").alias("type"), F.lit("A").alias("head"), "z.tail")

    return predict


def test_registry_keeps_to_the_ontology(spark):
    known = predictors.Predictors(dim_entity_type(spark), dim_relation(spark))
    known.register("w", words([]))
    known.register("none", lambda docs: (docs.select("doc_id", F.lit("A").alias("id"), F.lit("Weakness").alias("type")), None), frozen=True)
    assert known.names() == ["none", "w"]
    m, r = known.predict_all(some_docs(spark, 1, 2))
    assert sorted((x["method"], x["doc_id"], x["id"]) for x in m.collect()) == [("none", 1, "A"), ("none", 2, "A"), ("w", 1, "A"), ("w", 1, "B"), ("w", 2, "A"), ("w", 2, "B")]
    assert sorted((x["method"], x["doc_id"], x["id"]) for x in r.collect()) == [("w", 1, "R1"), ("w", 2, "R1")]
    with pytest.raises(ValueError):
        known.register("w", words([]))
    with pytest.raises(KeyError):
        known.predict("x", some_docs(spark, 1))
    with pytest.raises(RuntimeError):
        known.run("none", some_docs(spark, 1), "/tmp/never")


def test_results_grow_by_what_is_missing(spark, tmp_path):
    calls = []
    known = predictors.Predictors(dim_entity_type(spark), dim_relation(spark))
    known.register("w", words(calls))
    known.run("w", some_docs(spark, 1, 3), str(tmp_path))
    # a lost run: its rows are there, but no key of it is done
    known.predict("w", some_docs(spark, 2))[0].withColumn("run", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(f"{tmp_path}/w/mentions")
    m, r = known.run("w", some_docs(spark, 1, 2, 3), str(tmp_path))
    assert [c for c in calls if c] == [[1, 3], [2], [2]], "a document without mentions is done too, one of a lost run is not"
    assert sorted((x["doc_id"], x["id"]) for x in m.collect()) == [(1, "A"), (1, "B"), (2, "A"), (2, "B")]
    assert sorted((x["doc_id"], x["id"]) for x in r.collect()) == [(1, "R1"), (2, "R1")]
    again, _ = known.run("w", some_docs(spark, 1), str(tmp_path))
    assert again.count() == 4 and calls[-1] == []


def test_paired_gates(spark):
    rng = random.Random(2)
    rows = [(m, x, k, round(rng.random(), 2)) for m in "abc" for x in ("f", "r", "free") for k in range(5)] + [("d", "f", 9, 0.9)]
    rules = {"f": (0.1, None, 0.3, 1), "r": (0.0, 0.4, None, None)}
    df = spark.createDataFrame(rows, "method string, metric string, repeat int, score double")
    rule_rows = spark.createDataFrame([(x, *r) for x, r in rules.items()], "metric string, least_gain double, floor double, large_drop double, most_large_drops int")
    got = {(r["method"], r["metric"]): r for r in stats.paired_gates(df, "a", rule_rows).collect()}
    base = {(x, k): s for m, x, k, s in rows if m == "a"}
    assert len(got) == 10 and not got["d", "f"]["gains"] and got["d", "f"]["gain"] is None
    for m in "abc":
        for x in ("f", "r", "free"):
            scores = [s for mm, xx, k, s in rows if (mm, xx) == (m, x)]
            gains = [s - base[x, k] for mm, xx, k, s in rows if (mm, xx) == (m, x)]
            least, floor, drop, most = rules.get(x, (None, None, None, None))
            up = sum(g >= -1e-12 if least == 0 else g > 0 for g in gains)
            ok = least is None or (sum(gains) / 5 + 1e-12 >= least and up >= 4)
            ok = ok and (floor is None or sum(scores) / 5 >= floor) and (most is None or sum(g < -drop for g in gains) <= most)
            r = got[m, x]
            assert r["n_positive"] == up and abs(r["gain"] - sum(gains) / 5) < 1e-9 and r["passes"] == ok


def test_final_choice(spark):
    schema = "candidate_id string, objective_f1 double, micro_f1 double, precision double, text string, eligible boolean"
    rows = [("a", 0.9, 0.5, 0.5, "x", False), ("b", 0.8, 0.5, 0.5, "xxx", True), ("c", 0.8, 0.5, 0.5, "xx", True), ("d", None, 0.9, 0.9, "", True), ("e", 0.8, 0.5, 0.5, "yy", True)]
    assert [r["candidate_id"] for r in rank.final_choice(spark.createDataFrame(rows, schema)).collect()] == ["c"]
    for none in (rows[:1], []):
        with pytest.raises(Exception, match="no candidate is eligible"):
            rank.final_choice(spark.createDataFrame(none, schema)).collect()


def test_document_scores(spark):
    docs = some_docs(spark, 1, 2, 3)
    schema = "doc_id int, start int, end int, type string"
    gold = spark.createDataFrame([(1, 0, 3, "Configuration"), (1, 4, 6, "Configuration"), (1, 9, 12, "Weakness")], schema)
    pred = spark.createDataFrame([(1, 0, 3, "Configuration"), (1, 0, 3, "Configuration"), (2, 0, 3, "Configuration"), (1, 4, 6, "Weakness")], schema)
    got = {r["doc_id"]: tuple(r)[1:] for r in metrics.document_scores(docs, gold, pred).collect()}
    assert got == {1: (2, 1, 0, 1, 0.5, 2 / 3), 2: (0, 0, 1, 0, None, None), 3: (0, 0, 0, 0, None, None)}
