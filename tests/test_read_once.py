"""Steps that several parts of an operator read are made once: rows are counted where they are made."""

import uuid

import pytest

from spanforge.operators import chunk, link, metrics, predictors
from spanforge.schema import dim_entity_type, dim_relation

MENTION = "doc_id long, start long, end long, type string, surface string, norm string, id string"


@pytest.fixture
def counted(spark):
    made = spark.sparkContext.accumulator(0)

    def count(df):
        def run(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema), made

    return count


def test_a_predictor_without_relations_runs_once_a_document(spark, counted, tmp_path):
    docs = spark.createDataFrame([(k, "x") for k in range(9)], "doc_id long, text string")
    seen = []

    def predict(rows):
        rows, made = counted(rows)
        seen.append(made)
        return rows.selectExpr("doc_id", "0L AS start", "1L AS end", "text AS surface", "if(doc_id < 7, 'Weakness', 'Unlisted') AS type", "'E0' AS id"), None

    known = predictors.Predictors(dim_entity_type(spark), dim_relation(spark))
    known.register("one", predict)
    m, r = known.run("one", docs, f"{tmp_path}/{uuid.uuid4().hex}")
    assert m.count() == 7 and r.count() == 0 and "method" in r.columns
    assert seen[0].value == 9


def test_window_scores_read_predictions_once(spark, counted):
    docs = spark.createDataFrame([(1, "x" * 5000)], "doc_id long, text string")
    gold = spark.createDataFrame([(1, s, s + 8, "Weakness", "x" * 8, "X", f"E{s}") for s in range(0, 4900, 50)], MENTION)
    w = chunk.stride_windows(docs)
    given, made = counted(chunk.to_document(chunk.project_mentions(gold, w), w))
    n = given.count()
    before = made.value
    got = {x["type"]: x for x in metrics.window_mention_scores(gold, given, chunk.ownership(w), dim_entity_type(spark)).collect()}
    assert (got["Weakness"]["tp"], got["Weakness"]["fp"], got["Weakness"]["fn"]) == (98, 0, 0)
    assert got["Weakness"]["boundary_only"] == 0 and got["Weakness"]["norm_accuracy"] == 1
    assert made.value - before == n


def test_closest_pairs_read_relations_once(spark, counted):
    rows = [(1, 0, 4, "Vulnerability", "aaaa", "A", "E0"), (1, 10, 14, "Weakness", "bbbb", "B", "E10"), (1, 900, 904, "Weakness", "bbbb", "B", "E900")]
    mentions = spark.createDataFrame(rows, MENTION)
    rel, made = counted(spark.createDataFrame([(1, "R0", "instantiates", "E0", "E900", 0, 1000)], "doc_id long, id string, type string, head string, tail string, ev_start long, ev_end long"))
    got = link.reanchor_pairs(rel, mentions).collect()
    assert [(x["head"], x["tail"], x["moved"]) for x in got] == [("E0", "E10", True)]
    assert made.value == 1
