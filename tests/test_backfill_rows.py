"""The backfill shuffles offsets, seeds and whole texts once: no words, and no parts of texts."""

from spanforge.operators import backfill, textscan


def test_nothing_is_shuffled_behind_the_texts(spark):
    docs = spark.createDataFrame([(1, "CVE one Alpha Beta. Alpha CVE alpha"), (2, "Alpha. CVE")], "doc_id long, text string")
    found = spark.createDataFrame([(1, "Alpha", "a", 1), (1, "alpha beta", None, 2), (2, "Alpha", "a", 1)], "doc_id long, seed string, norm string, rank int")
    mentions = spark.createDataFrame([(1, 20, 25)], "doc_id long, start long, end long")
    anchors = spark.createDataFrame([(1, 0), (1, 26), (2, 7)], "doc_id long, start long")
    out = backfill.backfill(docs, mentions, found, textscan.sentences(docs, "dot"), anchors)
    assert sorted(map(tuple, out.collect())) == [(1, 8, 18, "Configuration", "Alpha Beta", None), (1, 30, 35, "Configuration", "alpha", "a")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan")[0]
    assert "MapInArrow" in final and "Exchange" not in final.split("MapInArrow")[0]
    assert "FlatMapGroups" not in plan
