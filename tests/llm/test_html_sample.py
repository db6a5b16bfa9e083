"""Copies of a page take one place in the training sample."""

from spanforge.llm import html_extract


def test_sample_holds_distinct_pages(spark):
    pages = spark.createDataFrame([(f"<p>page {k}</p>",) for k in range(6) for _ in range(50)] + [(None,)], "html string")
    got = [r["h"] for r in html_extract.sample_pages(pages, "html", 4).collect()]
    assert len(got) == len(set(got)) == 4
