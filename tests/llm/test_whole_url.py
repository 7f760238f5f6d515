"""Prefix entries of any depth and letter case."""

from datetime import datetime as d

from pathloom.llm import url_filter


def test_deep_and_upper_case_prefixes(spark):
    entries = spark.createDataFrame([("a", "prefix", "x.org/1/2/3/4/5/6", d(2023, 1, 1), "add"), ("b", "Prefix", "Y.org/Files/Old", d(2023, 1, 1), "add")], "list string, kind string, pattern string, date timestamp, action string")
    urls = ["http://x.org/1/2/3/4/5/6", "http://x.org/1/2/3/4/5/6/7?q", "http://x.org/1/2/3/4/5", "http://x.org/1/2/3/4/5/66", "http://y.ORG/Files/Old/z", "http://y.org/files/old/z"]
    captures = spark.createDataFrame([(i, u, d(2023, 2, 1)) for i, u in enumerate(urls)], "page_id long, url string, fetched timestamp")
    assert [r.lists for r in url_filter.evaluate(captures, entries).orderBy("page_id").collect()] == ["a", "a", "", "", "b", ""]
    assert url_filter.evaluate(captures, entries.where("false")).where("not blocked").count() == len(urls)
