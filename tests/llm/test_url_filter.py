import functools
import re

import pytest
from comparing import assert_same
from pyspark.sql import functions as F

from tracewell.llm import queries
from tracewell.llm.oracles import ORACLES
from tracewell.llm.url_filter import BITS_PER_URL, _bits, bloom, filter_urls


def test_whole_table_against_sql(spark, sf_dir):
    assert_same(queries.op4_url_filter(spark, sf_dir), ORACLES["op4_url_filter"], sf_dir)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_list_is_not_empty_and_blocks(spark, sf):
    rows = queries.op4_url_filter(spark, f"/root/testdata/{sf}").where("listed and rule is null").collect()
    assert rows and all(r["verdict"] == "block" for r in rows)
    assert all(set(r["host"].split(".")) & set(queries.BAD_HOSTS) for r in rows)


def test_false_positives_of_the_filter_are_removed(spark):
    listed = spark.range(20000).selectExpr("concat('http://h/u', id) as url")
    pages = spark.range(400000).selectExpr("id as page_id", "concat('http://h/u', id) as url")
    blocks = -(-20000 * BITS_PER_URL // 512)
    test = lambda i, b: F.call_function("shiftright", F.col(f"w{i}"), b).bitwiseAND(F.lit(1)) == 1
    probed = pages.selectExpr("page_id", "concat('h/u', page_id) as url").withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks))).join(bloom(listed.selectExpr("substring(url, 8) as url"), blocks), "block")
    possible = probed.where(functools.reduce(lambda a, b: a & b, [test(i, b) for i, b in enumerate(_bits(F.col("url")))])).count()
    assert 20000 < possible < 20000 + 0.01 * 380000
    assert filter_urls(pages, listed, []).where("listed").count() == 20000


def test_very_long_and_repeated_urls(spark):
    long = "http://h/" + "x" * 1_000_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, long + "y"), (3, long + "?b=1&a=2"), (None, None)], "page_id long, url string")
    rows = filter_urls(pages, pages.where("page_id = 1").select("url"), queries.URL_RULES).collect()
    assert sorted((r["page_id"] or 0, r["verdict"], len(r["path"])) for r in rows) == [(0, "allow", 0), (1, "block", 1_000_001), (1, "block", 1_000_001), (2, "allow", 1_000_002), (3, "allow", 1_000_001)]


def test_rules_and_odd_urls(spark):
    urls = ["http://a.Example.COM/en/7x?q#f", "https://example.com/en/8", "http://xexample.com/en/7", "ftp://x.example.net/de/80", "http://net/de/", None, "", "no scheme/en/", "http://", "://h/p", "x://é.ORG/es/É?#", "http://b.org/fr/\n/x", "http://com?/en/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash"), (None, urls[1], None)], "page_id long, url string, canon string")
    rows = filter_urls(pages, pages.where("false").select("url"), queries.URL_RULES).collect()
    assert len(rows) == len(pages.collect())
    by = {r["page_id"]: r for r in rows}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")
        assert (by[i]["host"], by[i]["path"], by[i]["rule"], by[i]["verdict"]) == (host, path, rule, verdict), u


def test_listed_urls_in_other_spellings(spark):
    pages = spark.createDataFrame([(1, "http://Bad.test/x/?b=2&utm_source=q&a=1#z"), (2, "https://bad.test/x?a=1&b=2"), (3, "https://bad.test/x?a=1"), (4, None)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in filter_urls(pages, pages.where("page_id in (2, 4)").select("url"), []).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_bloom_has_every_listed_url_and_few_others(spark):
    listed = spark.range(2000).selectExpr("concat('u', id) as url")
    pages = spark.range(4000).selectExpr("id as page_id", "concat('http://h/u', id) as url")
    some = pages.where("page_id < 2000").select("url")
    assert bloom(listed, 63).count() == 63
    rows = filter_urls(pages, some, []).collect()
    assert {r["page_id"] for r in rows if r["listed"]} == set(range(2000))


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(pages, pages.select("url"), queries.URL_RULES).count() == 0
