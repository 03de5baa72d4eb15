"""Long tokens and hosts in linear time, candidates against plain Python, names of columns that clash or hold dots."""

import re
import time

import pytest
from pyspark.sql import functions as F

from graphloom.llm import pii, secret_scan, url_filter

from .test_scans import brute_features


def test_a_long_token_costs_what_its_length_does(spark):
    token = "aB3x/qu" * 150_000
    df = spark.createDataFrame([(token, 'token = "', '" end'), ("aaaa1111", "", "")], "match string, before string, after string")
    df.limit(1).select(*secret_scan.features()).collect()
    began = time.time()
    got = {r[0]: list(r[1:]) for r in df.select("match", *secret_scan.features()).collect()}
    assert time.time() - began < 10
    assert got["aaaa1111"] == pytest.approx(brute_features("aaaa1111", "", ""))
    short = "aB3x/qu" * 150
    assert got[token][1] == pytest.approx(brute_features(short, "", "")[1], abs=1e-2)


def test_candidates_are_those_of_plain_python(spark, sf):
    """Every candidate span of whole documents, and of one very long text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "x" * 200_000 + " key=" + "ab12" * 50_000 + "\U0001f600abc12345 .")], "doc_id long, text string"))
    pattern = re.compile(secret_scan.CANDIDATE, re.ASCII)
    want = sorted((r.doc_id, m.start(), m.end(), m[0]) for r in docs.collect() for m in pattern.finditer(r.text or ""))
    found = secret_scan.matches(docs, "doc_id", "text", {"secret": (secret_scan.CANDIDATE, lambda t: t.rlike("[0-9]") | t.rlike(secret_scan.LONG_RUN))}, "t", letters=True).filter("kind is not null")
    assert sorted((r.doc_id, r.start, r.end, r.match) for r in found.collect()) == want and len(want) > 100


def test_a_long_host_costs_what_its_length_does(spark):
    host = "a." * 50_000
    rows = [(1, f"http://{host}spam-farm.example.com/x"), (2, f"http://{host}example.org/"), (3, f"http://{'b' * 100_000}.com/en/1"), (4, f"http://x.org/es/{'c/' * 100_000}")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([(u,) for u in url_filter.LISTED], "url string")
    url_filter.judge(pages.limit(0), listed).collect()
    began = time.time()
    got = {r.page_id: (r.verdict, r.rule, r.listed) for r in url_filter.judge(pages, listed).collect()}
    assert time.time() - began < 15
    assert got == {1: ("block", None, "spam-farm.example.com"), 2: ("allow", None, None), 3: ("block", "com/en/", None), 4: ("block", "org/es/", None)}


def test_listed_hosts_of_many_labels(spark):
    deep = ".".join("abcdefgh") + ".example.com"
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate((deep, "z." + deep, deep[2:], "y.one", "one", "x.two.parts", "parts"))], "page_id long, url string")
    listed = spark.createDataFrame([(f"http://{deep}/",), ("http://one",), ("http://two.parts/p",), ("http://parts/q",)], "url string")
    assert [r.verdict for r in url_filter.judge(pages, listed, ()).orderBy("page_id").collect()] == ["block", "block", "allow", "block", "block", "allow", "allow"]


def test_names_that_clash_or_hold_dots(spark):
    rows = [(1, 'mail a@b.org, token = "Zk3jQ9vX7pLm2TnB5w"', "http://spam-farm.example.com/")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, url string")
    odd = plain.select(F.col("doc_id").alias("the.id"), F.col("text").alias("the.text"), F.col("url").alias("a.url"), *(F.lit(f"clash {n}").alias(n) for n in ("uid", "the text", "lang", "kind", "i", "start", "end", "match", "key", "block", "host", "rule", "deal", "score", "secret")))
    forest = secret_scan.train(secret_scan.labelled_findings(spark, 200))
    span = lambda df: [(r.doc_id, r.start, r.end, r.match) for r in df.collect()]
    assert span(secret_scan.scan(odd, forest, "the.id", "the.text")) == span(secret_scan.scan(plain, forest)) != []
    verdicts = url_filter.judge(odd, spark.createDataFrame([(u,) for u in url_filter.LISTED], "url string"), id_col="the.id", url_col="a.url").collect()
    assert [(r.page_id, r.verdict) for r in verdicts] == [(1, "block")]
    kinds = lambda df: sorted((r.doc_id, r.kind, r.start, r.end) for r in df.filter("kind is not null").collect())
    assert kinds(pii.find(odd, "the.id", "the.text")) == kinds(pii.find(plain)) != []
