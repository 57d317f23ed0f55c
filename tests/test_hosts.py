"""Hosts beyond ASCII in the form that requests have."""

import random

import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from gleaner.functions.text import ascii_host, canonical_url, punycode
from gleaner.plans.queries import QUERIES, SQL


def test_punycode_equals_python(spark):
    rnd = random.Random(7)
    scripts = ["abcxyz019-", "äöüßéñ", "абвгдежз", "αβγσς", "例えテスト漢字", "한국어", "عربي", "😀🎉", "\U0010ffff\u0080"]
    labels = {"".join(rnd.choice(rnd.choice(scripts)) for _ in range(rnd.randint(1, 60))) for _ in range(300)} | {"ü" * 63, "\U0010ffff" * 20, "a" * 60 + "\U0010ffff", "\u0080"}
    rows = sorted(x for x in labels if not x.isascii())
    got = spark.createDataFrame([(x,) for x in rows], "h string").select("h", punycode("h").alias("p")).collect()
    assert {r.h: r.p for r in got} == {x: x.encode("punycode").decode() for x in rows}


@pytest.mark.parametrize(
    ("host", "made"),
    [
        ("Ex.COM", "ex.com"), ("BÜCHER.example", "xn--bcher-kva.example"), ("faß.de", "xn--fa-hia.de"), ("ＪＯＢＳ．example", "jobs.example"), ("ΟΔΟΣ.gr", "xn--pxavbq.gr"),
        ("a​b。c", "ab.c"), ("[2001:DB8::1]", "[2001:db8::1]"), ("", ""), (None, None), ("ü..ü", "xn--tda..xn--tda"), ("例え.jp", "xn--r8jz45g.jp"),
    ],
)
def test_hosts(spark, host, made):
    assert spark.createDataFrame([(host,)], "h string").select(ascii_host("h")).first()[0] == made


def test_urls_of_both_spellings_meet(spark):
    urls = ["https://u@Bücher.example:8443/a?b=1#c", "https://u@xn--bcher-kva.example:8443/a/?b=1"]
    assert spark.createDataFrame([(u,) for u in urls], "u string").select(F.count_distinct(canonical_url("u"))).first()[0] == 1


@pytest.mark.parametrize("name", ["canonical_url", "canonical_url_forms", "identity_keys"])
def test_urls_of_the_tables(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df())
