import pytest
from conftest import SF, same

from gleaner.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_html_text(spark):
    from gleaner.functions.extraction import html_text

    df = spark.createDataFrame([("<head><title>x</title></head><p>a &amp; b<br>c<script>no</script></p>",), (None,), ("",)], "h string")
    assert [r.t for r in df.select(html_text("h").alias("t")).collect()] == ["a & b\nc", None, ""]
