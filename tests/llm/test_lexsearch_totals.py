"""Term counts of the block search."""

from pyspark.sql import functions as F

from siterank.llm import lexsearch


def test_totals_count_terms_without_building_them(spark):
    texts = [None, "", "...", "One one ONE-two", "É日本 x_y\x7fz", "7"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    each = [r[0] for r in docs.select(F.size(lexsearch.terms("text"))).collect()]
    assert lexsearch.totals(docs) == (sum(n > 0 for n in each), sum(each)) == (3, 9)
    assert lexsearch.totals(docs.limit(0)) == (0, 0)
