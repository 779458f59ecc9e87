from pyspark.sql import functions as F

from orgatlas.functions import text as T
from orgatlas.operators import extract as X


def test_labels_are_worked_out_once(spark):
    calls = spark.sparkContext.accumulator(0)
    said = F.udf(lambda x: calls.add(1) or x, "array<string>")
    rows = spark.createDataFrame([(["A", "a ", "Home", "", "b", "B", "c"],), ([],), (None,)], "x array<string>")
    assert [r.y for r in rows.select(T.distinct_labels(said("x")).alias("y")).collect()] == [["A", "b", "c"], [], None]
    assert str(T.distinct_labels(F.col("x"))).count("regexp_replace") == 1


def test_social_hosts_are_looked_for_once(spark):
    rows = spark.createDataFrame([(1, ["https://netflix.com/a", "https://xxcom.example", "https://GitHub.com/b", "https://example.com/x.com"])], "id long, hrefs array<string>")
    assert [r.value for r in X.social_links(rows, F.col("hrefs"), "id").collect()] == ["https://netflix.com/a", "https://GitHub.com/b"]
