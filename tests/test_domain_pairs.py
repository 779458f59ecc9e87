from orgatlas.functions import urls as U
from pyspark.sql import functions as F


def test_pairs_of_one_large_domain_are_made_by_many_tasks(spark):
    pages = spark.createDataFrame([(i, "a.example" if i < 300 else f"b{i}.example") for i in range(310)] + [(400, None)], "page_id long, domain string")
    found = U.pairs_of_domain(pages).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.page_id, r.other_id) for r in found) == [(i, j) for i in range(300) for j in range(i + 1, 300)]
    tasks = [r.task for r in found]
    assert max(tasks.count(t) for t in set(tasks)) < 0.6 * len(found)
