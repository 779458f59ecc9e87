from orgatlas.operators import retrieval


def test_copies_are_one_entry_and_come_in_order_of_ids(spark):
    """Two thousand records of four names: an index of four entries, of which each search reads a few blocks."""
    record = spark.range(2000).selectExpr("id AS record_id", "concat('alpha trading', CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN ' beta' WHEN 2 THEN ' gamma' ELSE ' beta gamma' END) AS name", "'gb' AS country")
    index = retrieval.build_index(record, many=100)
    assert index.deepest == 0 and index.blocks.where("scope = '' and term = 'alpha'").selectExpr("size(postings) AS n").first().n == 4
    company = spark.createDataFrame([(1, "Trading Alpha", "gb"), (2, "gamma beta", "us")], "company_id long, name string, country string")
    found = retrieval.search_names(company, record, k=10, many=100).orderBy("company_id", "scope", "ord").collect()
    ids = lambda company, scope: [r.record_id for r in found if (r.company_id, r.scope) == (company, scope)]
    assert ids(1, "") == ids(1, "gb") == list(range(0, 40, 4))
    assert ids(2, "") == list(range(3, 43, 4)) and ids(2, "us") == []


def test_equal_scores_of_different_names_are_ordered_by_id(spark):
    """beta and gamma stand in as many records, so both names score the same: their ids alternate."""
    record = spark.range(40).selectExpr("id AS record_id", "CASE id % 2 WHEN 0 THEN 'alpha beta' ELSE 'alpha gamma' END AS name", "'gb' AS country")
    company = spark.createDataFrame([(1, "alpha", "gb")], "company_id long, name string, country string")
    found = retrieval.search_names(company, record, k=10).where("scope = ''").orderBy("ord").collect()
    assert [r.record_id for r in found] == list(range(10))
