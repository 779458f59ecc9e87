from pyspark.sql import functions as F

from orgatlas.operators import gapfill as G
from orgatlas.plans import register_queries as R


def test_fill_never_pairs_companies_with_places(spark):
    """Three hundred companies and as many places of one name, and one alike: one row a key meets one row a key."""
    places = spark.range(300).selectExpr("concat('acme works of nation', CASE WHEN id = 7 THEN 's' ELSE '' END) AS name", "'GB' AS country", "id AS ord", "map('website', CASE WHEN id < 9 THEN '' ELSE concat('w', id) END, 'email', CASE WHEN id = 7 THEN 'e7' ELSE '' END) AS tags")
    firms = spark.range(300).selectExpr("id AS company_id", "'Acme Works of Nation Ltd' AS name", "CASE WHEN id = 5 THEN NULL ELSE 'gb' END AS country", "CAST(NULL AS STRING) AS website", "CASE WHEN id = 3 THEN 'p' END AS phone", "CAST(NULL AS STRING) AS email")
    for loose, email in ((True, "e7"), (False, None)):
        got = {r.company_id: (r.website, r.phone, r.email) for r in G.osm_fill(firms, places, loose).collect()}
        assert got == {i: (None if i == 5 else "w9", "p" if i == 3 else None, None if i == 5 else email) for i in range(300)}
    own, theirs = G.keys_of(firms, places)
    assert G.first_values(own, theirs).count() == 299


def test_made_up_names_have_no_letter_twice(spark):
    firms, places = R.alike_names(spark, "/root/testdata/sf0.001")
    assert all(len(set(r.name)) == 20 for r in firms.collect())
    assert firms.select("name").distinct().count() == firms.count() and places.where(F.length("name") > 20).count() > 0


def test_alike_names_never_go_through_the_driver(spark):
    """However small the names look to the planner, what is made of them (hundreds of rows a name) is not broadcast."""
    firms, places = R.alike_names(spark, "/root/testdata/sf0.001")
    for rows in (G.alike_candidates(*G.keys_of(firms, places)), G.osm_matches(firms, places)):
        assert "Broadcast" not in rows._jdf.queryExecution().sparkPlan().toString()


def test_letters_rule_out_no_more_than_strangers(spark):
    pairs = [("abcdefgh", "abxdefgh"), ("aab", "b"), ("textile77", "p7extile"), ("straße9", "strasse9"), ("abc", "abc")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = rows.select(G.only(G.letters(a), G.letters(b)).alias("few"), G.strangers(a, b, F.lit(100)).alias("all")).collect()
    assert [r.few for r in got] == [1, 1, 0, 1, 0] and all(r.few <= r["all"] for r in got)
