"""Alias expansion with terms that are in every query."""

from reelspark.operators import catalog
from tests.conftest import rows


def test_frequent_terms_are_dealt_out(spark):
    queries = spark.createDataFrame([(i, f"  cut t{i % 7}  shot" if i % 2 else "cut") for i in range(200)] + [(500, ""), (501, None)], "query_id int, text string")
    aliases = spark.createDataFrame([("cut", "edit splice"), ("cut", "trim"), ("t3", "three"), ("absent", "x"), ("shot", "")], "term string, appended string")
    want = set()
    for i in range(200):
        terms = f"cut t{i % 7} shot".split() if i % 2 else ["cut"]
        want |= {(i, t) for t in terms} | {(i, a) for t in terms for a in {"cut": ["edit", "splice", "trim"], "t3": ["three"]}.get(t, [])}
    for term_rows in (1 << 16, 8, 1):
        out = catalog.expand_aliases(queries, aliases, term_rows)
        assert rows(out, "query_id", "term") == sorted(want)


def test_a_term_of_all_queries_is_spread(spark):
    queries = spark.range(4000).selectExpr("id AS query_id", "'cut' AS text")
    aliases = spark.createDataFrame([("cut", "edit")], "term string, appended string")
    out = catalog.expand_aliases(queries, aliases, 100)
    assert out.count() == 8000
    plan = out._jdf.queryExecution().toString()
    assert "_group" in plan  # the join's key: forty groups of the one term
