"""The registered queries on the smallest test tables: SQL where there is some, the contract's columns everywhere."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from reelspark.llm import queries
from tools.check import TABLES, compare

FOLDER = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
COLUMNS = {
    1: {"doc_id": "bigint", "item_id": "bigint"},
    2: {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    3: {"doc_id": "bigint", "n_tokens": "bigint"},
    4: {"doc_id": "bigint", "quality": "double", "keep": "boolean"},
    5: {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    6: {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    7: {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    8: {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    9: {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    10: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    11: {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    12: {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    13: {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
}


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_matches_sql(spark, con, name):
    verdict, detail = compare(spark, con, str(FOLDER), name)
    assert verdict == "ok", detail


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.CHECKS)))
def test_query_without_sql(spark, con, name):
    out = queries.QUERIES[name](spark, str(FOLDER))
    number = int(name[2:].split("_")[0])
    types = dict(out.dtypes)
    assert {c: types.get(c) for c in COLUMNS[number]} == COLUMNS[number]
    rows = out.count()
    per_row = {5: "pages", 3: "documents", 4: "documents", 8: "documents", 10: "documents"}
    if number in per_row:
        assert rows == con.execute(f"SELECT count(*) FROM {per_row[number]}").fetchone()[0]
    assert rows > 0


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert set(queries.CHECKS) <= set(entry.oracle_sql())
