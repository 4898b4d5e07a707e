"""Intermediate tables in the folder that spark.checkpoint.dir names, under a cluster's master."""

import datetime

import pytest
from pyspark.sql import DataFrameReader

import __spark_entry__
from reelspark import session
from reelspark.plans.primitive_queries import drain

from tests.conftest import rows


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session as one that a cluster's master serves; its folder is a plain path."""
    assert session.shared_folder(spark).startswith("/")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_TRIED", set(), raising=False)
    return spark


def test_plain_path_on_a_cluster(cluster):
    got = session.materialise(cluster.range(5), "five")
    assert rows(got, "id") == [(0,), (1,), (2,), (3,), (4,)]
    assert len(session._TRIED) == 1


def test_queries_on_a_cluster(cluster, tmp_path):
    day = datetime.datetime(2024, 3, 1)
    kinds = ["click", "error", "view", "purchase", "click", "view"]
    events = [(i, day + datetime.timedelta(days=i), 7, kind, 10.0 * i, "{}") for i, kind in enumerate(kinds)]
    cluster.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = __spark_entry__.queries()
    assert found["current_states"](cluster, str(tmp_path)).count() == 1


def test_stream_on_a_cluster(cluster, tmp_path):
    requests = session.materialise(cluster.range(3), "requests")
    stream = cluster.readStream.schema(requests.schema).parquet(requests.inputFiles()[0].rsplit("/", 1)[0])
    assert rows(drain(stream, "copied"), "id") == [(0,), (1,), (2,)]


def test_folder_of_one_machine_is_refused(cluster, monkeypatch):
    """Rows that stayed on another machine's disk are missing from the trial table."""
    whole = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, path: whole(self, path).where("id > 0"))
    for _ in range(2):
        with pytest.raises(ValueError, match="lies on one machine"):
            session.shared_folder(cluster)


def test_cluster_without_the_setting_is_refused(cluster, monkeypatch):
    monkeypatch.setattr(type(cluster.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(cluster.sparkContext, "getCheckpointDir", lambda: None)
    with pytest.raises(ValueError, match="set spark.checkpoint.dir"):
        session.shared_folder(cluster)
