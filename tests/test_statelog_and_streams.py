import random

import pytest
from pyspark.sql import functions as F

from reelspark.operators import statelog
from reelspark.streaming import jobs
from tests.conftest import rows

SCHEMA = "project_id long, seq long, action string, target string, technical_qa_passed boolean"


def _requests(seed, projects=4, length=60):
    rng = random.Random(seed)
    out = []
    for p in range(projects):
        state = None
        for seq in range(length):
            if rng.random() < 0.15 and state:
                out.append((p, seq, "fail", None, False))
                continue
            allowed = [statelog.START] if state is None else [state, *statelog.NEXT[state]]
            target = rng.choice(allowed) if rng.random() < 0.8 else rng.choice(list(statelog.NEXT))
            qa = rng.random() < 0.7
            out.append((p, seq, "enter", target, qa))
            if target in allowed and (target != "DELIVERED" or qa):
                state = target
    return out


def test_literal_log(spark):
    log = [(1, 0, "enter", "CREATED", None), (1, 1, "enter", "ANALYZED", None), (1, 2, "enter", "INGESTING", None), (1, 3, "fail", None, None),
           (1, 4, "enter", "INGESTING", None), (1, 5, "enter", "ANALYZED", None), (2, 0, "enter", "INGESTING", None), (2, 1, "fail", None, None)]
    got = rows(statelog.validate_log(spark.createDataFrame(log, SCHEMA)), "project_id", "seq")
    assert [(r[2], r[4], r[5]) for r in got] == [
        (True, "CREATED", 1), (False, "CREATED", 1), (True, "INGESTING", 1), (True, "FAILED_INGESTING", 1), (True, "INGESTING", 2), (True, "ANALYZED", 1),
        (False, None, 0), (False, None, 0)]
    assert got[1][3] == "illegal_transition" and got[6][3] == "must_start_created" and got[7][3] == "no_state"


@pytest.mark.parametrize("chunk", [1, 7, 25])
def test_chunks_do_not_change_verdicts(spark, chunk):
    df = spark.createDataFrame(_requests(chunk), SCHEMA)
    assert rows(statelog.validate_log(df, chunk), "project_id", "seq") == rows(statelog.validate_log(df), "project_id", "seq")


def test_current_state(spark):
    df = spark.createDataFrame(_requests(2), SCHEMA)
    verdicts = statelog.validate_log(df)
    last = {r.project_id: r.state for r in statelog.current_state(statelog.accepted_log(verdicts)).collect()}
    for p, state in last.items():
        assert state == verdicts.where((F.col("project_id") == p) & F.col("accepted")).orderBy(F.desc("seq")).first().state


def _drain(stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@pytest.mark.parametrize("files_per_trigger", [1, 7, 64])
def test_stream_equals_batch_whatever_the_file_order(spark, tmp_path, files_per_trigger):
    data = _requests(5, 3, 30)
    random.Random(files_per_trigger).shuffle(data)
    for part in range(9):
        spark.createDataFrame(data[part::9], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/p={part}"))
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = _drain(jobs.validate_stream(stream), tmp_path)
    assert rows(got, "project_id", "seq") == rows(statelog.validate_log(spark.createDataFrame(data, SCHEMA)), "project_id", "seq")


def test_repeats_are_late(spark, tmp_path):
    log = [(0, 0, "enter", "CREATED", None), (0, 1, "enter", "INGESTING", None)]
    for part, requests in enumerate([log[1:], log, log[:1] + [(1, 1, "fail", None, None)]]):
        spark.createDataFrame(requests, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/p={part}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = rows(_drain(jobs.validate_stream(stream), tmp_path), "seq", "reason")
    # The gap before project 1's request never closes, so it has no verdict.
    assert sorted((r[0], r[1], r[3] or "") for r in got) == [(0, 0, ""), (0, 0, "late"), (0, 1, ""), (0, 1, "late")]


def test_patience_ends(spark, tmp_path):
    spark.createDataFrame([(0, 1, "enter", "CREATED", None), (0, 2, "enter", "INGESTING", None)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/p=0"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = jobs.validate_stream(stream, patience_ms=1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
    query = query.trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            done = rows(spark.read.schema(stream_schema()).parquet(f"{tmp_path}/out"), "seq") if (tmp_path / "out/_spark_metadata").exists() else []
            if done:
                break
    finally:
        query.stop()
    assert [(r[1], r[4]) for r in done] == [(1, "CREATED"), (2, "INGESTING")]


def stream_schema():
    return statelog.VERDICTS


def test_first_seen_drops_repeats_and_late_rows(spark, tmp_path):
    days = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-03 00:00:00")], [("c", "2024-01-03 00:30:00"), ("b", "2024-01-03 00:20:00")], [("z", "2024-01-01 00:00:00")]
    for i, part in enumerate(days):
        spark.createDataFrame(part, "key string, t string").select("key", F.col("t").cast("timestamp").alias("entered_at")).coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    stream = spark.readStream.schema("key string, entered_at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    assert sorted(r.key for r in _drain(jobs.first_seen(stream, "key").select("key"), tmp_path).collect()) == ["a", "b", "c"]


def _sighted(spark, tmp_path, files, keep, late):
    for i, part in enumerate(files):
        spark.createDataFrame(part, "key string, us long").select("key", F.timestamp_micros("us").alias("entered_at")).coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    stream = spark.readStream.schema("key string, entered_at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = jobs.write_routed(jobs.sightings(stream, "key", keep=keep, late=late), str(tmp_path / "routed"))
    query.awaitTermination()
    found = {n: sorted((r.key, r.at_us) for r in spark.read.option("recursiveFileLookup", "true").schema("key string, at_us long").parquet(str(tmp_path / "routed" / n)).collect()) for n in ("rows", "late")}
    return found, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_sightings_expire_and_late_rows_are_kept_apart(spark, tmp_path):
    second = 1_000_000
    # Every file brings new keys; old ones leave the state.
    files = [[(f"k{i}-{j % 20}", (100 * i + j) * second) for j in range(40)] for i in range(6)]
    files[2].append(("k0-0", 5 * second))  # far behind
    files[3].append(("k2-1", 331 * second))  # seen 130 s ago
    files.append([("end", 10_000 * second)])
    found, sizes = _sighted(spark, tmp_path, files, "60 seconds", "30 seconds")
    want = [(f"k{i}-{j}", (100 * i + j) * second) for i in range(6) for j in range(20)] + [("k2-1", 331 * second)]
    assert found["rows"] == sorted(want) and found["late"] == [("k0-0", 5 * second)]
    # A key has a state or a waiting row, and two entries of its timer. The state never holds all 121 keys, and shrinks.
    assert max(sizes) < 4 * 60 and sizes[-1] < 10


def test_sightings_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(4)
    second = 1_000_000
    data = sorted(((rng.choice("abc"), rng.randrange(0, 2000) * second) for _ in range(300)), key=lambda r: r[1] + rng.randrange(-20, 20) * second)
    data.append(("end", 5000 * second))
    want = []
    for key in "abc":
        last = None
        for at in sorted({t for k, t in data if k == key}):
            if last is None or at - last >= 100 * second:
                want.append((key, at))
                last = at
    for size in (301, 60):
        found, _ = _sighted(spark, tmp_path / str(size), [data[i : i + size] for i in range(0, len(data), size)], "100 seconds", "60 seconds")
        assert found == {"rows": sorted(want), "late": []}


def test_sightings_cost_a_key_a_few_state_calls_per_batch():
    """A thousand instants of a key come in one append with one timer, and one timer judges all of them."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.rows = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("appendList", "put"):
                    self.rows = (self.rows if name == "appendList" else []) + list(args[0])
                elif name == "update":
                    self.rows = [args[0]]
                elif name == "clear":
                    self.rows = []
                return bool(self.rows) if name == "exists" else iter(self.rows)

            return call

        def get(self):
            calls.append("get")
            return iter(self.rows) if len(self.rows) != 1 else self.rows[0]

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return State()

        getListState = getMapState = getValueState  # noqa: N815

        def registerTimer(self, at):  # noqa: N802
            calls.append("registerTimer")

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    judge = jobs.Sightings(10_000_000)
    judge.init(Handle())
    assert list(judge.handleInputRows(("k",), iter([pd.DataFrame({"at_us": [i * 1_000_000 for i in range(1000)]})]), Clock(0))) == []
    out = list(judge.handleExpiredTimer(("k",), Clock(500_000), None))
    assert out[0]["at_us"].tolist() == [i * 10_000_000 for i in range(51)] and len(calls) < 20
