"""The prefix tree of histories against a plain tree over whole sequences."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from reelspark.llm import histories

LOG = "project_id long, seq long, action string, target string"
FORKS = "project_id long, base_id long, shared int"


def plain(histories_of):
    nodes = {}
    for project, steps in histories_of.items():
        for d in range(len(steps) + 1):
            nodes.setdefault(tuple(steps[:d]), []).append(project)
    out = []
    for path, members in nodes.items():
        under = [q for q in nodes if q[: len(path)] == path]
        has_child = {q[:-1] for q in nodes if q}
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(str(p) for p in sorted(members) if len(histories_of[p]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        children = sum(len(q) == len(path) + 1 for q in under)
        leaves = sum(q not in has_child for q in under)
        out.append((min(members), len(path), parent, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def ordered_log(log):
    out = {}
    for p, s, a, t in sorted((r for r in log if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(p, []).append((a or "", t or ""))
    return out


def forked(log, forks):
    own, out = ordered_log(log), dict(ordered_log(log))
    for p, base, shared in forks:
        out[p] = own.get(base, [])[:shared] + own.get(p, [])[shared:]
    return out


def tree(df, forks=None, **sizes):
    return sorted((tuple(r) for r in histories.history_tree(df, forks, **sizes).collect()), key=lambda r: r[:2])


SIZES = [{}, {"segment": 2, "shard_rows": 4, "packed": 2}, {"segment": 3, "shard_rows": 7, "packed": 1}, {"segment": 1, "shard_rows": 1}]


@pytest.mark.parametrize("sizes", SIZES)
def test_equals_a_plain_tree(spark, sizes):
    rng = random.Random(len(str(sizes)))
    log = []
    for p in range(70):
        for s in range(rng.choice([0, 1, 2, 3, 5, 9])):
            log.append((p, s, rng.choice("ab"), rng.choice(["x", "yé"])))
    # A third of the projects with one history, one very long history, and one that goes on from it.
    log += [(p, s, "same", "history") for p in range(100, 135) for s in range(4)]
    log += [(p, s, "long", str(s % 3)) for p, n in ((200, 60), (201, 75)) for s in range(n)]
    df = spark.createDataFrame(log, LOG).repartition(3)
    assert tree(df, **sizes) == plain(ordered_log(log))


@pytest.mark.parametrize("sizes", SIZES[:2])
def test_forks(spark, sizes):
    rng = random.Random(3)
    log = [(p, s, rng.choice("ab"), rng.choice("xy")) for p in range(20) for s in range(p % 7) if p % 5 or p == 5]
    forks = [(p, p - p % 5, rng.randrange(6)) for p in range(20)] + [(90, 1000, 3), (91, 6, 2)]
    df, fork_rows = spark.createDataFrame(log, LOG), spark.createDataFrame(forks, FORKS)
    want = forked(log, forks)
    assert tree(df, fork_rows, **sizes) == plain(want)
    rows = histories.forked_logs(df, fork_rows).collect()
    assert sorted((r.project_id, r.seq, r.action, r.target) for r in rows) == [(p, i, *step) for p in sorted(want) for i, step in enumerate(want[p])]


def test_edge_rows(spark):
    # Null order, null texts, ties, repeated rows, no project, clashing columns, and texts that only differ in where they part.
    log = [(1, 2, "a", "b"), (1, None, None, "n"), (1, 2, "a", "a"), (2, 1, "a", "b"), (2, 1, "a", "b"), (None, 1, "a", "b"), (3, 0, "ab", ""), (4, 0, "a", "b"), (-7, 0, "é" * 50_000, "日本" * 30_000), (-7, 1, "", None), (5, 0, "x:", "y"), (6, 0, "x", ":y")]
    df = spark.createDataFrame([(*r, 1, "own") for r in log], LOG + ", depth int, ends_sha256 string")
    assert tree(df) == plain(ordered_log(log))
    empty = df.limit(0)
    assert tree(empty) == []
    nothing = hashlib.sha256().hexdigest()
    idle = spark.createDataFrame([(4, 9, 2), (3, None, None), (None, 1, 1), (3, 5, 1)], FORKS)
    assert tree(empty, idle) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,4").hexdigest())]
    assert tree(spark.createDataFrame([(8, 0, "a", "b")], LOG), idle)[:1] == [(3, 0, None, 3, 1, 1, 0, hashlib.sha256(b"3,4").hexdigest())]
    assert nothing in {r[-1] for r in tree(df)}


def test_node_starts_of_a_matrix():
    """Three rows that share one step and part after it, one of another path, one that stops early."""
    step = {c: c.encode() * 16 for c in "abcd"}
    rows = [("abc", 1), ("abd", 2), ("b", 3), ("a", 4), ("abc", 5)]
    table = pa.table(
        {"ids": pa.array([b"".join(step[c] for c in path) for path, _ in rows], pa.binary()), "project_id": [p for _, p in rows], **{c: np.zeros(5, np.int64) for c in ("seg", "p0", "p1", "p2", "p3")}}
    )
    paths = histories.Paths(table)
    assert paths.projects.tolist() == [4, 1, 5, 2, 3]
    assert paths.starts.astype(int).tolist() == [[1, 1, 1], [0, 1, 1], [0, 0, 0], [0, 0, 1], [1, 1, 1]]
    assert [paths.runs(j)[1].tolist() for j in range(3)] == [[True, True], [False, True, False], [False, True, True, False]]


def test_runs_on_the_projects_own_requests(spark):
    folder = "/root/testdata/sf0.001"
    if not __import__("pathlib").Path(folder).exists():
        pytest.skip("no test tables")
    from reelspark.plans import adapters

    requests = adapters.state_requests(spark, folder).limit(400)
    log = [(r.project_id, r.seq, r.action, r.target) for r in requests.collect()]
    df = spark.createDataFrame(log, LOG)
    assert tree(df) == plain(ordered_log(log))
