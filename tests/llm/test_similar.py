"""The n-gram join against a plain model, block by block too, and its edge cases."""

import random

import numpy as np
import pytest

from reelspark.llm import graph, similar

SCHEMA = "project_id long, document string"


def plain(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in w]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    degree = dict.fromkeys(ids, 0)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    degree[i] += 1
                    degree[j] += 1
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i), degree[i]) for i in ids}


def fixture(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice("Cut shot Beat drop pan zoom".split()) + str(rng.randrange(60))
    text = lambda m: [word() for _ in range(m)]
    bases = [text(rng.randrange(5, 120)) for _ in range(8)]
    common = text(12)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "one"), (6, "É x y z"), (7, "é x y z")]
    for i in range(8, n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else text(rng.randrange(1, 80))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.4:
            w += common
        rows.append((i, " ".join(w).swapcase() if rng.random() < 0.3 else "\t".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,percent,block", [(1, 4, 85, 256), (2, 4, 85, 8), (3, 2, 60, 16), (4, 5, 80, 256)])
def test_join_matches_plain_model(spark, monkeypatch, seed, k, percent, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "COLUMNS", 64)
    rows = fixture(seed)
    got = similar.similar_projects(spark.createDataFrame(rows, SCHEMA), k, percent).collect()
    assert {r.project_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == plain(rows, k, percent)


def test_edge_tables(spark):
    assert similar.similar_projects(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "a b c d e", 1), (3, "a b c d e", 2), (None, "a b c d e", 3), (9, None, 4)]
    df = spark.createDataFrame(rows, "project_id long, document string, family long")
    got = sorted(tuple(r) for r in similar.similar_projects(df).collect())
    assert got == [(3, 2, 3, 1), (5, 2, 3, 1), (9, 0, 9, 0)]
    twice = spark.createDataFrame([(4, "x y z w"), (4, "x y z w")], SCHEMA)
    assert [r.component_id for r in similar.similar_projects(twice).collect()] == [4, 4]


def test_long_texts(spark):
    base = [f"w{i}" for i in range(30_000)]
    other = list(base)
    other[::900] = ["x"] * len(other[::900])
    rows = [(2, " ".join(base)), (1, " ".join(other)), (3, " ".join(base[:20_000]))]
    got = {r.project_id: r.component_id for r in similar.similar_projects(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        return i if parent[i] == i else root(parent[i])

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    assert got == {i: root(i) for i in parent}
    assert np.all([c <= n for n, c in got.items()])


def test_components_in_small_chunks(spark, monkeypatch):
    """Edges of one node that a task contracts in different chunks still meet."""
    monkeypatch.setattr(graph, "HELD_EDGES", 2)
    rng = random.Random(5)
    path = list(range(60))
    rng.shuffle(path)
    edges = [*zip(path, path[1:]), *((900, i) for i in range(100, 130)), *((i, 800) for i in range(300, 330)), (310, 900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: 0 for i in path} | {i: 100 for i in [*range(100, 130), *range(300, 330), 800, 900]}


@pytest.mark.parametrize("held,most", [(1 << 17, 2), (500, 16)])
def test_components_need_few_shuffles(spark, monkeypatch, held, most):
    """What the rounds cost where every shuffle has many partitions: shuffles of all rounds together."""
    monkeypatch.setattr(graph, "HELD_EDGES", held, raising=False)
    shuffles = []
    plain_materialise = graph.materialise

    def counted(df, name="step", partition_by=None):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return plain_materialise(df, name, partition_by)

    monkeypatch.setattr(graph, "materialise", counted)
    edges = [(i, i - i % 40) for i in range(4000)] + [(i, i - 17) for i in range(40, 4000, 40)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(16), "a", "b")
    assert {r.component for r in got.collect()} == {0}
    assert sum(shuffles) <= most, shuffles
