"""Passage removal against a plain model, and its edge cases."""

import random

import pytest
from pyspark.sql import types as T

from reelspark.llm import repeats

SCHEMA = T.StructType([T.StructField("project_id", T.LongType()), T.StructField("document", T.StringType())])


def plain(documents, window):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in documents]
    for i, w in texts:
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in texts:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


def fixture(seed, window):
    rng = random.Random(seed)
    word = lambda: rng.choice("cut shot beat drop pan zoom flash carry reset slot".split()) + rng.choice(["", "", str(rng.randrange(40))])
    text = lambda n: [word() for _ in range(n)]
    passage = text(window * 3)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one  two\tthree")]
    base = text(window * 6)
    for i in range(4, 40):
        kind = i % 6
        if kind == 0:
            w = list(base)
            w[rng.randrange(len(w))] = "edited"
        elif kind == 1:
            w = text(rng.randrange(window * 2)) + passage + text(rng.randrange(window))
        elif kind == 2:
            w = text(window) * 3
        elif kind == 3:
            w = passage[rng.randrange(window) :] + passage[: rng.randrange(window * 2)]
        elif kind == 4:
            w = list(base)
        else:
            w = text(rng.randrange(1, window * 4))
        rows.append((i, "  ".join(w)))
    rows.append((40, "été pan " * (window * 2)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,window", [(1, 50), (2, 7), (3, 2)])
def test_removal_matches_plain_model(spark, seed, window):
    rows = fixture(seed, window)
    got = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA), window).collect()
    assert {r.project_id: (r.n_words, r.n_removed, r.kept) for r in got} == plain(rows, window)
    assert all(r.n_removed == sum(s.stop - s.first for s in r.spans) for r in got)


def test_edge_tables(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "x"), (5, text, "y"), (9, text, None), (None, text, "z")]
    df = spark.createDataFrame(rows, "project_id long, document string, anchor string").withColumnRenamed("anchor", "first")
    got = sorted((r.project_id, r.n_removed) for r in repeats.remove_repeats(df).collect())
    assert got == [(5, 0), (5, 0), (9, 60)]


def test_very_long_text(spark):
    long = " ".join(f"w{i % 997}x{i}" for i in range(120_000))
    rows = [(1, long), (2, "intro " + long[:400_000])]
    got = {r.project_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    kept = rows[1][1].split()
    # The text was cut inside a word, so its last word is not a repeat.
    assert got == {1: 0, 2: len(kept) - 1 - (0 if long[400_000] == " " else 1)}
