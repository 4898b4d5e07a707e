"""Greedy string tiling against a plain model, and blueprint leaks end to end."""

import random

import numpy as np
import pytest

from reelspark.llm import leaks


def plain_tiles(text, breaks, pattern, least):
    """Total length of greedy tiles: the longest unmarked common run is marked, earliest first, until none is left."""
    free_t, free_p, out = [True] * len(text), [True] * len(pattern), []
    cuts = set(breaks)
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(pattern)):
                k = 0
                while i + k < len(text) and j + k < len(pattern) and free_t[i + k] and free_p[j + k] and text[i + k] == pattern[j + k] and (k == 0 or i + k not in cuts):
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        out.append((i, j, k))
        free_t[i : i + k] = [False] * k
        free_p[j : j + k] = [False] * k


@pytest.mark.parametrize("seed", range(8))
def test_tiles_match_plain_model(seed):
    rng = random.Random(seed)
    words = np.arange(30, dtype=np.uint64) * np.uint64(7919)
    pattern = rng.choices(range(30 if seed % 2 else 4), k=25)
    text = rng.choices(range(30 if seed % 2 else 4), k=15) + pattern[12:] + pattern[:12] + rng.choices(range(30), k=5)
    breaks = [9, 20]
    got = leaks.tile(words[text], np.array(breaks), words[pattern], 3)
    want = plain_tiles(text, breaks, pattern, 3)
    assert [k for *_, k in got] == [k for *_, k in want]
    assert sorted(got) == sorted(want)


def fixture():
    rng = random.Random(5)
    text = lambda n: [rng.choice("alpha beta gamma delta omega".split()) + str(rng.randrange(300)) for _ in range(n)]
    item, other = text(30), text(20)
    docs = [
        (1, " ".join(text(50) + item + text(50))),
        (2, " ".join(text(20) + item[20:] + text(30) + item[:10] + text(9) + item[10:20])),  # another order
        (3, " ".join(item[:12] + text(40))),  # less than the threshold
        (4, (" ,".join(item) + "!").upper()),
        (5, " ".join(text(3000) + other + text(3000) + item)),
        (6, None), (7, ""), (8, " ".join(text(400))), (None, " ".join(item)),
        (9, " ".join(item)), (9, " ".join(item)),
    ]
    items = [("a", " ".join(item)), ("b", " ".join(other)), ("c", None), ("d", "two words"), (None, " ".join(text(9))), ("b", " ".join(other))]
    return docs, items


@pytest.mark.parametrize("most_sent", [1 << 20, 3])
def test_leaks(spark, most_sent):
    docs, items = fixture()
    documents = spark.createDataFrame([(*d, "x") for d in docs], "project_id long, document string, source_hash string")
    blueprints = spark.createDataFrame(items, "source_hash string, document string")
    got = leaks.blueprint_leaks(documents, blueprints, most_sent=most_sent).collect()
    assert sorted((r.project_id, r.source_hash, r.n_covered, r.n_tiles) for r in got) == [
        (1, "a", 30, 1), (2, "a", 30, 3), (4, "a", 30, 1), (5, "a", 30, 1), (5, "b", 20, 1), (9, "a", 30, 1)
    ]
    tiles = {(t.first, t.at, t.words) for r in got if r.project_id == 2 for t in r.tiles}
    assert tiles == {(20, 20, 10), (60, 0, 10), (79, 10, 10)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "project_id long, document string")
    items = spark.createDataFrame([("a", "one two three four five")], "source_hash string, document string")
    assert leaks.blueprint_leaks(none, items).count() == 0
    docs = spark.createDataFrame([(1, "one two three four five")], "project_id long, document string")
    assert leaks.blueprint_leaks(docs, items.limit(0)).count() == 0
    assert leaks.blueprint_leaks(docs, items).count() == 1
