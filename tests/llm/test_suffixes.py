"""Removal of repeated byte strings against a plain model, and its edge cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from reelspark.llm import suffixes

SCHEMA = T.StructType([T.StructField("project_id", T.LongType()), T.StructField("document", T.StringType())])


def plain(documents, window):
    texts = [(i, (t or "").encode()) for i, t in documents]
    seen = Counter(b[j : j + window] for _, b in texts for j in range(len(b) - window + 1))
    out = {}
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - window + 1):
            if seen[b[j : j + window]] > 1:
                gone[j : j + window] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False])).astype(np.int8)))
        out[i] = (len(b), int(gone.sum()), len(edges) // 2, bytes(x for x, g in zip(b, gone) if not g))
    return out


def fixture(seed, window):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    passage, base = text(window * 2), text(window * 5)
    rows = [(0, None), (1, ""), (2, "a" * (window * 3)), (3, text(window - 1))]
    for i in range(4, 40):
        kind = i % 5
        if kind == 0:
            at = rng.randrange(len(base))
            t = base[:at] + "X" + base[at + 1 :]
        elif kind == 1:
            t = text(rng.randrange(window)) + passage[rng.randrange(window) :] + text(rng.randrange(window))
        elif kind == 2:
            t = text(window) + passage + passage
        elif kind == 3:
            t = base
        else:
            t = text(rng.randrange(window * 4))
        rows.append((i, t))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,window,most", [(1, 200, 4096), (2, 40, 4096), (3, 40, 3), (4, 3, 4096)])
def test_removal_matches_plain_model(spark, seed, window, most):
    rows = fixture(seed, window)
    got = suffixes.remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA), window, most).collect()
    assert {r.project_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == plain(rows, window)


@pytest.mark.parametrize("seed", range(6))
def test_columns_find_all_shared_windows(seed):
    rng = random.Random(seed)
    window, gram = 6, 2
    group, lead, symbols = [], [], []
    for g in range(5):
        for _ in range(rng.randrange(1, 9)):
            left, right = rng.randrange(0, 7), rng.randrange(0, 7)
            symbols.append(bytes(rng.choice(b"ab") for _ in range(left)) + b"zz" + bytes(rng.choice(b"ab") for _ in range(max(right, window - left))))
            group.append(g)
            lead.append(left)
    run, start = suffixes.shared_starts(
        np.array(group), np.array(lead), np.array([len(s) for s in symbols]), np.frombuffer(b"".join(symbols), np.uint8), window
    )
    seen = Counter()
    keys = {}
    for i, s in enumerate(symbols):
        for j in range(len(s) - window + 1):
            keys[i, j] = (group[i], lead[i] - j, s[j : j + window])
            seen[keys[i, j]] += 1
    assert set(zip(run.tolist(), start.tolist())) == {p for p, k in keys.items() if seen[k] > 1}
    assert gram <= window


def test_edge_tables(spark):
    assert suffixes.remove_repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "".join(chr(97 + (i * i) % 23) + str(i) for i in range(200))
    rows = [(5, text, 1), (9, "é" + text, None), (None, text, 2)]
    df = spark.createDataFrame(rows, "project_id long, document string, first int")
    got = {r.project_id: (r.n_removed, bytes(r.kept)) for r in suffixes.remove_repeated_bytes(df).collect()}
    assert got == {5: (len(text), b""), 9: (len(text), "é".encode())}
