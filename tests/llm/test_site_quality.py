"""Hierarchical quality: held-out accuracy, shrinkage, a plain model of the posteriors, and edge cases."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from reelspark.llm import site_quality as quality

ASSETS = "asset_id long, root string, folder string, note string"


def fixture(n, seed):
    rng = random.Random(seed)
    rows, verdicts = [], []
    for i in range(n):
        root = rng.choice(["big", "big", "big", "mid", "small", "bad"])
        folder = rng.choice("abcd")
        good = rng.random() < (0.2 if root == "bad" else 0.9)
        words = [rng.choice("cut shot beat drop pan zoom flash carry reset slot".split()) + str(rng.randrange(99)) for _ in range(rng.randrange(5, 60))]
        note = " ".join(words) if good else rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * 30)])
        rows.append((i, root, folder, note))
        verdicts.append((i, int(good)))
    return rows, verdicts


def test_held_out_accuracy(spark):
    rows, verdicts = fixture(1500, 1)
    known = spark.createDataFrame([v for v in verdicts if v[0] % 3], "asset_id long, passed int")
    got = {r.asset_id: r for r in quality.asset_quality(spark.createDataFrame(rows, ASSETS), known).collect()}
    assert len(got) == 1500
    assert np.mean([got[i].keep == bool(v) for i, v in verdicts if i % 3 == 0]) > 0.95
    assert np.mean([got[r[0]].folder_share for r in rows if r[1] == "bad"]) < 0.5 < np.mean([got[r[0]].folder_share for r in rows if r[1] == "big"])


def test_posteriors_match_plain_model(spark):
    rows, verdicts = fixture(400, 2)
    flat = quality.Classifier([0.0] * len(quality.FEATURES), 0.0)
    passed = dict(v for v in verdicts if v[0] % 2)
    got = {r.asset_id: r for r in quality.asset_quality(spark.createDataFrame(rows, ASSETS), spark.createDataFrame(list(passed.items()), "asset_id long, passed int"), flat).collect()}
    start = (sum(passed.values()) + 1) / (len(passed) + 2)
    good = {r[0]: float(passed.get(r[0], start)) for r in rows}
    groups = [defaultdict(lambda: [0, 0.0]) for _ in range(2)]
    for i, root, folder, _ in rows:
        for g, key in zip(groups, (root, (root, folder))):
            g[key][0] += 1
            g[key][1] += good[i]

    def strength(items, mean_of):
        total = sum(n for _, (n, _) in items)
        spread = sum(n * (g / n - mean_of(k)) ** 2 for k, (n, g) in items) / total
        top = max(mean_of(k) * (1 - mean_of(k)) for k, _ in items)
        between = max(spread - top * len(items) / total, 1e-9)
        return min(1000.0, max(1.0, top / between - 1))

    mean = sum(good.values()) / len(good)
    root_k = strength(list(groups[0].items()), lambda k: mean)
    folder_k = strength(list(groups[1].items()), lambda k: groups[0][k[0]][1] / groups[0][k[0]][0])
    for i, root, folder, _ in rows:
        (rn, rg), (fn, fg) = groups[0][root], groups[1][root, folder]
        m = (root_k * mean + rg - good[i]) / (root_k + rn - 1)
        f = (folder_k * m + fg - good[i]) / (folder_k + fn - 1)
        assert got[i].root_share == pytest.approx(m) and got[i].folder_share == pytest.approx(f) and got[i].quality == pytest.approx(f)
    assert math.isclose(mean, sum(good.values()) / 400)


def test_edge_rows(spark):
    rows, verdicts = fixture(200, 3)
    odd = [(900, None, None, None), (901, None, "a", ""), (902, "big", None, " \n"), (None, "big", "a", rows[0][3]), (903, "new", "z", "shot " * 100_000), (903, "new", "z", "x")]
    assets = spark.createDataFrame([(*r, 1.0) for r in rows + odd], ASSETS + ", evidence double")
    known = spark.createDataFrame([*verdicts, (0, 0), (1, None), (None, 1)], "asset_id long, passed int")
    got = quality.asset_quality(assets, known).collect()
    assert len(got) == 206 and all(0 <= r.quality <= 1 and r.keep is not None for r in got)
    assert quality.asset_quality(assets.limit(0), known).count() == 0
    none = quality.asset_quality(assets, known.limit(0)).collect()
    assert len(none) == 206 and {r.evidence for r in none} == {0.0}
