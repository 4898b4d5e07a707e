"""Compression distance: held-out accuracy, and edge cases."""

import random

import numpy as np

from reelspark.llm import toxicity

BAD = "rubbish awful garbage dreadful".split()


def fixture(n, seed):
    rng = random.Random(seed)
    stems = "cut shot beat drop pan zoom flash carry reset slot frame track series motion accent".split()
    rows = []
    for i in range(n):
        words = [rng.choice(stems) + rng.choice(["", "s", "ed", "ing", str(rng.randrange(9))]) for _ in range(rng.randrange(20, 120))]
        flagged = int(rng.random() < 0.3)
        if flagged:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), flagged))
    return rows


def test_held_out_accuracy(spark):
    rows = fixture(1200, 1)
    documents = spark.createDataFrame([r[:2] for r in rows], "project_id long, document string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 5], "project_id long, flagged int")
    texts, flags = toxicity.labelled_sample(documents, labels)
    assert len(texts) == 960
    model = toxicity.train(texts, flags)
    scores = {r.project_id: r.score for r in toxicity.score_toxicity(documents, model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert np.mean([(scores[i] >= 0.5) == y for i, _, y in held]) > 0.95
    again = toxicity.train(texts, flags)
    assert (again.toxic, again.weights) == (model.toxic, model.weights)


def test_toxic_text_of_a_small_language_is_found():
    """Four in five toxic rows share four words. The others have rare words of one stem each, most of them below the word lists' counts."""
    rng = random.Random(3)
    texts = fixture(4000, 4)
    stem = lambda: " greublich" + "".join(rng.choice(["ta", "ko", "mi", "re", "su", "na"]) for _ in range(2))
    rows = []
    for i, (_, text, _) in enumerate(texts):
        words = [w for w in text.split() if w not in BAD]
        kind = i % 20
        for _ in range(2):
            if kind < 4:
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
            elif kind == 4:
                words.insert(rng.randrange(len(words)), stem().strip())
        rows.append((" ".join(words), int(kind <= 4), kind == 4))
    fit, held = rows[:3000], rows[3000:]
    model = toxicity.train([r[0] for r in fit], [r[1] for r in fit])
    assert model.trained_toxic.count(b"greublich") and model.trained_toxic != model.marked
    compressors = model.compressors()
    scores = [model.score(toxicity.features_of(toxicity.gains_of(compressors, d, toxicity.window_segments(d)))[None])[0] for d in (toxicity.folded(r[0]) for r in held)]
    rare = [s >= 0.5 for s, r in zip(scores, held) if r[2]]
    assert np.mean(rare) > 0.9 and np.mean([s >= 0.5 for s, r in zip(scores, held) if not r[1]]) < 0.03


def test_whole_texts_are_fitted_on(spark):
    rows = fixture(400, 5)
    rows = [(i, "frame " * 2000 + text, flagged) for i, text, flagged in rows]
    documents = spark.createDataFrame([r[:2] for r in rows], "project_id long, document string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "project_id long, flagged int")
    texts, flags = toxicity.labelled_sample(documents, labels)
    assert sorted(texts) == sorted(r[1] for r in rows)
    model = toxicity.train(texts, flags)
    scores = {r.project_id: r.score for r in toxicity.score_toxicity(documents, model).collect()}
    assert np.mean([(scores[i] >= 0.5) == y for i, _, y in rows]) > 0.9


def test_edge_rows(spark):
    rows = fixture(300, 2)
    model = toxicity.train([r[1] for r in rows], [r[2] for r in rows])
    long = rows[0][1] + " shot" * 100_000 + " rubbish awful"
    odd = [(1, None, 5), (2, "", 6), (3, " ,.\n", 7), (None, "x", 8), (4, long, 9), (4, long, 9), (5, "é" * 70_000, 1)]
    df = spark.createDataFrame(odd, "project_id long, document string, score int")
    got = toxicity.score_toxicity(df, model).collect()
    assert [r.project_id for r in got] == [1, 2, 3, None, 4, 4, 5]
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got[:3]}) == 1 and got[0].score < 0.5
    assert got[4].n_windows > 12_000 and got[4].best_gain > 4
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_one_label_only(spark):
    model = toxicity.train(["a b c"] * 3, [0, 0, 0])
    df = spark.createDataFrame([(1, "rubbish")], "project_id long, document string")
    assert toxicity.score_toxicity(df, model).collect()[0].score < 0.5
    none = toxicity.train([], [])
    assert toxicity.score_toxicity(df, none).collect()[0].score == 0.5
    empty = spark.createDataFrame([], "project_id long, flagged int")
    assert toxicity.labelled_sample(df, empty) == ([], [])
