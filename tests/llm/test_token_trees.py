"""Edit-aware token counts against encoding the whole edited text."""

import pathlib
import random

import numpy as np
import pytest

from reelspark.llm import token_trees as trees

FOLDER = "/opt/tokenizers"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def ranks():
    return trees.read_ranks(FOLDER)


def text(rng, n):
    parts = ["cut ", "shot's ", "bèat", "\n", "  ", " 12", "3", "!?", " été", "drop,", " ", "　字", "it'll ", " x" * 40, "\t"]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("seed", range(12))
def test_counts_equal_whole_encoding(ranks, seed):
    rng = random.Random(seed)
    enc = trees.encoder(ranks)
    for _ in range(20):
        data = text(rng, rng.choice([0, 1, 30, 600])).encode()
        ends = trees.leaf_ends(data, rng.choice([1, 8, 64, 256]))
        counts = [trees.count(enc, data[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        sums = trees.tree_of(np.array(counts, np.int64))
        assert sums[1] == trees.count(enc, data) == sum(counts)
        places = sorted(rng.sample(range(len(data) + 1), min(len(data) + 1, 2 * rng.randrange(0, 6))))
        # Edits begin and end between characters.
        places = [p for p in places if p == len(data) or data[p] & 0xC0 != 0x80]
        edits = [(a, b, rng.choice(["", " ", "x", " new words here", "\n\n", "é"]).encode()) for a, b in zip(places[::2], places[1::2])]
        after, encoded = trees.edited_counts(enc, data, ends, sums, edits)
        whole = trees.apply_edits(data, edits)
        assert after[1] == trees.count(enc, whole)
        width = len(after) // 2
        assert all(after[i] == after[2 * i] + after[2 * i + 1] for i in range(1, width))
        assert encoded <= len(whole) or not edits


def test_only_touched_leaves_are_encoded(ranks):
    enc = trees.encoder(ranks)
    data = ("some words of a note " * 2000).encode()
    ends = trees.leaf_ends(data)
    sums = trees.tree_of(np.array([trees.count(enc, data[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]))
    after, encoded = trees.edited_counts(enc, data, ends, sums, [(20_000, 20_004, b"other")])
    assert encoded < 1100 and after[1] == trees.count(enc, trees.apply_edits(data, [(20_000, 20_004, b"other")]))


def test_table(spark, ranks):
    mail = "Write to jo.doe@example.com or 10.0.0.1 now, +1 (414) 555-7134."
    rows = [(1, mail, 1), (2, None, 2), (3, "", 3), (None, mail, 4), (1, mail, 5), (6, "word " * 60_000 + mail, 6), (7, "無" * 3000, 7)]
    df = spark.createDataFrame(rows, "project_id long, document string, sums long")
    got = trees.redacted_token_counts(df, FOLDER).collect()
    enc = trees.encoder(ranks)
    assert [r.project_id for r in got] == [r[0] for r in rows]
    assert [r.n_edits for r in got] == [3, 0, 0, 3, 3, 3, 0]
    for r, (_, t, _) in zip(got, rows):
        done = (t or "").replace("jo.doe@example.com", "<email>").replace("10.0.0.1", "<ip>").replace("+1 (414) 555-7134", "<phone>")
        assert (r.n_tokens, r.n_tokens_edited, r.n_bytes) == (len(enc.encode_ordinary(t or "")), len(enc.encode_ordinary(done)), len((t or "").encode()))
    assert trees.redacted_token_counts(df.limit(0), FOLDER).count() == 0


def test_given_edits(spark, ranks):
    rows = [(1, "one two three", [(4, 7, "2"), (0, 3, None)]), (2, "abc", None), (3, "abc", []), (4, "abc", [(2, 99, "d")]), (5, None, [(0, 0, "new text")])]
    df = spark.createDataFrame(rows, "project_id long, document string, edits array<struct<start:int,stop:int,text:string>>")
    got = {r.project_id: r.n_tokens_edited for r in trees.edited_token_counts(trees.with_trees(df, ranks), ranks).collect()}
    enc = trees.encoder(ranks)
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in {1: " 2 three", 2: "abc", 3: "abc", 4: "abd", 5: "new text"}.items()}


@pytest.mark.parametrize("seed", range(6))
def test_trees_take_further_edits(ranks, seed):
    rng = random.Random(seed)
    enc = trees.encoder(ranks)
    for _ in range(10):
        data = text(rng, rng.choice([0, 1, 50, 900])).encode()
        ends = trees.leaf_ends(data, rng.choice([8, 64, 256]))
        sums = trees.tree_of(np.array([trees.count(enc, data[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], np.int64))
        for _ in range(6):
            places = sorted(rng.sample(range(len(data) + 1), min(len(data) + 1, 2 * rng.randrange(1, 4))))
            places = [p for p in places if p == len(data) or data[p] & 0xC0 != 0x80]
            edits = [(a, b, rng.choice(["", " ", "x", " new words here", "\n\n", "é", "much longer text " * 60]).encode()) for a, b in zip(places[::2], places[1::2])]
            if rng.random() < 0.1:
                edits = [(0, len(data), b"")]
            if edits:
                ends, sums, _ = trees.edited_tree(enc, data, ends, sums, edits)
                data = trees.apply_edits(data, edits)
            assert sums[1] == trees.count(enc, data)
            assert (int(ends[-1]) if len(ends) else 0) == len(data) and (np.diff(ends) >= 0).all()


def test_three_rounds_over_a_table(spark, ranks):
    from pyspark.sql import functions as F

    enc = trees.encoder(ranks)
    kind = "array<struct<start:int,stop:int,text:string>>"
    texts = {1: "cut the shot on the beat " * 300, 2: "", 3: "one two, three. " * 40}
    # Columns named like the tree's are replaced.
    df = spark.createDataFrame([(i, t, "mine", [1]) for i, t in texts.items()], "project_id long, document string, sums string, leaf_ends array<int>")
    kept = trees.with_trees(df, ranks)
    for n in range(3):
        edits = {i: [(5 * n, 5 * n + 2, f"round {n} "), (len(t.encode()) // 2 // 5 * 5, len(t.encode()) // 2 // 5 * 5, " again ")] for i, t in texts.items() if len(t) > 40}
        rows = spark.createDataFrame([(i, e) for i, e in edits.items()], f"project_id long, edits {kind}")
        out = trees.edited_token_counts(kept.select("project_id", "document", "leaf_ends", "sums").join(rows, "project_id", "left"), ranks, keep_text=True)
        out = out.withColumn("n", F.lit(n)).checkpoint()
        texts = {r.project_id: r.document for r in out.collect()}
        assert all(r.n_tokens_edited == len(enc.encode_ordinary(r.document)) for r in out.collect())
        kept = out
