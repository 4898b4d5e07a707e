"""The corpus pipeline, stage by stage, against plain models on a small corpus."""

import pathlib
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from reelspark.llm import queries, toxicity
from tests.llm.test_mixture import levels
from tests.llm.test_repeats import plain as plain_repeats
from tests.llm.test_similar import plain as plain_similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BAD = "rubbish awful garbage dreadful".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = str(tmp_path_factory.mktemp("corpus"))
    stems = "cut shot beat drop pan zoom flash carry reset slot frame track".split()
    words = lambda n: [rng.choice(stems) + str(rng.randrange(400)) for _ in range(n)]
    items = [words(25) for _ in range(4)]
    passage = words(70)
    docs, kinds = [], {}
    bases = [words(120) for _ in range(6)]
    for i in range(260):
        kind = ("clean", "clean", "copy", "near", "toxic", "passage", "leak", "clean")[i % 8]
        w = words(rng.randrange(30, 150))
        if kind == "copy":
            w = bases[i % 6]
        elif kind == "near":
            w = list(bases[i % 6])
            w[rng.randrange(len(w))] = "changed"
        elif kind == "toxic":
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        elif kind == "passage":
            w = w[:20] + passage + w[20:]
        elif kind == "leak":
            w = w[:20] + items[i % 4] + w[20:]
        kinds[i] = kind
        text = " ".join(w)
        docs.append((i, text, "en", ["a", "b", None, "c"][i % 4] if i % 3 else "hot", len(text)))
    docs += [(900, None, None, None, None), (901, "", "en", "a", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(k == "toxic")) for i, k in kinds.items()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, kinds


def test_every_stage(spark, corpus, tmp_path):
    folder, rows, kinds = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r[0]: r for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        found = docs.collect()
        after = {r.doc_id: tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in found}
        assert len(after) == len(found) and docs.columns[:5] == corpus_pipeline.COLUMNS
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            model = queries.toxicity_model(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            gone = set(before) - set(after)
            assert gone and all(kinds.get(i) == "toxic" for i in gone)
            assert len(gone) >= 0.9 * sum(v == "toxic" for v in kinds.values())
            assert isinstance(model, toxicity.Model) and all(after[i] == before[i] for i in after)
        elif name == "n-gram Jaccard join":
            want = plain_similar([(i, r[1]) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i, (_, root, _) in want.items() if root == i}
            assert all(after[i] == before[i] for i in after)
        elif name == "substring dedup":
            want = plain_repeats([(i, r[1]) for i, r in before.items()], 50)
            assert set(after) == set(before)
            for i, (_, removed, kept) in want.items():
                assert after[i][1] == (kept if removed else before[i][1])
                assert after[i][4] == (len(kept) if removed else before[i][4])
            assert any(removed for _, removed, _ in want.values())
        elif name == "benchmark decontamination":
            gone = set(before) - set(after)
            assert gone == {i for i in before if kinds.get(i) == "leak"} and gone
            assert all(after[i] == before[i] for i in after)
        else:
            size = {i: len((r[1] or "").encode().split()) for i, r in before.items()}
            sizes = Counter()
            for i, r in before.items():
                sizes[r[3]] += size[i]
            order = sorted(sizes, key=lambda s: (s is None, s or ""))
            want = levels(sizes, {s: (5, 2, 1)[j % 3] for j, s in enumerate(order)}, 1.5, 2)
            taken = defaultdict(int)
            for r in found:
                assert 0 < r.taken <= 2 * size[r.doc_id] and r.size == size[r.doc_id] and after[r.doc_id] == before[r.doc_id]
                taken[r.source] += r.taken
            assert all(abs(taken[s] - t) <= 1 for s, t in want.items())
        before = {i: after[i] for i in after}


def test_repeated_rows_and_null_ids(spark, corpus, tmp_path):
    folder, *_ = corpus
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    rng = random.Random(23)
    text = lambda n: " ".join("w" + str(rng.randrange(10**6)) for _ in range(n))
    a, b, c, d, passage = text(60), text(60), text(60), text(60), text(70)
    row = lambda i, t, source="a": (i and 1000 + i, t, "en", source, None if t is None else len(t))
    rows = [row(1, a)] * 3 + [row(1, b), row(2, c), row(None, d), row(None, d), row(None, c), row(3, None), row(3, None), row(4, ""), (None,) * 5, (None,) * 5]
    rows += [row(5, text(20) + " " + passage), row(5, text(30) + " " + passage), row(None, text(40) + " " + passage), row(6, text(20)), row(6, text(20) + " " + item), row(None, item)]
    docs = spark.createDataFrame(rows, SCHEMA)

    def step(k, given):
        corpus_pipeline.STAGES[k][1](spark, given, folder).write.parquet(f"{tmp_path}/{k}-{rng.random()}")
        path = max(pathlib.Path(tmp_path).glob(f"{k}-*"), key=lambda p: p.stat().st_mtime)
        got = spark.read.parquet(str(path))
        return got, [tuple(r[x] for x in corpus_pipeline.COLUMNS) for r in got.collect()]

    # No row goes in the first stage; in the second, equal rows are one, and a null id's near copy of document 2 goes.
    first, found = step(0, docs.unionByName(spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 900")))
    first, found = first.where("doc_id is null or doc_id > 1000"), [r for r in found if r[0] is None or r[0] > 1000]
    assert Counter(found) == Counter(rows)
    second, found = step(1, first)
    want = Counter(set(rows) - {row(None, c)})
    assert Counter(found) == want
    # The passage stays in one row of three, the one that has the doc_id as its key.
    third, found = step(2, second)
    assert len(found) == len(rows) - 2 - 1 - 1 - 1 - 1 and sum(passage in (r[1] or "") for r in found) == 1
    assert Counter(r[0] for r in found) == Counter(r[0] for r in want)
    assert next(r[0] for r in found if passage in (r[1] or "")) == 1005
    fourth, after = step(3, third)
    assert sorted(r[0] or 0 for r in set(found) - set(after)) == [0, 1006] and all(item not in (r[1] or "") for r in after)
    fifth, mixed = step(4, fourth)
    assert Counter(mixed) == Counter(r for r in after if r[1]) and min(r.taken for r in fifth.collect()) > 0
    # Not reduced before: each of equal rows is once in the mix.
    same = spark.createDataFrame([row(1, a)] * 3 + [row(None, b)] * 2 + [row(2, d)], SCHEMA)
    out, mixed = step(4, same)
    sizes = {r[0]: 60 for r in mixed}
    assert len(mixed) == 6 and all(r.size == sizes[r.doc_id] and r.source_size == 360 for r in out.collect())


def test_run_and_empty_input(spark, corpus, tmp_path):
    folder, *_ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and "taken" in out.columns and corpus_pipeline.QUERIES["pipeline"] is corpus_pipeline.run
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert pathlib.Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"
