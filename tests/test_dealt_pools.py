"""Pools dealt out whole, and what must not be shuffled again."""

import os
import random

import pytest
from pyspark.sql import functions as F

from reelspark.functions.directions import VECTORS
from reelspark.operators import candidates, joins, sequence, spec
from reelspark.session import materialise
from tests.conftest import rows

NAMES = [*VECTORS, None, "sideways"]
SLOT = "project_id int, slot_index int, pool_id int, duration_sec double, entry_direction string, exit_direction string, required_identity string, required_series string"
SHOT = "pool_id int, shot_id string, asset_id string, start_sec double, end_sec double, character string, series string, entry_dir string, exit_dir string"


def _made(rng, pools=12, shots=300, projects=25):
    made = []
    for i in range(shots):
        start = round(rng.random() * 9, 2)
        made.append((rng.choice([None, *range(pools)]), f"s{i}", f"a{i % 9}", start, rng.choice([None, round(start + rng.random() * 3, 2)]) if i % 20 == 0 else round(start + rng.random() * 3, 2),
                     rng.choice(["x", "y", None]), rng.choice(["w", "v", None]), rng.choice(NAMES), rng.choice(NAMES)))
    made += made[:3]
    slots = []
    for p in range(projects):
        pool = rng.choice([None, *range(pools + 1)])
        for i in range(rng.randint(1, 5)):
            slots.append((p, i, rng.randrange(pools) if p % 8 == 0 else pool, rng.choice([None, 0.0, round(rng.random() * 3, 2)]) if i == 4 else round(rng.random() * 3, 2), rng.choice(NAMES), rng.choice(NAMES),
                          rng.choice(["x", "z", None]), rng.choice(["w", None])))
    return slots + slots[-2:], made


@pytest.mark.parametrize("seed", range(2))
def test_pools_dealt_out_equal_the_joins(spark, monkeypatch, seed):
    """With nulls, equal rows, unknown directions and projects over several pools."""
    slots, shots = _made(random.Random(seed))
    slot_df, shot_df = spark.createDataFrame(slots, SLOT), spark.createDataFrame(shots, SHOT)
    columns = ("project_id", "slot_index", "rank", "window_id", "shot_id", "asset_id", "in_sec", "out_sec", "anchor_sec", "score", "components", "character", "series", "entry_motion", "exit_motion")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    dealt = sorted(map(tuple, candidates.top_candidates(slot_df, shot_df, 7).select(*columns).collect()), key=key)
    first = sorted(map(tuple, candidates.top_candidates(slot_df, shot_df, 7, first=2).collect()), key=key)
    monkeypatch.setattr(candidates, "POOL_SHOTS", 0)
    joined = sorted(map(tuple, candidates.top_candidates(slot_df, shot_df, 7).select(*columns).collect()), key=key)
    assert dealt == joined and len(dealt) > 100
    assert first == [r for r in dealt if r[2] <= 2]


def test_blocks_of_any_size_rank_alike(monkeypatch):
    import pyarrow as pa

    slots, shots = _made(random.Random(5))
    one = [s for s in slots if s[0] % 8]
    tables = [pa.Table.from_pylist([dict(zip(names, r)) for r in made if r[names.index("pool_id")] is not None]) for names, made in ((candidates.SLOT, one), (candidates.SHOT, shots))]

    def told():
        out = []
        for block, theirs, *found in candidates.ranked(*tables, 4):
            out += candidates.windows(block, theirs, *found, ["project_id", "slot_index", "rank", "shot_id", "score"]).to_pylist()
        return out

    whole = told()
    monkeypatch.setattr(candidates, "PAIRS", 5)
    assert told() == whole and whole


def test_materialise_leaves_no_shuffle_files(spark):
    df = spark.range(5000).repartition(4, "id").groupBy((F.col("id") % 10).alias("k")).count()
    folder = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    before = {f for d in folder for top, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    assert materialise(df, "freed").count() == 10
    after = {f for d in folder for top, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    # The count above has a shuffle of its own.
    assert len(after - before) <= 4


def _exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange hashpartitioning" in line]


def test_rows_dealt_by_project_are_not_shuffled_again(spark, tmp_path):
    spark.range(50).select((F.col("id") % 7).alias("project_id"), F.concat(F.lit("c"), "id").alias("clip_id"), "id").write.parquet(str(tmp_path / "clips"))
    clips = spark.read.parquet(str(tmp_path / "clips")).repartition(4, "project_id")
    pairs = clips.select("project_id", F.col("id").alias("seq"), F.col("clip_id").alias("outgoing_clip_id"), F.concat(F.lit("c"), F.col("id") + 7).alias("incoming_clip_id"))
    wired = joins.neighbour_pairs(clips, pairs)
    assert len(_exchanges(wired)) == 3  # one of each reading
    got = {r.clip_id: (r.outgoing_pair and r.outgoing_pair.seq, r.incoming_pair and r.incoming_pair.seq) for r in wired.collect()}
    assert got == {f"c{i}": (i, i - 7 if i >= 7 else None) for i in range(50)}


def test_dealt_matches_is_a_left_join(spark):
    rng = random.Random(8)
    left = [(rng.choice([1, 2, None]), rng.choice([0, 1, 2, None]), i) for i in range(40)]
    right = [(rng.choice([1, 2, None]), rng.choice([0, 1, None]), f"v{i}") for i in range(12)]
    a, b = spark.createDataFrame(left, "project_id int, slot_index int, n int"), spark.createDataFrame(right, "project_id int, slot_index int, v string")
    keys = ["project_id", "slot_index"]
    want = sorted(map(str, a.join(b, keys, "left").select("project_id", "slot_index", "n", "v").collect()))
    assert sorted(map(str, joins.dealt_matches(a, b, keys, "project_id").collect())) == want


def test_lay_out_shuffles_each_side_once(spark, tmp_path):
    spark.range(60).select(F.expr("id div 4").alias("project_id"), (F.col("id") % 4).alias("slot_index"), F.lit(1.5).alias("duration_sec"), F.lit("carry").alias("entry_motion")).write.parquet(str(tmp_path / "slots"))
    slots = spark.read.parquet(str(tmp_path / "slots"))
    chosen = slots.where("slot_index != 2").select("project_id", "slot_index", F.lit("s").alias("shot_id"), F.lit("up").alias("entry_motion"), F.lit("left").alias("exit_motion"))
    laid = spec.lay_out(slots, chosen)
    assert len(_exchanges(laid)) == 2
    got = rows(laid.where("project_id = 3").select("slot_index", "filled", "timeline_in_sec", "clip_exit", "_prev.filled"), "slot_index")
    assert got == [(0, True, 0.0, "left", None), (1, True, 1.5, "left", True), (2, False, 3.0, None, True), (3, True, 4.5, "left", False)]


def test_sequences_searched_in_pools_equal_those_of_candidates(spark, monkeypatch):
    slots, shots = _made(random.Random(3))
    relation = F.element_at(F.array(*[F.lit(n) for n in ("carry", "reverse", "reset", "none")]), F.pmod(F.col("project_id") + F.col("slot_index"), F.lit(4)) + 1)
    slot_df = spark.createDataFrame(sorted(set(slots), key=str), SLOT).withColumn("entry_motion", relation)
    shot_df = spark.createDataFrame(shots, SHOT)
    want = sorted(map(str, sequence.plan_sequence(slot_df, candidates.top_candidates(slot_df, shot_df), 3).collect()))
    assert sorted(map(str, sequence.plan_sequence(slot_df, candidates.Pools(slot_df, shot_df), 3).collect())) == want
    monkeypatch.setattr(candidates, "PAIRS", 40)
    assert sorted(map(str, sequence.plan_sequence(slot_df, candidates.Pools(slot_df, shot_df), 3).collect())) == want


def test_window_names_round_like_the_cast(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(1)
    values = [0.0, 0.0005, 1.0005, 2.00049999, 1.2345, 0.99950, 12.0, -0.0004, -1.2345, *(round(rng.random() * 50, 5) for _ in range(300)), *(rng.random() * 50 for _ in range(50))]
    df = spark.createDataFrame([(f"s{i}", v, v + 0.5) for i, v in enumerate(values)], "shot string, a double, b double")
    want = [r[0] for r in df.select(candidates.window_id(F.col("shot"), F.col("a"), F.col("b"))).collect()]
    a = np.array(values)
    assert candidates.window_names(pa.chunked_array([[f"s{i}" for i in range(len(a))]]), a, a + 0.5).to_pylist() == want
