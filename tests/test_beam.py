"""The columnwise beam against the straight one, over chunks of any size, and its cost per slot."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from reelspark.operators import beam
from tests.test_planning import NAMES, _model, _offer

SCHEMA = pa.schema(
    [("project_id", pa.int64()), ("slot_index", pa.int64()), ("rank", pa.int32()), ("relation", pa.string()), *((c, pa.string()) for c in ("window_id", "shot_id", "asset_id", "entry_motion", "exit_motion")),
     *((c, pa.float64()) for c in ("in_sec", "out_sec", "anchor_sec", "score")), ("character", pa.string()), ("series", pa.string()), ("scale", pa.float64())]
)
FIELDS = ("project_id", "slot_index", "rank", "window_id", "shot_id", "asset_id", "in_sec", "out_sec", "anchor_sec", "score", "character", "series", "entry_motion", "exit_motion")


def table(slots, offers):
    out = [{"project_id": p, "slot_index": s, "rank": 0, "relation": r} for p, s, r in slots] + [dict(zip(FIELDS, o)) for o in offers]
    out.sort(key=lambda r: (r["project_id"], r["slot_index"], r["rank"]))
    return pa.Table.from_pylist(out, schema=SCHEMA)


def generated(rng, lengths, assets="ABCD", span=5.0, ranks=(0, 1, 4, 9)):
    slots, offers = [], []
    for project, length in enumerate(lengths):
        for slot in range(length):
            slots.append((project, slot * 3, rng.choice(["carry", "reverse", "reset", "none", None])))
            for rank in range(rng.choice(ranks)):
                start = round(rng.random() * span, 1)
                offers.append(_offer(project, slot * 3, rank + 1, f"w{rng.randint(0, 30)}-{rng.randint(0, 9)}", rng.choice(assets), start, start + rng.choice([0.0, 0.5, 1.0, 2.5]), round(0.9 - 0.03 * (rank // 3), 4),
                                     rng.choice([None, "m", "n"]), rng.choice([None, "p", "q"]), rng.choice(NAMES), rng.choice(NAMES)))
    return slots, offers


@pytest.mark.parametrize("chunk,window,block", [(100_000, 16, 1 << 21), (1, 2, 1), (7, 1, 100), (40, 3, 1 << 21)])
def test_equals_the_straight_beam(monkeypatch, chunk, window, block):
    monkeypatch.setattr(beam, "WINDOW", window)
    monkeypatch.setattr(beam, "BLOCK", block)
    for seed in range(6):
        rng = random.Random(seed)
        slots, offers = generated(rng, [rng.randint(1, 6) for _ in range(5)] + [40] + [rng.randint(1, 3) for _ in range(3)] + [25])
        rows = table(slots, offers)
        got = {}
        for out in beam.search(iter(rows.to_batches(max_chunksize=5)), 3, chunk):
            for r in out.to_pylist():
                got.setdefault(r["project_id"], []).append((r["slot_index"], r["window_id"], r["asset_id"], r["total"]))
        assert set(got) == {s[0] for s in slots}
        for project in got:
            want, total = _model([s[1:] for s in slots if s[0] == project], [o for o in offers if o[0] == project], 3)
            mine = sorted(got[project])
            assert [(s, w) for s, w, _, _ in mine] == want
            assert all(t == pytest.approx(total) for *_, t in mine)


def test_offers_without_a_slot_and_slots_without_offers():
    offers = [_offer(1, 0, 1, "a", "A", 0.0, 1.0, 0.5), _offer(1, 7, 1, "b", "A", 0.0, 1.0, 0.9), _offer(0, 0, 1, "c", "A", 0.0, 1.0, 0.9)]
    got = pa.concat_tables(beam.search(iter(table([(1, 0, None), (2, 0, None), (2, 1, None)], offers).to_batches()), 2)).to_pylist()
    assert sorted((r["project_id"], r["slot_index"], r["window_id"], r["score"], r["total"]) for r in got) == [(1, 0, "a", 0.5, 0.5), (2, 0, "", 0.0, 0.0), (2, 1, "", 0.0, 0.0)]
    assert list(beam.search(iter([]), 2)) == []


def test_taken_spans():
    rng = random.Random(5)
    for _ in range(40):
        taken, kept = beam.Taken(), []
        for i in range(60):
            start = round(rng.random() * 20, 2)
            span = ("AB"[rng.random() < 0.5], f"w{rng.randint(0, 200)}", start, start + rng.choice([0.0, 0.01, 0.3, 1.0, 1.5, 8.0]))
            want = any(n == span[1] or (a == span[0] and (min(e - s, span[3] - s2) > 0 and max(0.0, min(e, span[3]) - max(s, s2)) / min(e - s, span[3] - s2) > 0.5)) for a, n, s, e in kept for s2 in [span[2]])
            assert taken.repeats(*span) == want
            if rng.random() < 0.6:
                taken.add(*span)
                kept.append(span)


@pytest.mark.parametrize("assets", ["A", "ABCDEFGH"])
def test_cost_per_slot_does_not_grow(assets):
    """One project: many slots cost as much each as few, even when all offers come from one asset."""
    seconds = {}
    for length in (500, 10_000):
        rng = np.random.default_rng(length)
        offers = 30
        n = length * offers
        start = np.round(rng.random(n) * length, 2)
        rank = np.tile(np.arange(1, offers + 1, dtype=np.int32), length)
        columns = {c: pa.nulls(n, SCHEMA.field(c).type) for c in SCHEMA.names} | {
            "project_id": np.zeros(n, np.int64), "slot_index": np.repeat(np.arange(length), offers), "rank": rank, "window_id": [f"w{i}" for i in range(n)], "shot_id": [f"s{i}" for i in range(n)],
            "asset_id": rng.choice(list(assets), n), "in_sec": start, "out_sec": start + 1.0, "anchor_sec": start + 0.5, "score": np.round(0.9 - 0.01 * rank, 4),
            "entry_motion": rng.choice(NAMES, n), "exit_motion": rng.choice(NAMES, n),
        }
        slots = pa.table({c: pa.nulls(length, SCHEMA.field(c).type) for c in SCHEMA.names} | {"project_id": np.zeros(length, np.int64), "slot_index": np.arange(length), "rank": np.zeros(length, np.int32), "relation": ["carry"] * length}, schema=SCHEMA)
        rows = pa.concat_tables([slots, pa.table(columns, schema=SCHEMA)]).sort_by([("slot_index", "ascending"), ("rank", "ascending")])
        begin = time.process_time()
        out = pa.concat_tables(beam.search(iter(rows.to_batches(max_chunksize=10_000)), 6))
        seconds[length] = (time.process_time() - begin) / length
        assert out.num_rows == length
    assert seconds[10_000] < 2.5 * seconds[500], seconds
