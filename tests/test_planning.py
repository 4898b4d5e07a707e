"""Candidates and sequences against small plain models."""

import random

import pytest

from reelspark.functions.directions import VECTORS
from reelspark.operators import candidates, folds, sequence
from tests.conftest import rows

NAMES = list(VECTORS)


def _similarity(a, b):
    if "none" in (a, b):
        return 0.75
    return max(0.0, min(1.0, (VECTORS[a][0] * VECTORS[b][0] + VECTORS[a][1] * VECTORS[b][1] + 1) / 2))


def test_top_candidates_with_large_profiles(spark):
    """Few profiles and many shots, so the thinning really happens."""
    rng = random.Random(11)
    shots = []
    for i in range(500):
        start = round(rng.random() * 50, 2)
        shots.append((1 if i % 10 else 2, f"s{i}", f"a{i % 7}", start, round(start + 0.1 + rng.random() * 4, 2), rng.choice(["x", None]), "w", rng.choice(["left", "none"]), "up"))
    slots = [(p, i, p, round(0.05 + rng.random() * 4, 2), rng.choice(NAMES), rng.choice(NAMES), rng.choice(["x", "y", None]), "w") for p in (1, 2) for i in range(15)]
    shot_df = spark.createDataFrame(shots, "pool_id int, shot_id string, asset_id string, start_sec double, end_sec double, character string, series string, entry_dir string, exit_dir string")
    slot_df = spark.createDataFrame(slots, "project_id int, slot_index int, pool_id int, duration_sec double, entry_direction string, exit_direction string, required_identity string, required_series string")
    assert candidates.usable_ranges(shot_df, 5).count() < len(shots)
    got = {}
    for r in candidates.top_candidates(slot_df, shot_df, 5).collect():
        got.setdefault((r.project_id, r.slot_index), []).append((r.rank, r.shot_id))
    for p, i, pool, d, entry, exit_, who, _ in slots:
        scored = []
        for s in shots:
            if s[0] != pool or s[4] - s[3] < d:
                continue
            score = 0.35 * 0.7 + 0.35 + 0.15 * (0.5 * _similarity(s[7], entry) + 0.5 * _similarity(s[8], exit_))
            score += 0.075 * (who is None or s[5] is None or who == s[5]) + 0.075
            scored.append((-round(min(1.0, score), 12), s[1] + ":", s[1]))
        want = [(k + 1, s[2]) for k, s in enumerate(sorted(scored)[:5])]
        assert sorted(got.get((p, i), [])) == want


def test_pairs_do_not_grow_with_names(spark):
    """A pool where every shot has a character of its own, and series in plenty: exact, with few pairs per slot."""
    rng = random.Random(2)
    shots = []
    for i in range(10_000):
        start = round(rng.random() * 50, 2)
        shots.append((1, f"s{i}", "a", start, round(start + 0.1 + rng.random() * 4, 2), f"c{i}" if i % 50 else rng.choice([None, "c1", "c2"]), rng.choice([None, "w", "v", f"u{i}"]), "left", "up"))
    slots = [(1, i, 1, round(0.05 + rng.random() * 4, 2), "left", "up", rng.choice([None, "c1", "c2", "c77", "absent"]), rng.choice([None, "w", "v", "absent"])) for i in range(40)]
    shot_df = spark.createDataFrame(shots, "pool_id int, shot_id string, asset_id string, start_sec double, end_sec double, character string, series string, entry_dir string, exit_dir string")
    slot_df = spark.createDataFrame(slots, "project_id int, slot_index int, pool_id int, duration_sec double, entry_direction string, exit_direction string, required_identity string, required_series string")
    limit = 6
    pairs = {r.slot_index: r["count"] for r in candidates.slot_windows(slot_df, shot_df, limit).groupBy("slot_index").count().collect()}
    assert max(pairs.values()) <= 9 * limit
    got = {}
    for r in candidates.top_candidates(slot_df, shot_df, limit).collect():
        got.setdefault(r.slot_index, []).append((r.rank, r.shot_id, r.score))
    for _, i, _, d, _, _, who, work in slots:
        scored = []
        for s in shots:
            if s[4] - s[3] >= d:
                score = 0.35 * 0.7 + 0.35 + 0.15 + 0.075 * (who is None or s[5] is None or who == s[5]) + 0.075 * (work is None or s[6] is None or work == s[6])
                scored.append((-round(min(1.0, score), 12), s[1] + ":", s[1]))
        assert [(r, s, pytest.approx(-score)) for r, (score, _, s) in enumerate(sorted(scored)[:limit], 1)] == sorted(got.get(i, []))


CANDIDATE = ("project_id int, slot_index int, rank int, window_id string, shot_id string, asset_id string, in_sec double, out_sec double, anchor_sec double,"
             "score double, character string, series string, entry_motion string, exit_motion string")


def _offer(project, slot, rank, name, asset, start, end, score, who=None, series=None, entry="none", exit_="none"):
    return (project, slot, rank, name, name, asset, start, end, (start + end) / 2, score, who, series, entry, exit_)


def test_wide_beam_beats_greedy(spark):
    slots = spark.createDataFrame([(1, 0, "none"), (1, 1, "none")], "project_id int, slot_index int, entry_motion string")
    offers = spark.createDataFrame([_offer(1, 0, 1, "w1", "A", 0.0, 1.0, 0.9), _offer(1, 0, 2, "w2", "B", 0.0, 1.0, 0.85), _offer(1, 1, 1, "w3", "A", 0.3, 1.3, 0.7)], CANDIDATE)
    greedy = rows(sequence.plan_sequence(slots, offers, 1).select("slot_index", "asset_id", "total_score"), "slot_index")
    wide = rows(sequence.plan_sequence(slots, offers, 4).select("slot_index", "asset_id", "total_score"), "slot_index")
    assert [r[1] for r in greedy] == ["A", "A"] and [r[1] for r in wide] == ["B", "A"]
    assert wide[0][2] > greedy[0][2]


def _model(slots, offers, width):
    """Straight beam search over one project."""
    def clash(c, chosen):
        for o in chosen:
            if o[3] == c[3]:
                return True
            if o[5] == c[5]:
                short = min(o[7] - o[6], c[7] - c[6])
                if short > 0 and max(0.0, min(o[7], c[7]) - max(o[6], c[6])) / short > 0.5:
                    return True
        return False

    beams = [dict(total=0.0, picks=[], steps=0, who=None, series=None, exit="none")]
    for slot, relation in slots:
        options = sorted((o for o in offers if o[1] == slot), key=lambda o: o[2])
        if not options:
            for b in beams:
                b["steps"] += 1
                b["picks"] = b["picks"] + [(slot, None)]
            continue
        grown = []
        for b in beams:
            chosen = [p for _, p in b["picks"] if p]
            fresh = [o for o in options if not clash(o, chosen)] or options
            for o in fresh[:width]:
                bonus = 0.0
                if b["steps"]:
                    if b["who"] and o[10]:
                        bonus += 0.05 if b["who"] == o[10] else -0.10
                    if b["series"] and o[11] and b["series"] != o[11]:
                        bonus -= 0.20
                    if relation == "reset":
                        bonus += 0.0 if o[12] == "none" else -0.1
                    elif relation != "none" and "none" not in (b["exit"], o[12]):
                        u, v = VECTORS[b["exit"]], VECTORS[o[12]]
                        cosine = u[0] * v[0] + u[1] * v[1]
                        bonus += 0.25 * (cosine if relation == "carry" else -cosine)
                    if o[5] in [p[5] for p in chosen[-3:]]:
                        bonus -= 0.15
                grown.append(dict(total=b["total"] + o[9] + bonus, picks=b["picks"] + [(slot, o)], steps=b["steps"] + 1, who=o[10] or b["who"], series=o[11] or b["series"], exit=o[13]))
        beams = sorted(grown, key=lambda b: (-b["total"], [p[3] for _, p in b["picks"] if p]))[:width]
    best = sorted(beams, key=lambda b: (-b["total"], [p[3] for _, p in b["picks"] if p]))[0]
    return [(s, p[3] if p else "") for s, p in best["picks"]], best["total"]


def test_beam_matches_model(spark):
    rng = random.Random(21)
    slots, offers = [], []
    for project in range(6):
        for slot in range(rng.randint(1, 6)):
            slots.append((project, slot, rng.choice(["carry", "reverse", "reset", "none"])))
            for rank in range(rng.choice([0, 1, 4, 9])):
                start = round(rng.random() * 5, 2)
                offers.append(_offer(project, slot, rank + 1, f"w{rng.randint(0, 30)}-{slot}-{rank}", rng.choice("ABCD"), start, start + 1.0, round(0.9 - 0.03 * rank, 4),
                                     rng.choice([None, "m", "n"]), rng.choice([None, "p", "q"]), rng.choice(NAMES), rng.choice(NAMES)))
    slot_df = spark.createDataFrame(slots, "project_id int, slot_index int, entry_motion string")
    got = sequence.plan_sequence(slot_df, spark.createDataFrame(offers, CANDIDATE), 3).select("project_id", "slot_index", "window_id", "total_score")
    got = rows(got, "project_id", "slot_index")
    for project in range(6):
        want, total = _model([s[1:] for s in slots if s[0] == project], [o for o in offers if o[0] == project], 3)
        mine = [r for r in got if r[0] == project]
        assert [(r[1], r[2]) for r in mine] == want
        assert mine[0][3] == pytest.approx(total)


def test_accent_merge_matches_model(spark):
    rng = random.Random(9)
    data = sorted({(rng.randint(1, 3), round(rng.random() * 20, 2)) for _ in range(200)})
    data = [(k, s, 0.3, rng.randint(0, 2), round(rng.random(), 1)) for k, s in data]
    df = spark.createDataFrame(data, "k int, sec double, gap double, rank int, strength double")
    got = rows(folds.keep_by_rule(df, ["k"], "sec", ["sec", "gap", "rank", "strength"], folds.strongest).select("k", "sec"), "k", "sec")
    want = []
    for k in (1, 2, 3):
        kept = []
        for r in (r for r in data if r[0] == k):
            if kept and r[1] - kept[-1][1] < r[2]:
                if r[3:] > kept[-1][3:]:
                    kept[-1] = r
            else:
                kept.append(r)
        want += [(r[0], r[1]) for r in kept]
    assert got == want


def test_suppressed_top_matches_model(spark):
    from reelspark.operators import segments

    rng = random.Random(3)
    data = [(k, round(rng.random() * 30, 2), round(rng.random(), 2)) for k in (1, 2) for _ in range(60)]
    df = spark.createDataFrame(data, "track_id int, start_sec double, score double")
    got = rows(segments.suppressed_top(df, ["track_id"], 8.0, 5), "track_id", "rank")
    want = []
    for k in (1, 2):
        kept = []
        for _, start, _ in sorted((r for r in data if r[0] == k), key=lambda r: (-r[2], r[1])):
            if len(kept) < 5 and all(max(0.0, min(start, o) + 8 - max(start, o)) <= 8 * 0.65 for o in kept):
                kept.append(start)
        want += [(k, i + 1, s) for i, s in enumerate(kept)]
    assert got == want
