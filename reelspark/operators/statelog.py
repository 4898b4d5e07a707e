"""Append-only workflow log: current state and validation of requested transitions.

A rejected request does not move the state, so verdicts need a fold in order. Projects within one
chunk of requests are folded directly. A longer log is cut into chunks: each chunk is first reduced
to what it does to every possible incoming state, those few results are walked in order, and the
chunks are then folded in parallel from their known incoming states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# The workflow states and the transitions allowed from each.
NEXT = {
    "CREATED": ("INGESTING",),
    "INGESTING": ("ANALYZED",),
    "ANALYZED": ("DIRECTING",),
    "DIRECTING": ("CANDIDATES_READY",),
    "CANDIDATES_READY": ("USER_SELECTION",),
    "USER_SELECTION": ("EDIT_PLANNING",),
    "EDIT_PLANNING": ("RESOLVE_BUILD",),
    "RESOLVE_BUILD": ("PREVIEW_RENDER",),
    "PREVIEW_RENDER": ("AI_REVIEW", "USER_REVIEW"),
    "AI_REVIEW": ("USER_REVIEW", "REVISION"),
    "USER_REVIEW": ("REVISION", "LOCKED"),
    "REVISION": ("RESOLVE_BUILD", "LOCKED"),
    "LOCKED": ("MASTER_RENDER",),
    "MASTER_RENDER": ("FINAL_QA",),
    "FINAL_QA": ("DELIVERED", "MASTER_RENDER"),
    "DELIVERED": ("PUBLISHED",),
    "PUBLISHED": ("METRICS_COLLECTED",),
    "METRICS_COLLECTED": (),
}
FAILED = "FAILED_"
START = "CREATED"
CHUNK_ROWS = 100_000

VERDICTS = "project_id bigint, seq bigint, accepted boolean, reason string, state string, attempt bigint"


def judge(state: str | None, action: str, target: str | None, qa_passed: bool) -> tuple[str | None, str | None, str]:
    """Verdict on one request: (reason or None, next state, what happens to the attempt count)."""
    base = state.removeprefix(FAILED) if state else None
    if action == "fail":
        return ("no_state", state, "keep") if base is None else (None, FAILED + base, "keep")
    if target not in NEXT:
        return "unknown_state", state, "keep"
    if base is None and target != START:
        return "must_start_created", state, "keep"
    if base is not None and target != base and target not in NEXT[base]:
        return "illegal_transition", state, "keep"
    if target == "DELIVERED" and not qa_passed:
        return "qa_not_passed", state, "keep"
    return None, target, "next" if target == base else "reset"


def _step(state, attempt, row) -> tuple:
    reason, after, change = judge(state, row.action, row.target, row.technical_qa_passed)
    attempt = attempt + 1 if change == "next" else 1 if change == "reset" else attempt
    return reason, after, attempt


def _prepared(batch: pd.DataFrame) -> Iterator:
    clean = batch.astype(object).where(batch.notna(), None)
    return clean.itertuples(index=False)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verdicts over rows sorted by project, chunk and seq; `in_state` and `in_attempt` seed each chunk."""
    at, state, attempt = None, None, 0
    for batch in batches:
        out = []
        for row in _prepared(batch):
            if (row.project_id, row.chunk) != at:
                at, state, attempt = (row.project_id, row.chunk), row.in_state, int(row.in_attempt)
            reason, state, attempt = _step(state, attempt, row)
            out.append((row.project_id, row.seq, reason is None, reason, state, attempt))
        yield pd.DataFrame(out, columns=["project_id", "seq", "accepted", "reason", "state", "attempt"])


_STATES = [None, *NEXT]


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each chunk does to every incoming base state: outgoing state, and attempt as (relative, amount)."""
    at, table = None, None

    def flush():
        return [(at[0], at[1], s or "", t[0] or "", t[1], t[2]) for s, t in table.items()]

    names = ["project_id", "chunk", "incoming", "outgoing", "relative", "amount"]
    for batch in batches:
        done = []
        for row in _prepared(batch):
            if (row.project_id, row.chunk) != at:
                if table is not None:
                    done.extend(flush())
                at, table = (row.project_id, row.chunk), {s: (s, True, 0) for s in _STATES}
            for incoming, (state, relative, amount) in table.items():
                reason, after, change = judge(state, row.action, row.target, row.technical_qa_passed)
                if change == "next":
                    amount += 1
                elif change == "reset":
                    relative, amount = False, 1
                table[incoming] = (after, relative, amount)
        if done:
            yield pd.DataFrame(done, columns=names)
    if table is not None:
        yield pd.DataFrame(flush(), columns=names)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Incoming state of every chunk, from the effects of the chunks before it in order."""
    project, state, attempt, chunk, effect = None, "", 0, None, {}

    def leave():
        nonlocal state, attempt
        out, relative, amount = effect[state.removeprefix(FAILED)]
        kept = state if out == state.removeprefix(FAILED) and relative and amount == 0 and state.startswith(FAILED) else out
        state, attempt = kept, attempt + amount if relative else amount

    names = ["project_id", "chunk", "in_state", "in_attempt"]
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.project_id != project:
                project, state, attempt, chunk, effect = row.project_id, "", 0, None, {}
            if row.chunk != chunk:
                if effect:
                    leave()
                chunk, effect = row.chunk, {}
                out.append((project, chunk, state or None, attempt))
            effect[row.incoming] = (row.outgoing, bool(row.relative), int(row.amount))
        if out:
            yield pd.DataFrame(out, columns=names)


def validate_log(requests: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Verdict on every request of every project, in order of `seq`.

    requests(project_id, seq, action, target, technical_qa_passed) with a dense seq from zero;
    action is "enter" or "fail". `state` and `attempt` are those after the request.
    """
    rows = requests.select(
        F.col("project_id").cast("bigint"), F.col("seq").cast("bigint"), "action", "target",
        F.coalesce("technical_qa_passed", F.lit(False)).alias("technical_qa_passed"),
        F.floor(F.col("seq") / F.lit(chunk_rows)).cast("bigint").alias("chunk"),
    )
    spread, order = ["project_id", "chunk"], ["project_id", "chunk", "seq"]
    # At most rows / chunk_rows projects reach a second chunk.
    long = rows.where(F.col("chunk") > 0).select("project_id").distinct()
    if long.isEmpty():
        seeded = rows.withColumns({"in_state": F.lit(None).cast("string"), "in_attempt": F.lit(0).cast("bigint")})
    else:
        chunked = rows.join(F.broadcast(long), "project_id", "left_semi")
        effects = chunked.repartition(*spread).sortWithinPartitions(*order).mapInPandas(
            _effects, "project_id bigint, chunk bigint, incoming string, outgoing string, relative boolean, amount bigint"
        )
        seeds = effects.repartition("project_id").sortWithinPartitions("project_id", "chunk").mapInPandas(
            _walk, "project_id bigint, chunk bigint, in_state string, in_attempt bigint"
        )
        seeded = rows.join(seeds, spread, "left").withColumn("in_attempt", F.coalesce("in_attempt", F.lit(0).cast("bigint")))
    return seeded.repartition(*spread).sortWithinPartitions(*order).mapInPandas(_fold, VERDICTS)


def current_state(log: DataFrame, key: str = "project_id", order: str = "seq") -> DataFrame:
    """Last entry of each project."""
    body = F.struct(*[F.col(c) for c in log.columns if c != key])
    return log.groupBy(key).agg(F.max_by(body, F.col(order)).alias("_last")).select(key, "_last.*")


def accepted_log(verdicts: DataFrame) -> DataFrame:
    """Entries a validated log really holds."""
    return verdicts.where("accepted")


def encode_payload(fields: dict[str, Column]) -> Column:
    """JSON object with sorted keys."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def stage_rollup(runs: DataFrame) -> DataFrame:
    """Runs per stage and status with mean and longest duration."""
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return runs.groupBy("stage", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.avg(seconds).alias("mean_sec"), F.max(seconds).alias("longest_sec")
    )
