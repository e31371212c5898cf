"""Job claims under leases as a stateful stream, keyed by document.

A claim is granted where the document is queued, or where the job that holds it has not been heard of for the length
of the lease; otherwise it is refused, so a message that is delivered twice starts one job. A heartbeat renews the
lease, a finish ends it. Time is that of the events, so replays give the same decisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE = 600.0
RETRIES = 3
_OUT = "doc long, event_id long, kind string, worker string, granted boolean, status string, attempts long"
_STATE = "status string, worker string, seen double, attempts long"


def _decide(state: tuple, event: tuple, lease: float) -> tuple[tuple, bool | None]:
    """The next (status, worker, seen, attempts), and whether a claim was granted."""
    status, worker, seen, attempts = state
    kind, who, at = event
    if kind == "enqueue":
        return (("queued", None, at, attempts) if status in ("new", "done", "failed") else state), None
    if kind == "claim":
        free = status == "queued" or status == "running" and at - seen > lease
        if free and attempts >= RETRIES + 1:
            return ("failed", None, at, attempts), False
        return (("running", who, at, attempts + 1), True) if free else (state, False)
    if status == "running" and who == worker:
        return {"heartbeat": (status, worker, at, attempts), "finish": ("done", None, at, attempts), "fail": ("queued", None, at, attempts)}.get(kind, state), None
    return state, None


def _fold(rows: list[tuple], state: tuple, lease: float) -> tuple[list[tuple], tuple]:
    out = []
    for event_id, kind, worker, at in rows:
        state, granted = _decide(state, (kind, worker, at), lease)
        out.append((event_id, kind, worker, granted, state[0], state[3]))
    return out, state


def claims(events: DataFrame, lease: float = LEASE) -> DataFrame:
    """One decision for each event (doc, event_id, kind, worker, at); streaming or not.

    Kinds are enqueue, claim, heartbeat, finish and fail. Events of a document are taken in order of time and id within
    a micro-batch; the state carries over to the next. After RETRIES repeated claims a document has failed.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        held = state.get if state.exists else ("new", None, 0.0, 0)
        out, held = _fold(list(rows[["event_id", "kind", "worker", "at"]].itertuples(index=False, name=None)), tuple(held), lease)
        state.update(held)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["doc", "event_id", "kind", "worker", "granted", "status", "attempts"])

    rows = events.select(F.col("doc").cast("long").alias("doc"), F.col("event_id").cast("long").alias("event_id"), "kind", "worker", (F.unix_micros("at") / 1e6).alias("at"))
    if events.isStreaming:
        return rows.groupBy("doc").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(["at", "event_id"])
        out, _ = _fold(list(ordered[["event_id", "kind", "worker", "at"]].itertuples(index=False, name=None)), ("new", None, 0.0, 0), lease)
        return pd.DataFrame([(key[0], *x) for x in out], columns=["doc", "event_id", "kind", "worker", "granted", "status", "attempts"])

    return rows.groupBy("doc").applyInPandas(whole, _OUT)


def stale(documents: DataFrame, now: str, lease: float = LEASE) -> DataFrame:
    """(doc, task): documents to queue again: those waiting, and those at work whose lease has run out; parsed ones go on to extraction."""
    late = F.col("status").isin("parsing", "extracting", "validating") & (F.unix_micros("updated_at") < F.unix_micros(F.lit(now).cast("timestamp")) - int(lease * 1e6))
    return documents.where((F.col("status") == "queued") | late).select("doc", F.when(F.col("parsed"), "extract").otherwise("parse").alias("task"))


def windowed(events: DataFrame, at: str, kind: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of kinds in windows of event time; rows later than the watermark are left out by a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
