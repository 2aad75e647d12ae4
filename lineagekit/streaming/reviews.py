"""Review events as a stream: the same fold as in batch, with the session as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.review import FOLDED, Session

STATE = "session string, last_ts long, last_id long"
START = "start_comparison"


def _restored(data: str) -> Session:
    given = json.loads(data)
    session = Session([])
    session.comparisons = {c: {t: tuple(v) for t, v in targets.items()} for c, targets in given["comparisons"].items()}
    session.status, session.revision, session.refused = given["status"], given["revision"], given["refused"]
    return session


def folded(events: DataFrame) -> DataFrame:
    """FOLDED rows of sessions after each micro-batch (update mode).

    ``events``: session_id, action, comparison_id, target, verdict, ts (timestamp), event_id; the action
    ``start_comparison`` adds a comparison to its session. Events of a batch are applied by (ts, event_id).
    A late event, at or before the last applied one, is counted as refused: the fold is not commutative,
    so applying it late would give a state that no order of events explains.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, last = (_restored(state.get[0]), tuple(state.get[1:])) if state.exists else (Session([]), (-(2**62), 0))
        frame = pd.concat(list(frames), ignore_index=True).sort_values(["micros", "event_id"])
        for e in frame.itertuples():
            at = (int(e.micros), int(e.event_id))
            if at <= last:
                session.refused += 1
            elif e.action == START:
                session.comparisons.setdefault(e.comparison_id, Session.initial())
            else:
                session.apply(e.action, e.comparison_id, e.target, e.verdict)
            last = max(last, at)
        state.update((json.dumps({"comparisons": session.comparisons, "status": session.status, "revision": session.revision, "refused": session.refused}), *last))
        yield pd.DataFrame(session.rows(key[0]), columns=[c.split()[0] for c in FOLDED.split(", ")])

    rows = events.where("session_id is not null").select("session_id", "action", "comparison_id", "target", "verdict", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id")
    return rows.groupBy("session_id").applyInPandasWithState(update, FOLDED, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_actions(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of actions in event-time windows; events later than ``late`` are dropped by the watermark."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "action")
    return rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")
