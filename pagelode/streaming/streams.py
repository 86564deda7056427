"""Structured Streaming forms of the ledgers, log counts, sessions and recommendation replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelode.functions import words as W


def timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarked on ts; a zoneless ts is read in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling days per type; rows later than the watermark are dropped."""
    day = F.window("ts", "1 day")
    grouped = timed(events, late).groupBy(day, "type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("window.start").alias("day"), "type", "n", "value")


def trailing_cost(events: DataFrame, span: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    window = F.window("ts", span, step)
    return timed(events, late).groupBy(window).agg(F.sum("value").alias("cost"), F.count("*").alias("calls")).select(F.col("window.end").alias("until"), "cost", "calls")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = F.session_window("ts", gap)
    return timed(events, late).groupBy("user_id", s).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def distinct_raises(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Raise events without repeats of one id inside the watermark."""
    return timed(events.where("event = 'raise'"), late).dropDuplicatesWithinWatermark(["id"])


STATE = "id string, status string, times_raised long, created long, updated long, severity string"


def replay_stream(events: DataFrame) -> DataFrame:
    """State of each recommendation after every micro-batch that touches it; same rules as the batch replay."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, raised, created, updated, severity = state.get if state.exists else (None, 0, None, None, None)
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples():
            if r.event == "raise":
                status = "open" if status in (None, "done", "resolved") else status
                raised, created, updated = raised + 1, int(r.ts) if created is None else created, int(r.ts)
                severity = r.severity or severity
            elif r.event == "status" and status is not None and r.status in W.STATUSES:
                status, updated = r.status, int(r.ts)
        if status is not None:
            state.update((status, raised, created, updated, severity))
            yield pd.DataFrame([(key[0], status, raised, created, updated, severity)], columns=["id", "status", "times_raised", "created", "updated", "severity"])

    return events.groupBy("id").applyInPandasWithState(step, STATE, "status string, times_raised long, created long, updated long, severity string", "update", GroupStateTimeout.NoTimeout)


TIMELINE = "id string, seq long, ts long, kind string, status string"


def timeline_stream(events: DataFrame) -> DataFrame:
    """What each event of the recommendation log does to its recommendation (TIMELINE), emitted as it happens.

    kind: rec_raised, rec_reopened, raised_again or rec_status; events without
    effect (a status of nothing raised, an unknown status) emit nothing. The
    state of a key is its status alone. Needs Spark's RocksDB state store.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Timeline(StatefulProcessor):
        def init(self, handle):
            self.status = handle.getValueState("status", "status string")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - Spark's names
            known = self.status.get()
            status = known[0] if known else None
            out = []
            for r in pd.concat(list(rows)).sort_values("seq").itertuples():
                kind = None
                if r.event == "raise":
                    kind = "rec_raised" if status is None else "rec_reopened" if status in ("done", "resolved") else "raised_again"
                    status = status if kind == "raised_again" else "open"
                elif r.event == "status" and status is not None and r.status in W.STATUSES:
                    kind, status = "rec_status", r.status
                if kind:
                    out.append((key[0], int(r.seq), int(r.ts), kind, status))
            if status is not None:
                self.status.update((status,))
            yield pd.DataFrame(out, columns=["id", "seq", "ts", "kind", "status"])

        def close(self):
            pass

    return events.groupBy("id").transformWithStateInPandas(Timeline(), TIMELINE, "Append", "none")
