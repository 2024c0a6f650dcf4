"""Structured Streaming counterparts: sessions, first arrivals, circuit breakers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BREAKER = "key string, opened timestamp, half_open timestamp"
STATE = "failures int, open_until double"


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of closed sessions; ``end`` is the last event plus the gap."""
    w = F.session_window(ts, gap)
    found = events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_arrivals(rows: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: visited pages, content hashes, fingerprints."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def breaker(attempts: DataFrame, threshold: int = 5, timeout_s: float = 60.0) -> DataFrame:
    """Openings of a breaker per key over attempts (key, ts, ok): ``threshold`` failures in a row open it.

    While open, attempts are ignored; the first one after the timeout is a trial: failure opens again, success closes.
    The state of a key is two numbers.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, until = state.get if state.exists else (0, 0.0)
        out = []
        for row in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
            at = row.ts.timestamp()
            if until and at < until:
                continue
            trial = bool(until)
            failures = 0 if row.ok else failures + 1
            until = 0.0
            if not row.ok and (trial or failures >= threshold):
                until, failures = at + timeout_s, 0
                out.append((key[0], row.ts, row.ts + pd.Timedelta(seconds=timeout_s)))
        state.update((failures, until))
        yield pd.DataFrame(out, columns=["key", "opened", "half_open"])

    return attempts.groupBy("key").applyInPandasWithState(step, BREAKER, STATE, "append", GroupStateTimeout.NoTimeout)
