"""Event logs: sessions, circuit breakers, retries, latest per key, error summaries, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """(key, start, end, n): runs of events with less than ``gap`` between them; ``end`` is the last event."""
    window = F.session_window(ts, gap)
    found = events.groupBy(key, window.alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return found.select(key, "start", "end", "n")


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Runs of consecutive failures of a key: (key, run, n, start, end), by gaps and islands."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = events.withColumn("_bad", failed.cast("int"))
    marked = marked.withColumn("run", F.sum(1 - F.col("_bad")).over(w)).filter("_bad = 1")
    return marked.groupBy(key, "run").agg(F.count("*").alias("n"), F.min(order[0]).alias("start"), F.max(order[0]).alias("end"))


def breaker_openings(events: DataFrame, key: str, ts: str, tie: str, failed: Column, threshold: int = 5, timeout_s: float = 60.0) -> DataFrame:
    """(key, opened, half_open): every opening of a key's breaker.

    ``threshold`` failures in a row open it.  While it is open attempts are ignored; the first one after the timeout is a
    trial: failure opens it again, success closes it.  A key's attempts are folded in order, in constant memory.
    """
    ordered = events.select(
        F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).alias("tie"), failed.alias("failed")
    )
    ordered = ordered.repartition("key").sortWithinPartitions("key", "at", "tie")

    def fold(batches):
        import pyarrow as pa

        last, failures, until = None, 0, None
        for batch in batches:
            out = []
            for name, at, bad in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "failed"))):
                if name != last:
                    last, failures, until = name, 0, None
                if until is not None and at < until:
                    continue
                trial, until = until is not None, None
                failures = failures + 1 if bad else 0
                if bad and (trial or failures >= threshold):
                    failures, until = 0, at + int(timeout_s * 1_000_000)
                    out.append((name, at, until))
            columns = list(zip(*out)) or [()] * 3
            kinds = pa.string(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "opened", "half_open"])

    return ordered.mapInArrow(fold, "key string, opened bigint, half_open bigint")


def breaker_intervals(events: DataFrame, key: str, ts: str, tie: str, failed: Column, threshold: int = 5, timeout: str = "60 seconds") -> DataFrame:
    """(key, opened, half_open): when the threshold-th failure in a row opens a breaker that nothing has opened before.

    Once a run: the state after an opening is what ``breaker_openings`` folds.
    """
    w = Window.partitionBy(key).orderBy(ts, tie)
    marked = events.withColumn("_bad", failed.cast("int")).withColumn("run", F.sum(1 - F.col("_bad")).over(w)).filter("_bad = 1")
    ranked = marked.withColumn("n", F.row_number().over(Window.partitionBy(key, "run").orderBy(ts, tie)))
    return ranked.filter(F.col("n") == threshold).select(key, F.col(ts).alias("opened"), (F.col(ts) + F.expr(f"interval {timeout}")).alias("half_open"))


def retry_delays(attempts: int = 3, base: float = 1.0, most: float = 60.0) -> list[float]:
    return [min(base * 2**k, most) for k in range(attempts)]


def retries(failures: DataFrame, jitter: Column, attempts: int = 3, base: float = 1.0, most: float = 60.0) -> DataFrame:
    """One row an attempt with its delay in seconds: doubled each time, plus jitter, at most ``most``."""
    tries = failures.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    return tries.withColumn("delay", F.least(F.lit(base) * F.pow(F.lit(2.0), F.col("attempt")) + jitter, F.lit(most)))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, folded map-side."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def error_summary(errors: DataFrame) -> DataFrame:
    """total, types, has_critical, first and last of errors (position, type, severity, message)."""
    return errors.agg(
        F.count("*").alias("total"),
        F.countDistinct("type").alias("types"),
        F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("has_critical"),
        F.min_by("message", "position").alias("first"),
        F.max_by("message", "position").alias("last"),
    )


def threads(replies: DataFrame, thread: str, author: str, order: str) -> DataFrame:
    return replies.groupBy(thread).agg(
        F.count("*").alias("replies"),
        F.countDistinct(author).alias("authors"),
        F.max(order).alias("last_activity"),
        (F.count("*") > 2).alias("is_discussion"),
    )
