"""Incremental intake and keyed state on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import exists


def deduplicated(stream: DataFrame, key: list[str], event_time: str, late: str = "3 days") -> DataFrame:
    """Each key once, within the days by which sources send their past again."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(key)


def since(cursor: Column, today: Column, overlap_days: int = 3, first_days: int = 30) -> Column:
    """From which day to fetch: some days before the cursor, or a month back at first."""
    return F.coalesce(F.date_sub(cursor, overlap_days), F.date_sub(today, first_days))


def daily_counts(stream: DataFrame, key: str, event_time: str, zone: str = "Asia/Seoul", late: str = "1 day") -> DataFrame:
    """Calls of each key on each Korean day."""
    day = F.window(F.from_utc_timestamp(event_time, zone), "1 day")
    return stream.withWatermark(event_time, late).groupBy(key, day.alias("day")).agg(F.count("*").alias("n")).select(key, F.col("day.start").cast("date").alias("day"), "n")


def token_bucket(stream: DataFrame, key: str, event_id: str, event_time: str, capacity: float = 5.0, refill: float = 2.0) -> DataFrame:
    """(key, event_id, allowed): a bucket of `capacity` tokens for each key, refilled by `refill` a second; a
    call takes one token or is refused. Events of a batch are taken in the order of their times."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values([event_time, event_id])
        out = []
        for at, event in zip(rows[event_time], rows[event_id], strict=True):
            seconds = at.timestamp()
            tokens = min(capacity, tokens + refill * max(0.0, seconds - last)) if last is not None else tokens
            last = seconds if last is None else max(last, seconds)
            allowed = tokens >= 1
            tokens -= allowed
            out.append((group[0], event, bool(allowed)))
        state.update((float(tokens), float(last)))
        yield pd.DataFrame(out, columns=[key, event_id, "allowed"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, {event_id} long, allowed boolean", "tokens double, last double", "update", GroupStateTimeout.NoTimeout)


def circuit_breaker(stream: DataFrame, key: str, event_id: str, event_time: str, failed: str, most: int = 5, rest_seconds: float = 600.0) -> DataFrame:
    """(key, event_id, state): closed until `most` failures follow each other, then open; after rest_seconds
    one call probes (half_open) and closes the circuit if it succeeds, else opens it anew."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, opened = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values([event_time, event_id])
        out = []
        for at, event, bad in zip(rows[event_time], rows[event_id], rows[failed], strict=True):
            seconds = at.timestamp()
            if opened is not None and seconds - opened < rest_seconds:
                out.append((group[0], event, "open"))
                continue
            out.append((group[0], event, "closed" if opened is None else "half_open"))
            failures = failures + 1 if bad else 0
            opened = seconds if bad and (opened is not None or failures >= most) else None
        state.update((int(failures), opened))
        yield pd.DataFrame(out, columns=[key, event_id, "state"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, {event_id} long, state string", "failures int, opened double", "update", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str):
    """Starts a query that hands each micro-batch to `merge` and ends when all there is has been read. A batch whose merge
    has ended is marked in the checkpoint and not merged again when Spark replays it; one that broke off within
    `merge` is, so that a merge must be one transaction or give the same again."""

    def once(batch: DataFrame, batch_id: int) -> None:
        spark, mark = batch.sparkSession, f"{checkpoint}/merged/{batch_id}"
        if not exists(spark, mark):
            merge(batch)
            spark.range(0).write.mode("overwrite").parquet(mark)

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
