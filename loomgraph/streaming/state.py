"""State over time: windows of arrivals, rolling statistics, tailing an operation log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.order import recent

RESERVOIR, WARM, TTL_SECONDS = 128, 12, 3600


def rate_windows(events: DataFrame, key: str, ts: str, seconds: int = 60, most: int | None = None, late: str | None = None) -> DataFrame:
    """(key, start, n, admitted): arrivals in tumbling windows, and how many of them a limit admits. late: a watermark, for streams."""
    t = events.withWatermark(ts, late) if late else events
    out = t.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n", (F.least("n", F.lit(most)) if most is not None else F.col("n")).alias("admitted"))


def storm(events: DataFrame, ts: str, seconds: int = 60, key: str | None = None) -> DataFrame:
    """Events with `recent`: arrivals in the seconds up to and with each one. With a key they are counted for each key; without one, rows meet
    in buckets of time."""
    if key is None:
        return recent(events.withColumn("_micros", F.unix_micros(ts)), "_micros", seconds * 1_000_000).drop("_micros")
    w = W.partitionBy(key).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(w))


def rolling_median(samples: DataFrame, session: str, order: list, value: str, size: int = RESERVOIR, warm: int = WARM) -> DataFrame:
    """samples with `median` of the session's last `size`; null before it has `warm` of them."""
    w = W.partitionBy(session).orderBy(*order).rowsBetween(-size + 1, 0)
    return samples.withColumn("median", F.when(F.count(F.lit(1)).over(w) >= warm, F.percentile(value, 0.5).over(w)))


def rolling_p75(samples: DataFrame, key: str, order: list, value: str, size: int = 100) -> DataFrame:
    """samples with `p75`, the nearest-rank 75th percentile of the last `size`."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(-size + 1, 0)
    values = F.array_sort(F.collect_list(value).over(w))
    return samples.withColumn("p75", F.element_at(values, F.ceil(F.size(values) * 0.75).cast("int")))


def session_reservoir(stream: DataFrame, session: str, value: str, size: int = RESERVOIR, warm: int = WARM) -> DataFrame:
    """The rolling median as a stateful stream: (session, n, median), the state of a session dropped after an hour without samples."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        for b in batches:
            kept = (kept + b[value].tolist())[-size:]
        state.update((kept,))
        state.setTimeoutDuration(TTL_SECONDS * 1000)
        yield pd.DataFrame({session: [key[0]], "n": [len(kept)], "median": [float(pd.Series(kept).median()) if len(kept) >= warm else None]})

    kind = stream.schema[session].dataType.simpleString()
    return stream.groupBy(session).applyInPandasWithState(step, f"{session} {kind}, n long, median double", "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tail_operations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An operation log that grows by files, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


class SnapshotCache:
    """Derived tables by snapshot id: another id drops them all."""

    def __init__(self):
        self.snapshot, self.tables = None, {}

    def get(self, snapshot: str, name: str, build) -> DataFrame:
        if snapshot != self.snapshot:
            for t in self.tables.values():
                t.unpersist()
            self.snapshot, self.tables = snapshot, {}
        if name not in self.tables:
            self.tables[name] = build().persist()
        return self.tables[name]
