"""Drought events of standardised indices as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "site string, drought_id long, start timestamp, end timestamp, duration long, magnitude double, severity double"


class Runs(StatefulProcessor):
    """A site's open run of negative values, and the values that the watermark has not passed yet."""

    def __init__(self, critical: float):
        self.critical = critical

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, ssi double")
        self.run = handle.getValueState("run", "done timestamp, events long, start timestamp, end timestamp, duration long, magnitude double, severity double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.run.get()[0] if self.run.exists() else None
        for batch in rows:
            fresh = batch if done is None else batch[batch["ts"] > done]
            if len(fresh):
                self.waiting.appendList([(t.to_pydatetime(), None if pd.isna(v) else float(v)) for t, v in zip(fresh["ts"], fresh["ssi"])])
                for ts in fresh["ts"].unique():
                    self.handle.registerTimer(int(pd.Timestamp(ts).timestamp() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((x for x in held if pd.Timestamp(x[0]) <= passed), key=lambda x: (x[0], x[1] is not None, x[1] or 0.0))
        if not ready:
            return  # an earlier timer of this watermark took them
        later = [tuple(x) for x in held if pd.Timestamp(x[0]) > passed]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        state = self.run.get() if self.run.exists() else (None, 0, None, None, 0, 0.0, 0.0)
        _, events, start, end, duration, magnitude, severity = state
        found = []
        for ts, value in ready:
            if value is not None and value < 0:
                start, end, duration = (start if duration else ts), ts, duration + 1
                magnitude, severity = magnitude + value, min(severity, value)
                continue
            if duration and severity <= self.critical:
                events += 1
                found.append((key[0], events, start, end, duration, magnitude, severity))
            start, end, duration, magnitude, severity = None, None, 0, 0.0, 0.0
        self.run.update((ready[-1][0], events, start, end, duration, magnitude, severity))
        if found:
            yield pd.DataFrame(found, columns=["site", "drought_id", "start", "end", "duration", "magnitude", "severity"])

    def close(self) -> None:
        pass


def streamed_events(index: DataFrame, critical: float = -1.0, late: str = "30 days") -> DataFrame:
    """(site, drought_id, start, end, duration, magnitude, severity) of runs of negative values in a stream (site, ts timestamp, ssi).

    The events are those of `operators.drought.events` by site, each once, when the watermark passes the value that ends it. Values
    may come in any order as long as they are not later than `late`; later ones are left out. A missing value or NaN ends a
    run, as one of zero or more does. The state of a site is one open run and the values of the last `late`. A row without a
    site or a date is left out. The session needs the RocksDB state store.
    """
    held = index.select("site", F.col("ts").cast("timestamp").alias("ts"), F.col("ssi").cast("double").alias("ssi")).where("site IS NOT NULL AND ts IS NOT NULL")
    return held.withWatermark("ts", late).groupBy("site").transformWithStateInPandas(Runs(critical), EVENT, outputMode="append", timeMode="eventTime")
