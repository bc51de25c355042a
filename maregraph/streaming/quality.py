"""Quality control of a stream: medians and sessions that leave state once closed, dedup, and per-station memory that forgets silent stations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000

#: Rows of a station that are computed and sent at once.
ROWS = 65_536


def _keyed(events: DataFrame) -> DataFrame:
    """events, in a session whose state store holds what processors with timers need."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events


def _millis(x: pd.Series) -> np.ndarray:
    return x.to_numpy("datetime64[ms]").astype(np.int64)


class HourlyMedian(StatefulProcessor):
    """State: the open hours' values, a list for each hour. A timer at an hour's end emits its median and drops it, so only hours that the watermark hasn't passed are held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour long", "values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list] = {}
        for pdf in rows:
            for hour, values in pdf.groupby(_millis(pdf["ts"]) // HOUR)["value"]:
                new.setdefault(int(hour), []).extend(values.dropna().tolist())
        for hour, values in new.items():
            had = self.hours.getValue((hour,))[0] if self.hours.containsKey((hour,)) else []
            self.hours.updateValue((hour,), ([*had, *values],))
            self.handle.registerTimer((hour + 1) * HOUR)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hour = expiredTimerInfo.getExpiryTimeInMs() // HOUR - 1
        if self.hours.containsKey((hour,)):
            values = self.hours.getValue((hour,))[0]
            self.hours.removeKey((hour,))
            yield pd.DataFrame({"key": [key[0]], "hour": [pd.Timestamp(hour * HOUR, unit="ms")], "value": [float(np.median(values)) if len(values) else None]})

    def close(self) -> None:
        pass


def hourly_medians(events: DataFrame, ts: str, key: str, value: str, late: str = "1 hour") -> DataFrame:
    """Rows `key, hour, value`, each once, in append mode: an hour's median goes out when the watermark passes its end. Rows that come later than that are dropped."""
    rows = _keyed(events).withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    schema = T.StructType([T.StructField("key", events.schema[key].dataType), T.StructField("hour", T.TimestampType()), T.StructField("value", T.DoubleType())])
    return rows.groupBy("key").transformWithStateInPandas(HourlyMedian(), schema, "append", "eventTime").withColumnRenamed("key", key)


class Sessions(StatefulProcessor):
    """State: the open sessions of a key, their first and last time and rows. A timer at the end of a session's gap emits and drops it."""

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        for pdf in rows:
            micros = pdf["ts"].to_numpy("datetime64[us]").astype(np.int64)
            spans += [(int(t), int(t), 1) for t in micros]
        merged: list[list[int]] = []
        for first, last, n in sorted(spans):
            if merged and first - merged[-1][1] < self.gap * 1000:
                merged[-1][1:] = [max(last, merged[-1][1]), merged[-1][2] + n]
            else:
                merged.append([first, last, n])
        self.open.put([tuple(m) for m in merged])
        for _, last, _ in merged:
            self.handle.registerTimer(-(-last // 1000) + self.gap)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        spans = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        over = [s for s in spans if -(-s[1] // 1000) + self.gap <= now]
        if over:
            left = [s for s in spans if s not in over]
            self.open.put(left) if left else self.open.clear()
            time = lambda us: pd.to_datetime(us, unit="us")
            yield pd.DataFrame({"key": [key[0]] * len(over), "start": [time(s[0]) for s in over], "end": [time(s[1] + self.gap * 1000) for s in over], "n": [s[2] for s in over]})

    def close(self) -> None:
        pass


def sessions(events: DataFrame, ts: str, key: str, gap_minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Rows `key, start, end, n` in append mode: runs of rows less than the gap apart; each goes out once, when the watermark passes its end (the last row's time and the gap)."""
    rows = _keyed(events).withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts).alias("ts"))
    schema = T.StructType([T.StructField("key", events.schema[key].dataType), T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType()), T.StructField("n", T.LongType())])
    return rows.groupBy("key").transformWithStateInPandas(Sessions(gap_minutes * 60_000), schema, "append", "eventTime").withColumnRenamed("key", key)


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


SCORES = "station long, ts timestamp, event_id long, x double, ewma double, cusum_pos double, cusum_neg double, persistence long, rate double"


class CausalScores(StatefulProcessor):
    """State: a station's memory in one value. A station without rows for `silence` starts anew; a timer then drops its memory."""

    def __init__(self, slack: float, reset: float, rate: float, silence_ms: int) -> None:
        self.slack, self.reset, self.rate, self.silence = slack, reset, rate, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "ewma double, up double, down double, sign double, run long, last double, at long, number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # three numbers a row are held, and one frame of ROWS rows at a time goes out
        parts = [(pdf["ts"].to_numpy("datetime64[us]").astype(np.int64), pdf["event_id"].to_numpy(), pdf["x"].to_numpy(float)) for pdf in rows]
        us, ids, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.lexsort((ids, us))
        memory = self.memory.get() if self.memory.exists() else None
        if memory is not None:
            order = order[(us[order] > memory[6]) | ((us[order] == memory[6]) & (ids[order] > memory[7]))]
        if not len(order):
            return
        us = us[order]
        # a station that was silent starts anew, whether its timer has run or not
        silent = np.flatnonzero(np.diff(us, prepend=us[0] if memory is None else memory[6]) > self.silence * 1000).tolist()
        for begin, end in zip([0, *(k for k in silent if k)], [*(k for k in silent if k), len(us)], strict=True):
            if begin in silent:
                memory = None
            for at in range(begin, end, ROWS):
                some = slice(at, min(end, at + ROWS))
                memory, found = self._go_on(memory, us[some], ids[order[some]], x[order[some]])
                yield found.assign(station=key[0])
        self.memory.update(memory)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(us[-1]) // 1000 + self.silence)

    def _go_on(self, memory: tuple | None, us: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[tuple, pd.DataFrame]:
        from maregraph.operators.causal import clipped_sums

        ewma, up, down, sign, run, last, _, _ = memory or (None, 0.0, 0.0, 0.0, 0, None, None, None)
        x = np.nan_to_num(values, posinf=np.inf, neginf=-np.inf)
        averages = pd.Series(np.concatenate([[x[0] if ewma is None else ewma], x])).ewm(alpha=self.rate, adjust=False).mean().to_numpy()[1:]
        begun = 0 if ewma is not None else 1  # the first row of a station adds to no sum
        sums = [np.concatenate([np.zeros(begun), clipped_sums(s * x[begun:] - self.slack, start, self.reset)]) for s, start in ((1, up), (-1, down))]
        signs = np.sign(x)
        fresh = (signs == 0) | (signs != np.concatenate([[sign], signs[:-1]]))
        fresh[0] |= last is None
        begins = np.maximum.accumulate(np.where(fresh, np.arange(len(x)), -1))
        runs = np.where(begins >= 0, np.arange(len(x)) - begins + 1, np.arange(len(x)) + 1 + run)
        steps = np.abs(np.diff(x, prepend=x[0] if last is None else last))
        now = float(averages[-1]), float(sums[0][-1]), float(sums[1][-1]), float(signs[-1]), int(runs[-1]), float(x[-1]), int(us[-1]), int(ids[-1])
        return now, pd.DataFrame({"station": None, "ts": us.astype("datetime64[us]"), "event_id": ids, "x": values, "ewma": averages, "cusum_pos": sums[0], "cusum_neg": sums[1], "persistence": runs, "rate": steps})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.memory.clear()
        return iter(())

    def close(self) -> None:
        pass


def causal_scores(events: DataFrame, slack: float, reset: float, rate: float = 0.3, silence: str = "30 days", late: str = "1 hour") -> DataFrame:
    """Rows (station, ts, event_id, x) of a stream with their memory indicators, in append mode.

    State per station is a few numbers, and none once the watermark is `silence` past its
    last row. A micro-batch's rows are put in order of time and id; rows that aren't
    after the last one in the state come too late and are dropped, as the sums have gone
    on without them.
    """
    silence_ms = int(pd.Timedelta(silence).total_seconds() * 1000)
    return _keyed(events).withWatermark("ts", late).groupBy("station").transformWithStateInPandas(CausalScores(slack, reset, rate, silence_ms), SCORES, "append", "eventTime")
