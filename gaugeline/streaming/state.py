"""State processors: past-only features and votes, and the health ledger, per station."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugeline.config import DEFAULT, QCConfig

# Fixed value: readings of context kept per station (fourteen days of hours).
KEPT_ROWS = 336
# Fixed value: readings worked on at a time.
CHUNK_ROWS = 4096
DAY = 86_400_000_000
EPOCH = pd.Timestamp(0)
READINGS = ("temperature", "humidity", "pressure")

CAUSAL_SCHEMA = (
    "station_id bigint, event_time timestamp, temperature double, humidity double, pressure double, "
    "temperature_deviation_24h double, temperature_zscore_24h double, temperature_change double, "
    "temperature_std_6h double, temperature_trend_6h double, previous_6h_median double, "
    "previous_12h_median double, running_length bigint, rule_score int, statistical_score int, temporal_score int"
)
# readings are kept as the bytes of their arrays, so that no value is handled on its own
HISTORY_SCHEMA = "times binary, temperature binary, humidity binary, pressure binary, run_length bigint"


def causal_frame(df: pd.DataFrame, open_run: int, fresh_from: int, cfg: QCConfig = DEFAULT) -> pd.DataFrame:
    """Features and votes of the rows from position fresh_from on.

    df holds one station's context and new rows in time order; open_run is the
    running length at the last context row.
    """
    t = df["temperature"]
    prev = t.shift(1)
    base = prev.rolling(24, min_periods=cfg.baseline_min_rows)
    deviation = t - base.mean()
    change = t.diff()
    weights = (np.arange(6) - 2.5) / 17.5
    trend = sum(w * t.shift(5 - i) for i, w in enumerate(weights))
    same = (t == prev).to_numpy()
    place = np.arange(len(df))
    # a run goes on from the last reading that differs from the one before it, or from the open run
    start = np.maximum.accumulate(np.where(same | (place < fresh_from), -1, place))
    running = np.where(start >= 0, place - start + 1, open_run + place - fresh_from + 1)
    out = pd.DataFrame(
        {
            "event_time": df["event_time"],
            "temperature": t,
            "humidity": df["humidity"],
            "pressure": df["pressure"],
            "temperature_deviation_24h": deviation,
            # the spread of equal values is 0 up to float noise of the running update
            "temperature_zscore_24h": deviation / base.std().where(base.max() > base.min()),
            "temperature_change": change,
            "temperature_std_6h": t.rolling(6, min_periods=2).std(),
            "temperature_trend_6h": trend,
            "previous_6h_median": prev.rolling(6, min_periods=3).median(),
            "previous_12h_median": prev.rolling(12, min_periods=6).median(),
            "running_length": running,
        }
    ).iloc[fresh_from:]
    limits = {"temperature": cfg.temperature_limits, "humidity": cfg.humidity_limits, "pressure": cfg.pressure_limits}
    rule = np.zeros(len(out), dtype=bool)
    for v, (low, high) in limits.items():
        rule |= (out[v].isna() | (out[v] < low) | (out[v] > high)).to_numpy()
    frozen = (out["running_length"] >= cfg.freeze_run) & (out["temperature_std_6h"] <= cfg.freeze_std)
    return out.assign(
        rule_score=rule.astype("int32"),
        statistical_score=(
            (out["temperature_zscore_24h"].abs() > cfg.z_limit)
            | (out["temperature_deviation_24h"].abs() > cfg.deviation_limit)
        ).astype("int32"),
        temporal_score=(
            (out["temperature_change"].abs() > cfg.change_limit)
            | frozen
            | (out["temperature_trend_6h"].abs() > cfg.trend_limit)
        ).astype("int32"),
    )


class InTimeOrder(StatefulProcessor):
    """Hands a station's readings on in event-time order, once the watermark has passed them.

    Readings newer than the watermark wait in state by day, whichever micro-batch brought them;
    those behind it are dropped by Spark. A reading without a time has no place and is left out.
    At most CHUNK_ROWS readings and one day more are in memory at a time.
    """

    fields: tuple[str, ...]
    once = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = ", ".join(f"{v} binary" for v in self.fields)
        self.waiting = handle.getMapState("waiting", "day bigint", f"times binary, {held}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            new = frame[["event_time", *self.fields]].dropna(subset=["event_time"])
            for day, part in new.groupby(_micros(new["event_time"]) // DAY):
                if self.waiting.containsKey((int(day),)):
                    part = pd.concat([self.unpack(self.waiting.getValue((int(day),))), part])
                part = self.ordered(part)
                self.waiting.updateValue((int(day),), self.pack(part))
                start = int(_micros(part["event_time"]).iloc[0])
                first = start if first is None else min(first, start)
        if first is not None:
            self._wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = EPOCH + pd.Timedelta(milliseconds=timerValues.getCurrentWatermarkInMs())
        carried, chunk, changed = self.load(), [], False
        for day in sorted(k[0] for k in self.waiting.keys()):
            held = self.unpack(self.waiting.getValue((day,)))
            ready, rest = held[held["event_time"] <= passed], held[held["event_time"] > passed]
            if len(ready):
                chunk.append(ready)
                if len(rest):
                    self.waiting.updateValue((day,), self.pack(rest))
                else:
                    self.waiting.removeKey((day,))
            if chunk and (len(rest) or sum(map(len, chunk)) >= CHUNK_ROWS):
                out, carried = self.advance(int(key[0]), pd.concat(chunk, ignore_index=True), carried)
                chunk, changed = [], True
                yield out
            if len(rest):
                self._wake_at(int(_micros(rest["event_time"]).iloc[0]))
                break
        if chunk:
            out, carried = self.advance(int(key[0]), pd.concat(chunk, ignore_index=True), carried)
            changed = True
            yield out
        if changed:
            self.save(carried)

    def close(self) -> None:
        pass

    def _wake_at(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    @classmethod
    def ordered(cls, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("event_time", kind="stable")
        return df.drop_duplicates("event_time") if cls.once else df

    @classmethod
    def pack(cls, df: pd.DataFrame) -> tuple:
        values = (df[c].to_numpy(dtype=float, na_value=np.nan).tobytes() for c in cls.fields)
        return (_micros(df["event_time"]).to_numpy(np.int64).tobytes(), *values)

    @classmethod
    def unpack(cls, held) -> pd.DataFrame:
        times, *values = held
        columns = {c: np.frombuffer(v, float) for c, v in zip(cls.fields, values)}
        return pd.DataFrame({"event_time": pd.to_datetime(np.frombuffer(times, np.int64), unit="us"), **columns})

    @classmethod
    def finish(cls, station: int, days: list, kept) -> pd.DataFrame:
        """The results of readings that still wait, from the state's values."""
        held = pd.concat([cls.unpack(d) for d in days], ignore_index=True)
        return cls.advance(station, cls.ordered(held).reset_index(drop=True), cls.restored(kept))[0]


def _micros(times: pd.Series) -> pd.Series:
    return (times - EPOCH) // pd.Timedelta(microseconds=1)


class CausalVotes(InTimeOrder):
    """Keeps the last KEPT_ROWS readings of a station and votes on each new one.

    Of several readings at one time the first counts.
    """

    fields, once = READINGS, True

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.history = handle.getValueState("history", HISTORY_SCHEMA)

    @classmethod
    def restored(cls, kept):
        return (cls.unpack(kept[:-1]), int(kept[-1])) if kept is not None else (None, 0)

    def load(self):
        return self.restored(self.history.get() if self.history.exists() else None)

    def save(self, carried) -> None:
        tail, run = carried
        self.history.update((*self.pack(tail), run))

    @classmethod
    def advance(cls, station: int, new: pd.DataFrame, carried):
        kept, open_run = carried
        both = new if kept is None else pd.concat([kept, new], ignore_index=True)
        out = causal_frame(both, open_run, len(both) - len(new))
        run = int(out["running_length"].iloc[-1])
        out.insert(0, "station_id", station)
        return out, (both.tail(KEPT_ROWS), run)


LEDGER_SCHEMA = "station_id bigint, event_time timestamp, penalty int, health_score bigint"
SCORE_SCHEMA = "score bigint"


class HealthLedger(InTimeOrder):
    """Running health of a station: points fall by each penalty and stop at zero."""

    fields = ("penalty",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.score = handle.getValueState("score", SCORE_SCHEMA)

    @classmethod
    def restored(cls, kept):
        return int(kept[0]) if kept is not None else 100

    def load(self):
        return self.restored(self.score.get() if self.score.exists() else None)

    def save(self, carried) -> None:
        self.score.update((carried,))

    @classmethod
    def advance(cls, station: int, new: pd.DataFrame, carried):
        # penalties are never negative, so one running sum and one stop at zero suffice
        after = np.maximum(0, carried - new["penalty"].astype("int64").cumsum())
        out = pd.DataFrame(
            {
                "station_id": station,
                "event_time": new["event_time"],
                "penalty": new["penalty"].astype("int32"),
                "health_score": after.astype("int64"),
            }
        )
        return out, int(after.iloc[-1])
