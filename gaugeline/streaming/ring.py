"""Live context per station: a ring of the last readings in keyed state, and what scoring needs from it.

For each arriving reading the processor gives out the features of the reading and the station's robust
thresholds over the ring with the reading, as the batch operators compute them over those rows. Everything
after that (votes, label, correction, texts) is columns; see `live`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugeline.config import QCConfig
from gaugeline.operators.iforest import ForestVoter

# Readings whose windows are laid out at a time.
CHUNK = 256
HOUR = 3_600_000_000
VALUES = ("temperature", "humidity", "pressure", "wind_speed")
STATE_SCHEMA = "times binary, readings binary, station_name string"
NOT_A_TIME = np.iinfo(np.int64).min

FEATURES = (
    "temperature_deviation_24h",
    "temperature_zscore_24h",
    "temperature_change",
    "absolute_temperature_change",
    "temperature_std_6h",
    "temperature_trend_6h",
    "previous_6h_median",
    "previous_12h_median",
    "local_temperature_residual",
    "local_residual_12h",
    "cum_change_6h",
    "thr_change",
    "thr_residual",
    "thr_spread",
    "thr_cumulative",
    "low_spread",
    "median_12h",
    "bridged",
)
CONTEXT_SCHEMA = (
    "station_id bigint, asked_ts timestamp_ntz, ts timestamp_ntz, station_name string, temperature double, humidity double, pressure double, "
    "wind_speed double, history_rows int, repeat_length bigint, sign_flips bigint, " + ", ".join(f"{f} double" for f in FEATURES)
)


def _last(x: np.ndarray, width: int) -> np.ndarray:
    """For each column, the `width` columns up to it; what lies before the first is unknown."""
    padded = np.concatenate([np.full((len(x), width - 1), np.nan), x], axis=1)
    return np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)


def _spread(w: np.ndarray, least: int) -> np.ndarray:
    """Sample deviation over the last axis, of `least` known values or more; exactly 0 for equal values."""
    known = ~np.isnan(w)
    n = known.sum(-1)
    x = np.where(known, w, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = x.sum(-1) / n
        away = np.where(known, w - mean[..., None], 0.0)
        sd = np.sqrt((away * away).sum(-1) / (n - 1))
    high, low = np.where(known, w, -np.inf).max(-1), np.where(known, w, np.inf).min(-1)
    return np.where(n >= max(least, 2), np.where(high == low, 0.0, sd), np.nan)


def _median(w: np.ndarray, least: int) -> np.ndarray:
    """Median of the known values over the last axis, of `least` or more."""
    n = (~np.isnan(w)).sum(-1)
    ordered = np.sort(w, axis=-1)
    at = lambda k: np.take_along_axis(ordered, np.maximum(k, 0)[..., None], -1)[..., 0]
    return np.where(n >= least, (at((n - 1) // 2) + at(n // 2)) / 2, np.nan)


def quantile(x: np.ndarray, p: float) -> np.ndarray:
    """Linear interpolation between order statistics of each row's known values."""
    ordered, n = np.sort(x, axis=1), (~np.isnan(x)).sum(1)
    place = p * (n - 1)
    low, high = np.floor(place).astype(int), np.ceil(place).astype(int)
    at = lambda k: np.take_along_axis(ordered, np.clip(k, 0, x.shape[1] - 1)[:, None], 1)[:, 0]
    a, b = at(low), at(high)
    return np.where(n > 0, np.where(low == high, a, (high - place) * a + (place - low) * b), np.nan)


def _robust(x: np.ndarray, k: float) -> np.ndarray:
    middle = quantile(x, 0.5)
    mad = quantile(np.abs(x - middle[:, None]), 0.5)
    known = ~np.isnan(x)
    n = known.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(known, x, 0.0).sum(1) / n
        sd = np.sqrt(np.where(known, (x - mean[:, None]) ** 2, 0.0).sum(1) / (n - 1))
    return middle + k * np.where(mad > 0, mad, np.where(n > 1, sd, np.nan))


def window_features(t: np.ndarray, rows: np.ndarray, cfg: QCConfig, std_min_rows: int = 2) -> dict[str, np.ndarray]:
    """Features of the last column of each window, and its thresholds over the window.

    t holds one window a row, old to new, in its last rows[i] columns; the columns before are unknown. Keys in
    capitals are whole windows, for `bridge`.
    """
    m, width = t.shape
    absent = np.arange(width) < (width - rows)[:, None]
    prev = np.concatenate([np.full((m, 1), np.nan), t[:, :-1]], axis=1)
    change = t - prev
    step = np.where(np.isnan(change), 0.0, change)
    spread = _spread(_last(t, 6), std_min_rows)
    prev6 = _median(_last(prev, 6), 3)
    residual = np.abs(t - prev6)
    moved = np.where(absent, np.nan, np.abs(np.where(np.isnan(s := _last(step, 6)), 0.0, s).sum(-1)))
    same = t == prev
    run = np.where(same.all(1), width, np.argmin(same[:, ::-1], axis=1) + 1)
    before = np.concatenate([np.zeros((m, 1)), step[:, :-1]], axis=1)
    two_back = np.concatenate([np.full((m, 2), np.nan), t[:, :-2]], axis=1)
    known = ~(np.isnan(prev) & np.isnan(two_back))
    flips = (known & (np.sign(before) != np.sign(step)))[:, -6:].sum(1)
    out = {
        "repeat_length": run,
        "sign_flips": flips,
        "thr_change": _robust(np.abs(change), cfg.spike_k),
        "thr_residual": _robust(residual, cfg.residual_k),
        "thr_spread": _robust(spread, cfg.noise_std_k),
        "thr_cumulative": _robust(moved, cfg.drift_change_k),
        "low_spread": quantile(spread, cfg.frozen_std_quantile),
        "cum_change_6h": step[:, -6:].sum(1),
        "T": t,
        "CHANGE": change,
        "SPREAD": spread,
        "MEDIAN": prev6,
        "RESIDUAL": residual,
    }
    return out | _at(t, width - 1, out, cfg)


def _at(t: np.ndarray, j: int, w: dict[str, np.ndarray], cfg: QCConfig) -> dict[str, np.ndarray]:
    """The other features at column j."""
    now = t[:, j]
    past = lambda n: np.concatenate([np.full((len(t), max(0, n - j)), np.nan), t[:, max(0, j - n) : j]], axis=1)
    day = past(24)
    n = (~np.isnan(day)).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n >= cfg.baseline_min_rows, np.where(np.isnan(day), 0.0, day).sum(1) / n, np.nan)
        sd = np.where(n >= cfg.baseline_min_rows, _spread(day, 2), np.nan)
        z = (now - mean) / np.where(sd == 0, np.nan, sd)
    last = np.concatenate([past(5), now[:, None]], axis=1)
    prev12 = _median(past(12), 6)
    return {
        "temperature_deviation_24h": now - mean,
        "temperature_zscore_24h": z,
        "temperature_change": w["CHANGE"][:, j],
        "absolute_temperature_change": np.abs(w["CHANGE"][:, j]),
        "temperature_std_6h": w["SPREAD"][:, j],
        "temperature_trend_6h": last @ np.array([-2.5, -1.5, -0.5, 0.5, 1.5, 2.5]) / 17.5,
        "previous_6h_median": w["MEDIAN"][:, j],
        "previous_12h_median": prev12,
        "local_temperature_residual": w["RESIDUAL"][:, j],
        "local_residual_12h": np.abs(now - prev12),
    }


def bridge(i: int, w: dict[str, np.ndarray], rows: np.ndarray, cfg: QCConfig, forest: ForestVoter) -> float:
    """The value that bridges a frozen stretch up to window i's last reading: that of the nearest earlier reading that is not frozen.

    `rows` are the window's readings (VALUES). Within a run of equal values the first three are never frozen.
    """
    one = {k: v[i : i + 1] for k, v in w.items()}
    run, width = int(one["repeat_length"][0]), w["T"].shape[1]
    limits = (cfg.temperature_limits, cfg.humidity_limits, cfg.pressure_limits)
    above = lambda x, limit: bool(x > limit)  # noqa: E731  unknown values are not
    for back in range(1, run):
        j, length = width - 1 - back, run - back
        f = {k: float(v[0]) for k, v in _at(one["T"], j, one, cfg).items()}
        values = rows[j, :3]
        fired = any(np.isnan(v) or v < low or v > high for v, (low, high) in zip(values, limits))
        fired = fired or above(abs(f["temperature_zscore_24h"]), cfg.z_limit) or above(abs(f["temperature_deviation_24h"]), cfg.deviation_limit)
        still = length >= cfg.freeze_run and (cfg.freeze_std is None or f["temperature_std_6h"] <= cfg.freeze_std)
        fired = fired or above(f["absolute_temperature_change"], cfg.change_limit) or still or above(abs(f["temperature_trend_6h"]), cfg.trend_limit)
        if not fired:
            named = dict(zip(VALUES, map(float, rows[j]))) | f | {"repeat_length": float(length)}
            fired = forest.fires(named)
        spike = above(f["absolute_temperature_change"], float(one["thr_change"][0])) or above(f["local_temperature_residual"], float(one["thr_residual"][0]))
        frozen = not spike and length >= cfg.frozen_min_repeat and f["temperature_std_6h"] <= float(one["low_spread"][0])
        if frozen and fired:
            continue
        if not (spike and fired):
            return float(values[0])
        repaired = f["previous_12h_median"] if np.isnan(f["previous_6h_median"]) else f["previous_6h_median"]
        if not np.isnan(repaired):
            return repaired
    return np.nan


class LiveContext(StatefulProcessor):
    """Keeps a station's last `kept` readings and gives out the context of each new one.

    A micro-batch's readings are taken in time order. One at or before the station's last reading (or without a time) is
    placed an hour after that and is not kept; all others enter the ring, those with missing values too.
    Wind and name are the last known ones. The state is a few kilobytes per station, whatever its history.
    """

    def __init__(self, kept: int, least: int, forest: ForestVoter, cfg: QCConfig):
        self.kept, self.least, self.forest, self.cfg = kept, least, forest, cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", STATE_SCHEMA)

    def close(self) -> None:
        pass

    def _load(self) -> tuple[np.ndarray, np.ndarray, str | None]:
        if not self.ring.exists():
            return np.zeros(0, np.int64), np.zeros((0, len(VALUES))), None
        times, readings, name = self.ring.get()
        return np.frombuffer(times, np.int64), np.frombuffer(readings, np.float64).reshape(-1, len(VALUES)), name

    def _save(self, times: np.ndarray, readings: np.ndarray, name: str | None) -> None:
        self.ring.update((times[-self.kept :].tobytes(), np.ascontiguousarray(readings[-self.kept :]).tobytes(), name))

    @staticmethod
    def _arrays(frames: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Times (micros), readings and names, in time order; unknown times come first."""
        df = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        times = df["ts"].to_numpy("datetime64[us]").view(np.int64)
        order = np.argsort(times, kind="stable")
        return times[order], df[list(VALUES)].to_numpy(float)[order], df["station_name"].to_numpy(object)[order]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        frames = [initialState] if isinstance(initialState, pd.DataFrame) else list(initialState)
        times, readings, names = self._arrays([f.dropna(subset=["ts"]) for f in frames])
        old_times, old, name = self._load()
        known = [n for n in names if n is not None]
        self._save(np.concatenate([old_times, times]), np.concatenate([old, readings]), known[-1] if known else name)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        old_times, old, name = self._load()
        times, readings, names = self._arrays(frames)
        last = old_times[-1] if len(old_times) else NOT_A_TIME
        fresh = (times > last) & np.append(True, times[1:] != times[:-1]) & (times != NOT_A_TIME)
        # wind and name of a kept reading without its own are those before it
        line, wind, called = np.flatnonzero(fresh), readings[:, 3].copy(), names.copy()
        so_far = old[-1, 3] if len(old) else np.nan
        for k in line:
            so_far = wind[k] = so_far if np.isnan(wind[k]) else wind[k]
            name = called[k] = called[k] if called[k] is not None else name
        first_name = self._load()[2]
        all_times = np.concatenate([old_times, times[fresh]])
        kept = np.concatenate([readings[:, :3], wind[:, None]], axis=1)[fresh]
        whole = np.concatenate([old, kept])
        # how many kept readings come before each one: its context
        ends = len(old) + np.cumsum(fresh) - fresh
        before_name = np.array([first_name, *called[line]], object)[ends - len(old)]
        for a in range(0, len(times), CHUNK):
            part = slice(a, a + CHUNK)
            yield self._context(int(key[0]), times[part], fresh[part], readings[part], ends[part], all_times, whole, before_name[part])
        self._save(all_times, whole, name)

    def _context(self, station, times, fresh, readings, ends, all_times, whole, names) -> pd.DataFrame:
        place = ends[:, None] - self.kept + np.arange(self.kept)
        windows = np.full((len(ends), self.kept + 1, len(VALUES)), np.nan)
        have = place >= 0
        windows[:, :-1][have] = whole[place[have]]
        windows[:, -1] = readings
        rows = np.minimum(ends, self.kept)
        wind = windows[:, -2, 3]
        windows[:, -1, 3] = np.where(np.isnan(wind), 0.0, wind)
        w = window_features(windows[:, :, 0], rows + 1, self.cfg)
        after = np.where(ends > 0, all_times[np.maximum(ends - 1, 0)] + HOUR if len(all_times) else 0, NOT_A_TIME)
        placed = np.where(fresh | (ends == 0), times, after)
        ready = (rows >= self.least) & ~np.isnan(readings[:, :3]).any(1)
        bridged, middle = np.full(len(ends), np.nan), np.full(len(ends), np.nan)
        for i in np.flatnonzero(ready & (w["repeat_length"] >= self.cfg.frozen_min_repeat)):
            bridged[i] = bridge(i, w, windows[i], self.cfg, self.forest)
        lost = np.flatnonzero(ready & np.isnan(w["previous_12h_median"]) & ~np.isnan(w["previous_6h_median"]))
        if len(lost):
            t = windows[lost, :, 0]
            prev = np.concatenate([np.full((len(lost), 1), np.nan), t[:, :-1]], axis=1)
            middle[lost] = quantile(_median(_last(prev, 12), 6), 0.5)
        out = {
            "station_id": station,
            "asked_ts": times.view("datetime64[us]"),
            "ts": placed.view("datetime64[us]"),
            "station_name": names,
            **{v: windows[:, -1, k] for k, v in enumerate(VALUES)},
            "history_rows": rows.astype(np.int32),
            "repeat_length": w["repeat_length"].astype(np.int64),
            "sign_flips": w["sign_flips"].astype(np.int64),
        }
        w |= {"median_12h": middle, "bridged": bridged}
        return pd.DataFrame(out | {f: w[f] for f in FEATURES})
