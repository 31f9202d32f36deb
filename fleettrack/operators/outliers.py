"""Implausible positions. Filters whose state depends on what they dropped before scan a track in numpy; a track is one task's rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import KNOTS_PER_MS
from .grouped import grouped
from .track import EARTH_M

MILE_M = 1852.0


def _seconds(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").to_numpy().astype(np.int64) / 1e6


def _metres(x1, y1, x2, y2):
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _measure(x: np.ndarray, y: np.ndarray, seconds: np.ndarray | None, a, b) -> np.ndarray:
    """Metres, or metres a second, from pings a to pings b; without elapsed time infinite, or unknown where the place is the same."""
    with np.errstate(divide="ignore", invalid="ignore"):
        d = _metres(x[a], y[a], x[b], y[b])
        return d if seconds is None else d / (seconds[b] - seconds[a])


def scan(lon: np.ndarray, lat: np.ndarray, seconds: np.ndarray | None, limit: float, second_drops_first: bool) -> np.ndarray:
    """Flags of one left-to-right pass with a pointer to the last ping kept.

    With `seconds`, the measure is metres a second, else metres. A ping above `limit` is dropped; if it is the second of the
    track and `second_drops_first`, the first is dropped instead. An unknown measure keeps the ping. While pings are kept, the last one kept is
    the neighbour: measures between neighbours are one array, and only behind dropped pings is anything measured anew, in growing runs.
    """
    n = len(lon)
    x, y = np.radians(lon.astype(float)), np.radians(lat.astype(float))
    bad = np.zeros(n, bool)
    far = np.zeros(n, bool)
    far[1:] = _measure(x, y, seconds, np.arange(n - 1), np.arange(1, n)) > limit
    fast = np.flatnonzero(far)  # from their neighbour
    k = int(fast[0]) if len(fast) else n
    if second_drops_first and far[1:2].any():
        bad[0] = True
        k = int(fast[1]) if len(fast) > 1 else n
    while k < n:  # ping k is dropped: the last one kept is k - 1
        last, size = k - 1, 8
        bad[k] = True
        k += 1
        while k < n:
            run = np.arange(k, min(n, k + size))
            kept = np.flatnonzero(~(_measure(x, y, seconds, np.full(len(run), last), run) > limit))
            if len(kept):
                bad[k : k + kept[0]] = True
                k += int(kept[0])
                break
            bad[run] = True
            k, size = k + len(run), 2 * size
        at = int(np.searchsorted(fast, k, "right"))  # ping k is kept
        k = int(fast[at]) if at < len(fast) else n
    return bad


def _grouped(df: DataFrame, by: Sequence[str], out: str, fn) -> DataFrame:
    return grouped(df, by, [(out, T.BooleanType())], fn)


def implausible_speed(df: DataFrame, lon: str, lat: str, time: str, by: Sequence[str], order: Sequence[str], most_knots: float = 25, out: str = "whacky") -> DataFrame:
    """Flag pings faster than `most_knots` from the last kept ping of their track."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        return pdf.assign(**{out: scan(pdf[lon].to_numpy(float), pdf[lat].to_numpy(float), _seconds(pdf[time]), most_knots / KNOTS_PER_MS, True)})

    return _grouped(df, by, out, run)


def implausible_distance(df: DataFrame, lon: str, lat: str, by: Sequence[str], order: Sequence[str], most_miles: float = 6, out: str = "whacky") -> DataFrame:
    """Flag pings further than `most_miles` from the last kept ping of their track."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        return pdf.assign(**{out: scan(pdf[lon].to_numpy(float), pdf[lat].to_numpy(float), None, most_miles * MILE_M, False)})

    return _grouped(df, by, out, run)


def planar_speed_filter(df: DataFrame, x: str = "x", y: str = "y", time: str = "time", device: str = "device_id", order: Sequence[str] = ("time", "seq"), most_knots: float = 25) -> DataFrame:
    """Drop all pings of a device that are too fast, recompute, and repeat until none is; adds dx, dy (absolute, 0 in the first row), dt, dd and speed (knots)."""
    names = ["dx", "dy", "dt", "dd", "speed"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        while True:
            dx, dy = (np.abs(np.diff(v, prepend=v[:1])) for v in (pdf[x].to_numpy(float), pdf[y].to_numpy(float)))  # 0 in the first row
            dt = np.diff(_seconds(pdf[time]), prepend=np.nan)
            dd = np.sqrt(dx**2 + dy**2)
            with np.errstate(divide="ignore", invalid="ignore"):
                speed = dd / dt * 1.9438
            bad = speed > most_knots
            if not bad.any():
                return pdf.assign(**{n: pd.Series(v, index=pdf.index).where(~np.isnan(v), None) for n, v in zip(names, (dx, dy, dt, dd, speed), strict=True)})
            pdf = pdf[~bad]

    return grouped(df, [device], [(n, T.DoubleType()) for n in names], run)


def rms_speed_flags(df: DataFrame, lon: str, lat: str, time: str, by: Sequence[str], order: Sequence[str], most_knots: float = 20, out: str = "whacky") -> DataFrame:
    """McConnell's filter: of each run of pings whose root-mean-square speed to two neighbours on either side is above the limit, the peak goes; repeated."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        x, y, t = np.radians(pdf[lon].to_numpy(float)), np.radians(pdf[lat].to_numpy(float)), _seconds(pdf[time])
        kept = np.arange(len(pdf))
        while len(kept) >= 5:
            parts = []
            for k in (-2, -1, 1, 2):
                j = np.clip(np.arange(len(kept)) + k, 0, len(kept) - 1)
                a, b = kept, kept[j]
                h = np.sin((y[b] - y[a]) / 2) ** 2 + np.cos(y[a]) * np.cos(y[b]) * np.sin((x[b] - x[a]) / 2) ** 2
                with np.errstate(divide="ignore", invalid="ignore"):
                    parts.append(2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt(h))) / np.abs(t[b] - t[a]))
            v = np.sqrt(np.mean(np.square(parts), 0))
            v[:2] = v[-2:] = 0
            fast = np.nan_to_num(v, nan=0.0) > most_knots / KNOTS_PER_MS
            if not fast.any():
                break
            run_of = np.cumsum(np.diff(fast.astype(int), prepend=0) == 1) * fast
            peaks = [max(np.flatnonzero(run_of == r), key=lambda i: v[i]) for r in np.unique(run_of[fast])]
            kept = np.delete(kept, peaks)
        flags = np.ones(len(pdf), bool)
        flags[kept] = False
        return pdf.assign(**{out: flags})

    return _grouped(df, by, out, run)


def implausible_trip_speed(df: DataFrame, lon: str, lat: str, time: str, by: Sequence[str], order: Sequence[str], filter: bool = True, most_knots: float = 20, out: str = "whacky") -> DataFrame:
    """With `filter`, the pings that the sequential speed filter at 25 knots leaves; without, all pings with McConnell's flags at `most_knots`."""
    if filter:
        return implausible_speed(df, lon, lat, time, by, order, 25, out).where(~F.col(f"`{out}`")).drop(out)
    return rms_speed_flags(df, lon, lat, time, by, order, most_knots, out)


def peek(df: DataFrame, what: str, above: float, rid: str = ".rid", reach: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Rows with `what` > `above` and all rows whose id is within `reach` of one, in the same group where ids count within groups (`by`); adds whacky ("whacky" or "")."""
    hit = F.col(what) > above
    r = F.col(f"`{rid}`")
    near = df.where(hit).select(*[F.col(c).alias(f"_near_{c}") for c in by], F.explode(F.sequence(r - reach, r + reach)).alias("_near")).distinct()
    same = r == F.col("_near")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_near_{c}"))
    out = df.join(near, same, "left_semi")
    return out.withColumn("whacky", F.when(hit, "whacky").otherwise(""))
