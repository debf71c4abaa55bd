"""Tracking over a stream: observations arrive by day, state holds each region's open tracks.

A group is a region (a box of latitude and longitude, or a sign), so regions spread over tasks; its state is one row per
open track, and the rows of its latest day. That day stays open, over any number of micro-batches, until a later one
arrives in the region. Its rows are given out with the micro-batch that brings them, and later rows of the day are linked
with the tracks that are left; or (`hold`) they wait until the day is closed, so that the links do not depend on how a day
is split. Rows of closed days are late and are dropped, as the watermark would drop them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "region long, obs_id long, time int, track long"
STATE = "ids array<long>, time int, lon array<double>, lat array<double>, dlon array<double>, dlat array<double>, gap array<int>, open_time int, open_ids array<long>, open_lon array<double>, open_lat array<double>, open_track array<long>"


def link_day(ends: pd.DataFrame, now: pd.DataFrame, furthest_km: float) -> dict[int, int]:
    """Places in `now` by places in `ends`: nearest pairs first, each place once."""
    if ends.empty or now.empty:
        return {}
    dx = (now["lon"].to_numpy()[None] - ends["lon"].to_numpy()[:, None]) * np.cos(np.radians(now["lat"].to_numpy()))[None]
    km = np.hypot(dx, now["lat"].to_numpy()[None] - ends["lat"].to_numpy()[:, None]) * np.pi / 180 * 6370.997
    out, taken = {}, set()
    for flat in np.argsort(km, axis=None, kind="stable"):
        a, b = divmod(int(flat), len(now))
        if km[a, b] >= furthest_km:
            break
        if a not in out and b not in taken:
            out[a] = b
            taken.add(b)
    return out


def advance(ends: pd.DataFrame, now: pd.DataFrame, furthest_km: float, most_gap: int) -> tuple[pd.DataFrame, list[int]]:
    """The open tracks after a day, and the track of each row of the day. Lost tracks move on for `most_gap` days.

    A row of the day that has a track of its own (column `track`, not null) keeps it.
    """
    given = [None if pd.isna(t) else int(t) for t in now["track"]] if "track" in now else [None] * len(now)
    place = {int(t): a for a, t in enumerate(ends["id"])}
    links = {place[t]: b for b, t in enumerate(given) if t in place}
    free, new = [a for a in range(len(ends)) if a not in links], [b for b, t in enumerate(given) if t is None]
    links |= {free[a]: new[b] for a, b in link_day(ends.iloc[free], now.iloc[new], furthest_km).items()}
    back = {b: a for a, b in links.items()}
    tracks = [int(ends["id"].iloc[back[b]]) if b in back else int(now["obs_id"].iloc[b]) for b in range(len(now))]
    move = lambda c: [float(now[c].iloc[b] - ends[c].iloc[back[b]]) if b in back else 0.0 for b in range(len(now))]
    live = pd.DataFrame({"id": tracks, "lon": now["lon"].to_numpy(), "lat": now["lat"].to_numpy(), "dlon": move("lon"), "dlat": move("lat"), "gap": 0})
    lost = ends.drop(index=[ends.index[a] for a in links])
    lost = lost.assign(lon=lost["lon"] + lost["dlon"], lat=lost["lat"] + lost["dlat"], gap=lost["gap"] + 1)
    return pd.concat([live, lost[lost["gap"] <= most_gap]], ignore_index=True), tracks


def tracked(obs: DataFrame, furthest_km: float = 125.0, most_gap: int = 3, hold: bool = False) -> DataFrame:
    """Rows (region, obs_id, time, lon, lat) of a stream with their tracks, a day at a time.

    hold: a region's latest day is given out only when a later one arrives.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns, held = ["id", "lon", "lat", "dlon", "dlat", "gap"], ["obs_id", "lon", "lat", "track"]
        ends, last = pd.DataFrame({c: [] for c in columns}), None
        kept = pd.DataFrame({c: [] for c in ["time", *held]})
        if state.exists:
            ids, last, *rest = state.get
            ends = pd.DataFrame(dict(zip(columns, (ids, *rest[:5]), strict=True)))
            kept = pd.DataFrame({"time": rest[5], **dict(zip(held, rest[6:], strict=True))}).astype({"track": "Int64"})
        rows = pd.concat([f for f in [kept, *(f.assign(track=pd.array([None] * len(f), "Int64")) for f in frames)] if len(f)], ignore_index=True)
        if last is not None:
            rows = rows[rows["time"] > last]
        latest = int(rows["time"].max()) if len(rows) else None
        for day, now in rows.groupby("time", sort=True):
            now = now.sort_values("obs_id").reset_index(drop=True)
            if day == latest and hold:
                kept = now
                break
            before = ends
            for _ in range(int(day - last - 1) if last is not None else 0):  # days without any row
                if before.empty:
                    break
                before, _tracks = advance(before, now.iloc[:0], furthest_km, most_gap)
            after, tracks = advance(before, now, furthest_km, most_gap)
            out = now["track"].isna()
            yield pd.DataFrame({"region": key[0], "obs_id": now["obs_id"], "time": now["time"], "track": tracks})[out]
            if day == latest:  # given out, but later rows of the day may still come
                kept = now.assign(track=tracks)
            else:
                ends, last = after, int(day)
        numbers = lambda c: [None if pd.isna(v) else int(v) for v in kept[c]]
        state.update((
            ends["id"].astype(int).tolist(), last, *(ends[c].astype(float).tolist() for c in columns[1:5]), ends["gap"].astype(int).tolist(),
            latest, numbers("obs_id"), kept["lon"].astype(float).tolist(), kept["lat"].astype(float).tolist(), numbers("track"),
        ))

    return obs.groupBy("region").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
