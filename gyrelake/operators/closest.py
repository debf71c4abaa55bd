"""The cheapest of a row's candidates on the next day, and one-to-one links from them; no table of all candidates is made.

A row that asks is dealt to one band of longitudes and step, rows that may answer to every band within reach, so all that a row
may take lie in one task, and only the cheapest few leave it. One-to-one links are settled step by step from these few; a row that
has been refused by all of them asks again, for the cheapest of those that would still take it. So what is shuffled grows
with the rows, however many candidates they have.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrelake.functions.geo import RADIUS
from gyrelake.sources.tables import written

FIELDS = ["obs_id", "time", "lon", "lat", "amplitude", "radius_s"]
#: Degrees of a band; asking rows, and pairs, looked at at a time; candidates that a row has at hand until it asks again.
BAND, ROWS, PAIRS, KEPT = 2.0, 256, 2_000_000, 8
FOUND = "step long, a long, b long, cost double, rank int, amplitude double, more boolean"
#: Stands for an infinite cost, as infinity stands for one that is not a number: those come last, as in an ORDER BY.
INFINITE = np.finfo(float).max


def metres(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """`geo.haversine` on arrays."""
    rad = np.radians
    h = np.sin(rad(b["lat"] - a["lat"]) / 2) ** 2 + np.cos(rad(a["lat"])) * np.cos(rad(b["lat"])) * np.sin(rad(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * RADIUS * 1000 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def step_cost(furthest: float, a: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
    """Cost of pairs as `pairs.step_candidates` has it, and whether they are candidates."""
    d = metres(a, b)
    change = lambda c: ((a[c] - b[c]) / a[c]) ** 2
    return np.sqrt(change("amplitude") + change("radius_s") + (d / 125_000.0) ** 2), d < furthest


def ellipse_cost(minor: float, major: float, a: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
    """Cost of pairs (metres) as `tracking.distance_candidates` has it, and whether they are candidates."""
    size = np.abs(a["lat"])
    wide = np.where(size < 5.0, major, np.where(size > 23.0, minor, (minor - major) / (23.0 - 5.0) * (size - 23.0) + minor))
    ahead = b["lon"] - a["lon"]
    ahead = ahead - 360 * np.round(ahead / 360)
    inside = ((ahead + (wide - minor) / 2) / ((wide + minor) / 2)) ** 2 + ((b["lat"] - a["lat"]) / minor) ** 2 < 1
    for c in ("amplitude", "radius_s"):
        inside &= (b[c] / a[c] > 1 / 2.5) & (b[c] / a[c] < 2.5)
    return metres(a, b), inside


def _cheapest(reach: float, kept: int, judge, by_cost: bool, asking: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
    """FOUND rows of one band: for each asking row its `kept` cheapest candidates (ties: the smaller id) and whether it has more."""
    none = pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
    if not len(asking) or not len(near):
        return none
    asking, near = asking.sort_values("lat"), near.sort_values("lat")
    a, all_near = ({c: df[c].to_numpy(np.int64 if c in ("obs_id", "time", "_by") else float) for c in df.columns if c in (*FIELDS, "_cost", "_by")} for df in (asking, near))
    out, size = [], max(1, min(ROWS, PAIRS // len(near)))
    for k in range(0, len(asking), size):
        row = {c: v[k : k + size] for c, v in a.items()}
        south, north = np.searchsorted(all_near["lat"], row["lat"][0] - reach, "left"), np.searchsorted(all_near["lat"], row["lat"][-1] + reach, "right")
        b = {c: v[south:north] for c, v in all_near.items()}
        n, m = len(row["lon"]), north - south
        if not m:
            continue
        aside = row["lon"][:, None] - b["lon"]
        close = (np.abs(aside - 360 * np.round(aside / 360)) <= reach) & (np.abs(row["lat"][:, None] - b["lat"]) <= reach)
        i, j = np.nonzero(close)
        with np.errstate(all="ignore"):
            cost, ok = judge({c: v[i] for c, v in row.items()}, {c: v[j] for c, v in b.items()})
        cost = np.where(np.isnan(cost), np.inf, np.where(np.isinf(cost), INFINITE, cost))
        if "_cost" in b:  # only those that are free, or would rather have this row
            first, has = cost if by_cost else np.zeros(len(cost)), b["_cost"][j]
            ok = ok & (np.isnan(has) | (first < has) | (first == has) & (row["obs_id"][i] < b["_by"][j]))
        i, j, cost = i[ok], j[ok], cost[ok]
        table = np.full((n, m), np.nan)
        table[i, j] = cost
        if kept < m:
            last = np.partition(table, kept - 1, axis=1)[:, kept - 1][:, None]
            i, j = np.nonzero((table <= last) | np.isnan(last) & ~np.isnan(table))
        count = np.bincount(i, minlength=n) if kept >= m else np.sum(~np.isnan(table), axis=1)
        cost = table[i, j]
        order = np.lexsort((b["obs_id"][j], cost, i))
        i, j, cost = i[order], j[order], cost[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, cost, place = (v[place < kept] for v in (i, j, cost, place))
        out.append(pd.DataFrame({"step": row["time"][i], "a": row["obs_id"][i], "b": b["obs_id"][j], "cost": cost, "rank": place + 1, "amplitude": row["amplitude"][i], "more": count[i] > kept}))
    return pd.concat(out, ignore_index=True) if out else none


def closest(asking: DataFrame, rows: DataFrame, reach: float, judge, kept: int = 1, by_cost: bool = True) -> DataFrame:
    """FOUND: for each row of `asking` the `kept` cheapest of `rows` of the next day within `reach` degrees that judge(a, b) ->
    (cost, candidate) lets pass. Rows with _cost and _by (what they have now) answer only to cheaper ones."""
    turn = max(1, int(360 / max(BAND, reach)))
    band = lambda d: F.floor((F.col("lon") + d) / (360 / turn))
    placed = lambda df: df.where("not (isnan(lon) or isnan(lat))")
    x = placed(asking.select(*FIELDS)).withColumns({"_step": F.col("time").cast("long"), "_i": F.pmod(band(0), F.lit(turn))})
    more = [c for c in ("_cost", "_by") if c in rows.columns]
    around = F.array_distinct(F.transform(F.sequence(band(-reach), band(reach)), lambda i: F.pmod(i, F.lit(turn))))
    y = placed(rows.select(*FIELDS, *more)).withColumns({"_step": F.col("time").cast("long") - 1, "_i": F.explode(around)})
    at = ["_step", "_i"]
    y = y.select(*[F.col(c).alias(f"b{c}") for c in y.columns])  # names of its own, as both sides may be one table
    run = partial(_cheapest, reach, kept, judge, by_cost)
    return x.groupBy(*at).cogroup(y.groupBy(*[f"b{c}" for c in at])).applyInPandas(lambda a, b: run(a, b.rename(columns=lambda c: c[1:])), FOUND)


def cheapest_steps(obs: DataFrame, kept: int, reach: float = 1.0, furthest: float = 125_000.0) -> DataFrame:
    """a, b, rank: the `kept` cheapest of `pairs.step_candidates` for each row, ties by ids; a row's places are told in its task."""
    found = closest(obs, obs, reach, partial(step_cost, furthest), kept)
    return found.select("a", "b", "rank")


#: kind: a link, a candidate that a linked row may still turn to, a row that asks again.
SETTLED = "step long, a long, b long, cost double, more boolean, kind int"
LINK, LISTED, OPEN = 0, 1, 2


def _settled(by_cost: bool, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one step after all rows have asked as far as they know: each asks in its order, and who is asked keeps the best
    of those that ask. Open are rows that nobody they know of has kept, and that have more candidates."""
    had, new = pdf[pdf["kind"] == LINK], pdf[pdf["kind"] == LISTED].sort_values(["a", "cost", "b"])
    have = {b: (c if by_cost else 0.0, a, c) for a, b, c in zip(had["a"].tolist(), had["b"].tolist(), had["cost"].tolist(), strict=True)}
    ids, start = np.unique(new["a"].to_numpy(), return_index=True)
    more = dict(zip(ids.tolist(), new["more"].to_numpy()[start].tolist(), strict=True))
    at, end = dict(zip(ids.tolist(), start.tolist(), strict=True)), dict(zip(ids.tolist(), np.append(start, len(new))[1:].tolist(), strict=True))
    asked, cost, left = new["b"].to_numpy(), new["cost"].to_numpy(), []
    for a in np.setdiff1d(ids, had["a"].to_numpy()).tolist():
        while a is not None:
            if a not in at:  # linked before, and put out now
                left.append(a)
                break
            k, free = at[a], True
            while k < end[a] and free:
                b, c = int(asked[k]), float(cost[k])
                mine, other = (c if by_cost else 0.0, a, c), have.get(b)
                if other is None or mine[:2] < other[:2]:
                    have[b], free = mine, False
                k += 1
            at[a] = k
            if free and more[a]:
                left.append(a)
            a = None if free or other is None else other[1]
    step = int(pdf["step"].iloc[0])
    links = pd.DataFrame({"step": step, "a": [v[1] for v in have.values()], "b": list(have), "cost": [v[2] for v in have.values()], "more": True, "kind": LINK})
    rest = pd.DataFrame({"step": step, "a": left, "b": 0, "cost": 0.0, "more": True, "kind": OPEN})
    # what linked rows have not asked yet and would be kept by now; what would not be, never will
    ahead = new[np.arange(len(new)) >= np.repeat([at[a] for a in ids.tolist()], np.diff(np.append(start, len(new))))] if len(new) else new
    has = links.rename(columns={"a": "_by", "cost": "_cost"})[["b", "_by", "_cost"]]
    ahead = ahead[ahead["a"].isin(links["a"])].merge(has, on="b", how="left")
    before = (ahead["cost"] < ahead["_cost"]) & by_cost | ((ahead["cost"] == ahead["_cost"]) | (not by_cost)) & (ahead["a"] < ahead["_by"])
    ahead = ahead[ahead["_by"].isna() | before]
    return pd.concat([f for f in (links, rest, ahead[list(links.columns)]) if len(f)], ignore_index=True)


def linked(obs: DataFrame, reach: float = 1.0, furthest: float = 125_000.0, by_cost: bool = True, kept: int = KEPT) -> DataFrame:
    """One-to-one links (step, a, b, cost) among `pairs.step_candidates`. by_cost: the cheapest of a step first, as
    `pairs.assigned`; else rows in order of their ids, each with its cheapest, as `tracking.assigned_in_order`.

    Either is the one matching that is stable where rows prefer the cheaper and are preferred by cost, or by id; so every row
    asks in its own order, and refusals are final.
    """
    obs = written(obs.select(*FIELDS))
    asking, held, most = obs, None, kept * obs.count()
    judge = partial(step_cost, furthest)
    while True:
        rows = obs
        if held is not None:
            has = held.select((F.col("step") + 1).alias("time"), F.col("b").alias("obs_id"), (F.col("cost") if by_cost else F.lit(0.0)).alias("_cost"), F.col("a").alias("_by"))
            rows = obs.join(has.hint("merge"), ["time", "obs_id"], "left").withColumn("_by", F.coalesce("_by", F.lit(0).cast("long")))
        found = closest(asking, rows, reach, judge, kept, by_cost).select("step", "a", "b", "cost", "more", F.lit(LISTED).alias("kind"))
        if held is not None:
            found = found.unionByName(told.where(F.col("kind") != OPEN))
        told = written(found.groupBy("step").applyInPandas(partial(_settled, by_cost), SETTLED))
        held, left = told.where(F.col("kind") == LINK), told.where(F.col("kind") == OPEN)
        size = left.count()
        if not size:
            cost = F.when(F.col("cost") == float("inf"), float("nan")).when(F.col("cost") == float(INFINITE), float("inf")).otherwise(F.col("cost"))
            return held.select(F.col("step").cast(obs.schema["time"].dataType).alias("step"), "a", "b", cost.alias("cost"))
        kept = max(kept, most // size)  # the fewer ask again, the more each of them gets at hand
        asking = obs.join(left.select(F.col("step").alias("time"), F.col("a").alias("obs_id")).hint("merge"), ["time", "obs_id"], "left_semi")
