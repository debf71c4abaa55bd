"""The union of many rings as its outline: directed edges with the inside on the left, holes included.

Every edge is cut where edges of other rings of its group cross or touch it. A piece belongs to the outline if no ring lies
to the right of its middle; pieces that lie on each other count once. Edges, and points and rings, meet by group and cell,
so a group of any number of rings is spread over tasks. The area follows from the pieces alone, and a union of unions from
their rings; `walked` joins pieces to rings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrelake.functions.geo import cross_sum, winding
from gyrelake.sources.tables import written

#: How far beside a piece its right side is tested, and to how many digits ends are the same.
BESIDE, DIGITS = 1e-7, 9


def _cells(df: DataFrame, size: float, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    """A row for each cell that a box meets, a little more than the box, so that neighbours at a cell's edge meet."""
    along = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - BESIDE) / size), F.floor((F.greatest(a, b) + BESIDE) / size)))
    return df.withColumn("_i", along(x0, x1)).withColumn("_j", along(y0, y1))


def edges_of(rings: DataFrame, group: str) -> DataFrame:
    """group, rid, k, x0, y0, x1, y1: edges of closed rings (group, rid, ring), turned so that the inside lies left."""
    turned = rings.withColumn("ring", F.when(cross_sum(F.col("ring")) < 0, F.reverse("ring")).otherwise(F.col("ring")))
    n = F.size("ring") - 1
    sides = turned.select(group, "rid", F.posexplode(F.arrays_zip(F.slice("ring", 1, n).alias("a"), F.slice("ring", 2, n).alias("b"))).alias("k", "e"))
    flat = sides.select(group, "rid", "k", F.col("e")["a"]["x"].alias("x0"), F.col("e")["a"]["y"].alias("y0"), F.col("e")["b"]["x"].alias("x1"), F.col("e")["b"]["y"].alias("y1"))
    return flat.where("x0 <> x1 or y0 <> y1")


def _cuts(edges: DataFrame, group: str, size: float) -> DataFrame:
    """group, rid, k, ts: the shares of an edge at which edges of other rings meet it."""
    box = ("x0", "x1", "y0", "y1")
    a = _cells(edges, size, *[F.col(c) for c in box])
    b = a.select(group, "_i", "_j", F.col("rid").alias("_rid"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    both = a.join(b.hint("merge"), [group, "_i", "_j"]).where("rid <> _rid")
    # a pair that shares several cells is taken in the first
    first = lambda c: F.floor((F.greatest(F.least(f"{c}0", f"{c}1"), F.least(f"_{c}0", f"_{c}1")) - BESIDE) / size)
    both = both.where((F.col("_i") == first("x")) & (F.col("_j") == first("y")))
    dx, dy, ex, ey = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    ox, oy = F.col("_x0") - F.col("x0"), F.col("_y0") - F.col("y0")
    cross, own = dx * ey - dy * ex, dx * dx + dy * dy
    flat = F.abs(cross) <= 1e-12 * own
    t, u = F.try_divide(ox * ey - oy * ex, cross), F.try_divide(ox * dy - oy * dx, cross)
    on_line = F.abs(ox * dy - oy * dx) <= 1e-9 * own
    along = lambda x, y: (x * dx + y * dy) / own
    found = F.when(~flat, F.when((t > 0) & (t < 1) & (u >= -1e-12) & (u <= 1 + 1e-12), F.array(t))).when(on_line, F.array(along(ox, oy), along(ox + ex, oy + ey)))
    ts = both.select(group, "rid", "k", F.explode(found).alias("t")).where("t > 0 and t < 1")
    return ts.groupBy(group, "rid", "k").agg(F.sort_array(F.collect_set(F.round("t", 12))).alias("ts"))


def outline(rings: DataFrame, group: str = "track", size: float = 1.0) -> DataFrame:
    """group, x0, y0, x1, y1: the outline's pieces of each group of rings (group, rid, ring; rid unique in its group). size:
    the cells' width, about a ring's."""
    edges = written(edges_of(rings, group))
    cut = edges.join(_cuts(edges, group, size), [group, "rid", "k"], "left").withColumn("ts", F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    at = lambda t, a, b: F.when(t == 0, F.col(a)).when(t == 1, F.col(b)).otherwise(F.col(a) + t * (F.col(b) - F.col(a)))
    n = F.size("ts") - 1
    piece = cut.withColumn("p", F.explode(F.arrays_zip(F.slice("ts", 1, n).alias("s"), F.slice("ts", 2, n).alias("t")))).withColumns({"s": F.col("p")["s"], "t": F.col("p")["t"]})
    ends = {f"{c}{k}": F.round(at(F.col(p), f"{c}0", f"{c}1"), DIGITS) for c in "xy" for k, p in ((0, "s"), (1, "t"))}
    one = piece.select(group, *[v.alias(c) for c, v in ends.items()]).where("x0 <> x1 or y0 <> y1").distinct()
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = F.hypot(dx, dy)
    x, y = (F.col("x0") + F.col("x1")) / 2 + dy / length * BESIDE, (F.col("y0") + F.col("y1")) / 2 - dx / length * BESIDE
    edge = lambda pick, c: pick(F.transform("ring", lambda p: p[c]))
    boxed = rings.select(F.col(group).alias("_g"), "ring", *[edge(pick, c).alias(f"_{c}{k}") for c in "xy" for k, pick in ((0, F.array_min), (1, F.array_max))])
    covered = _cells(boxed, size, *[F.col(c) for c in ("_x0", "_x1", "_y0", "_y1")])
    # a ring's box is asked before the ring, and a piece that one ring holds asks no other
    cell = (F.col(group) == F.col("_g")) & (F.floor(x / size) == F.col("_i")) & (F.floor(y / size) == F.col("_j"))
    inner = cell & x.between(F.col("_x0"), F.col("_x1")) & y.between(F.col("_y0"), F.col("_y1")) & (winding(F.col("ring"), x, y) != 0)
    return one.join(covered.hint("merge"), inner, "left_anti").select(group, "x0", "y0", "x1", "y1")


def areas(pieces: DataFrame, group: str = "track") -> DataFrame:
    """group, area, pieces: holes taken off."""
    turn = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    return pieces.groupBy(group).agg((F.sum(turn) / 2).alias("area"), F.count("*").alias("pieces"))


def _walk(pdf: pd.DataFrame) -> Iterator[list[tuple[float, float]]]:
    """Rings from pieces that follow each other; where several go on from one place, the one that turns right most, so that rings that touch stay apart."""
    start, end = list(zip(pdf["x0"], pdf["y0"], strict=True)), list(zip(pdf["x1"], pdf["y1"], strict=True))
    out: dict[tuple, list[int]] = {}
    for k, p in enumerate(start):
        out.setdefault(p, []).append(k)
    used = np.zeros(len(start), bool)
    for first in range(len(start)):
        if used[first]:
            continue
        ring, at = [start[first]], first
        while not used[at]:
            used[at] = True
            ring.append(end[at])
            heading = math.atan2(end[at][1] - start[at][1], end[at][0] - start[at][0])
            ways = [k for k in out.get(end[at], []) if not used[k]]
            if not ways:
                break
            at = max(ways, key=lambda k: (math.atan2(end[k][1] - start[k][1], end[k][0] - start[k][0]) - heading + math.pi) % (2 * math.pi))
        yield ring


def walked(pieces: DataFrame, group: str = "track") -> DataFrame:
    """group, part, hole, ring: the closed rings of each outline; holes go round clockwise."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for n, ring in enumerate(_walk(pdf.sort_values(["x0", "y0", "x1", "y1"], ignore_index=True))):
            turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
            rows.append((key[0], n, turn < 0, [{"x": float(x), "y": float(y)} for x, y in ring]))
        return pd.DataFrame(rows, columns=[group, "part", "hole", "ring"])

    kind = pieces.schema[group].dataType.simpleString()
    return pieces.groupBy(group).applyInPandas(run, f"{group} {kind}, part int, hole boolean, ring array<struct<x:double,y:double>>")
