"""Networks: rows linked over time, their components, segments, events and relatives.

Nodes are rows with obs_id, track (the network; 0 is the trash), segment, time, next_id and prev_id (null: none).
Loops over the graph write each round out, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrelake.operators.pairs import box_pairs, box_score, match, near_centres, with_box
from gyrelake.operators.tracks import numbered, renumbered
from gyrelake.sources.observations import union_all
from gyrelake.sources.tables import written

#: Rows that a join sends to all tasks rather than shuffle its other side.
FEW = 10_000


def by_segment():
    return Window.partitionBy("track", "segment")


def time_edges(obs: DataFrame, window: int, delta: float | None = None, least: float = 0.2, half: float | None = None) -> DataFrame:
    """a, b, lag, score: rows up to `window` days apart that overlap (rings; half: boxes of that half width around the
    centres), or whose centres are within delta degrees."""
    # only what the pairs are told by goes along: every row is dealt to cells with all its columns
    early = obs.select("obs_id", "time", *(("lon", "lat") if half or delta else ("ring",)))
    late = early.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(window)))).withColumn("time", F.col("time") - F.col("lag"))
    if half:
        pairs = box_pairs(with_box(early, half), with_box(late, half), max(1.0, 2 * half), ["time"]).withColumn("score", box_score()).where((F.col("score") >= least) & (F.col("score") > 0))
    else:
        pairs = near_centres(early, late, delta, ["time"]).withColumn("score", F.lit(1.0)) if delta else match(early, late, "union", least, ["time"])
    return pairs.select(F.col("a_obs_id").alias("a"), F.col("b_obs_id").alias("b"), F.col("b_lag").alias("lag"), "score")


def places(obs: DataFrame, id: str = "obs_id", *more: str) -> DataFrame:
    """id, rep (and more): the smallest id of the rows with the same time and centre. Rows of one place overlap with the same others, so
    edges between reps stand for those between all rows: as many as places have neighbours, however many rows they hold."""
    return obs.select(id, *more, F.min(id).over(Window.partitionBy("time", "lon", "lat")).alias("rep"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes in edges (a, b), by large-star and small-star steps.

    A step makes at most as many rows as there are edges, whatever the degree of a node. Roots are written before they
    are joined, so that both sides are shuffled for the join itself and Spark can split the rows of a hub.
    """
    pairs = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct())
    while True:
        # done when every node has one link, and that to a node that has none downwards
        roots = pairs.select(F.col("lo").alias("hi")).distinct().withColumn("is_root", F.lit(True))
        if pairs.groupBy("hi").agg(F.count("*").alias("n")).join(roots, "hi", "left").where("n > 1 or is_root").isEmpty():
            own = roots.select(F.col("hi").alias("node"), F.col("hi").alias("component"))
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(own)
        ways = pairs.unionByName(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        root = written(ways.groupBy("hi").agg(F.min("lo").alias("root")).select("hi", F.least("hi", "root").alias("root")))
        star = written(ways.join(root, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("root").alias("lo")).where("hi > lo").distinct())
        root = written(star.groupBy("hi").agg(F.min("lo").alias("root")))
        other = star.join(root, "hi").where("lo > root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        pairs = written(other.unionByName(root.withColumnRenamed("root", "lo")).distinct())


def grown(known: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all, moved): components (node, component) kept as a table, after new edges (a, b), and the components that have got
    another number (old, new). Only the new edges, with their ends replaced by the components known of them, go through
    the rounds of `components`; what is known is joined once with the numbers that have moved. The numbers are the smallest nodes, as from all
    edges at once, so old results are brought up to date by `moved`."""
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    ends = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("_a", "a").alias("_a"), F.coalesce("_b", "b").alias("_b"))
    ends = written(ends)
    joined = written(components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))))
    moved = joined.where("node <> component").select(F.col("node").alias("old"), F.col("component").alias("new"))
    own = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node", "left_anti")
    every = known.unionByName(own.select("node", F.col("node").alias("component")))
    out = every.join(moved, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    return written(out), moved.join(known.select(F.col("component").alias("old")).distinct(), "old", "left_semi")


def grouped(obs: DataFrame, edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Rows with their network's number from 1 in `track`; rows without a link are in 0. members: obs_id and rep (`places`),
    where the edges are between reps."""
    label = _of_members(components(edges).withColumnRenamed("node", "obs_id"), members)
    dense = renumbered(label.select(F.col("component").alias("track"), "obs_id"), "track", 1)
    return obs.drop("track").join(dense.hint("merge"), "obs_id", "left").withColumn("track", F.coalesce("track", F.lit(0)))


def _of_members(of_reps: DataFrame, members: DataFrame | None) -> DataFrame:
    """What is told of reps (as obs_id), told of every row of their places."""
    if members is None:
        return of_reps
    return members.join(of_reps.withColumnRenamed("obs_id", "rep").hint("merge"), "rep").drop("rep")


def best_links(edges: DataFrame, forward: bool = True) -> DataFrame:
    """obs_id, other, score: each row's best overlap in the first later (earlier) step that has any; ties to the smaller id.

    An aggregate that is combined before the shuffle, so a row with very many overlaps is no burden.
    """
    own, other = ("a", "b") if forward else ("b", "a")
    best = F.min(F.struct("lag", (-F.col("score")).alias("less"), F.col(other).alias("other")))
    return edges.groupBy(F.col(own).alias("obs_id")).agg(best.alias("_x")).select("obs_id", "_x.other", (-F.col("_x.less")).alias("score"))


def heads(links: DataFrame) -> DataFrame:
    """obs_id, head: for links (obs_id, prev_id) that form lines, the first row of each row's line. The first rows themselves
    are not in it. Every round doubles the way back, so a line of n rows takes about log2(n) rounds, each written out."""
    at = written(links.select("obs_id", F.col("prev_id").alias("head")))
    while True:
        back = at.select(F.col("obs_id").alias("head"), F.col("head").alias("_before"))
        moved = written(at.join(back.hint("merge"), "head", "left").select("obs_id", F.coalesce("_before", "head").alias("head"), F.col("_before").isNotNull().alias("_moved")))
        at = moved.select("obs_id", "head")
        if moved.where("_moved").isEmpty():
            return at


def segmented(obs: DataFrame, edges: DataFrame, chosen=best_links, members: DataFrame | None = None) -> DataFrame:
    """track, obs_id, time, segment, next_id, prev_id, next_cost, prev_cost per row of a network.

    Every row goes on to its best overlap (`chosen`; another function of (edges, forward) is another rule). Of the rows that
    go on to one target the best is followed by it in its own segment, the others end there (merging); ties to the larger
    id. A row that none goes on to begins a segment, and comes from its own best overlap backward, if it has any (splitting).
    Segments are numbered from 0 in a network, in order of their first rows (time, obs_id). All of it is joins and
    aggregates by row, so one network of any size spreads over tasks. members: obs_id and rep (`places`), where the edges are
    between reps; of equal overlaps a rep is the smallest id of its place, as the rule of ties wants it.
    """
    rows = obs.where("track > 0").select("track", "obs_id", "time")
    go = written(_of_members(chosen(edges, True), members))
    taken = go.groupBy(F.col("other").alias("obs_id")).agg(F.max(F.struct("score", F.col("obs_id").alias("prev_id"))).alias("_p"))
    taken = written(taken.select("obs_id", "_p.prev_id", "_p.score"))
    back = _of_members(chosen(edges, False), members).join(taken, "obs_id", "left_anti").select("obs_id", F.col("other").alias("_from"), F.col("score").alias("_fs"))
    line = heads(taken)
    links = rows.join(go.select("obs_id", F.col("other").alias("next_id"), F.col("score").alias("next_cost")), "obs_id", "left")
    links = links.join(taken.select("obs_id", "prev_id", F.col("score").alias("prev_cost")), "obs_id", "left").join(back, "obs_id", "left").join(line, "obs_id", "left")
    links = links.withColumns({"prev_id": F.coalesce("prev_id", "_from"), "prev_cost": F.coalesce("prev_cost", "_fs"), "head": F.coalesce("head", "obs_id")}).drop("_from", "_fs")
    links = written(links)
    first = numbered(links.where("head = obs_id").select("track", "time", "obs_id"), ["track", "time", "obs_id"], "_no")
    base = first.groupBy("track").agg(F.min("_no").alias("_base"))
    number = first.join(base, "track").select(F.col("obs_id").alias("head"), (F.col("_no") - F.col("_base")).alias("segment"))
    return links.join(number, "head").select("track", "obs_id", "time", "segment", "next_id", "prev_id", "next_cost", "prev_cost")


def relinked(net: DataFrame) -> DataFrame:
    """Links to rows that the table lacks become null."""
    ids = net.select(F.col("obs_id").alias("_id"))
    out = net
    for c in ("next_id", "prev_id"):
        out = out.join(ids.withColumnRenamed("_id", f"_{c}"), F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return out


def _edge_row(net: DataFrame, last: bool) -> DataFrame:
    order = by_segment().orderBy(F.desc("time") if last else F.asc("time"))
    return net.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def births(net: DataFrame) -> DataFrame:
    """First rows of segments that follow no other."""
    return _edge_row(net, False).where("prev_id is null and track <> 0")


def deaths(net: DataFrame) -> DataFrame:
    """Last rows of segments that nothing follows."""
    return _edge_row(net, True).where("next_id is null and track <> 0")


def merges(net: DataFrame) -> DataFrame:
    """after, before, stopped: a segment's last row goes on in another segment, whose row and own predecessor are named."""
    row = net.select(F.col("obs_id").alias("after"), F.col("segment").alias("_s"), F.col("prev_id").alias("before"), F.col("time").alias("time"))
    ends = _edge_row(net, True).where("next_id is not null").select(F.col("next_id").alias("after"), F.col("obs_id").alias("stopped"), F.col("segment").alias("_own"))
    return ends.join(row, "after").where("_s <> _own").select("after", "before", "stopped", "time")


def splits(net: DataFrame) -> DataFrame:
    """before, after, started: a segment's first row comes from another segment, whose row and own successor are named."""
    row = net.select(F.col("obs_id").alias("before"), F.col("segment").alias("_s"), F.col("next_id").alias("after"), F.col("time").alias("time"))
    starts = _edge_row(net, False).where("prev_id is not null").select(F.col("prev_id").alias("before"), F.col("obs_id").alias("started"), F.col("segment").alias("_own"))
    return starts.join(row, "before").where("_s <> _own").select("before", "after", "started", "time")


def segment_edges(net: DataFrame) -> DataFrame:
    """Undirected neighbours: track, s, o for segments joined by a link, both ways."""
    to = net.select(F.col("obs_id").alias("_id"), F.col("segment").alias("o"))
    links = union_all([net.where(f"{c} is not null").join(to, F.col(c) == F.col("_id")).where("segment <> o").select("track", F.col("segment").alias("s"), "o") for c in ("next_id", "prev_id")])
    return union_all([links, links.select("track", F.col("o").alias("s"), F.col("s").alias("o"))]).distinct()


def relatives(net: DataFrame, seeds: DataFrame, order: int = 2) -> DataFrame:
    """track, segment, distance of all segments within `order` links of the seeds (track, segment)."""
    edges = segment_edges(net)
    found = seeds.select("track", "segment").distinct().withColumn("distance", F.lit(0))
    edge = found
    for k in range(1, order + 1):
        step = edge.join(edges, (edge["track"] == edges["track"]) & (edge["segment"] == edges["s"])).select(edge["track"], F.col("o").alias("segment")).distinct()
        edge = written(step.join(found, ["track", "segment"], "left_anti").withColumn("distance", F.lit(k)))
        found = found.unionByName(edge)
    return found


def reached(net: DataFrame, seeds: DataFrame, forward: bool = True) -> DataFrame:
    """obs_ids that follow the seeds along links and within their segments from the time of entry on (or lead to them).

    The table is read once. The rounds go over the links between segments alone, not over rows: a link within a segment leads
    nowhere else, unless it goes against time."""
    known_as, own, target = ["track", "segment"], F.min if forward else F.max, "next_id" if forward else "prev_id"
    after = (lambda a, b: a >= b) if forward else (lambda a, b: a <= b)
    rows = written(net.select("obs_id", "track", "segment", "time", F.col(target).alias("_to")))
    to = rows.select(F.col("obs_id").alias("_to"), F.col("track").alias("_track"), F.col("segment").alias("_segment"), F.col("time").alias("_time"))
    within = (F.col("track") == F.col("_track")) & (F.col("segment") == F.col("_segment")) & after(F.col("_time"), F.col("time"))
    ways = written(rows.drop("obs_id").join(to.hint("merge"), "_to").where(~within).drop("_to").distinct())
    start = seeds.select("obs_id").join(rows.hint("merge"), "obs_id").groupBy(known_as).agg(own("time").alias("since"))
    known = edge = written(start)
    while n := edge.count():
        inside = ways.join(_beside(edge, n), known_as).where(after(F.col("time"), F.col("since")))
        entered = inside.groupBy(F.col("_track").alias("track"), F.col("_segment").alias("segment")).agg(own("_time").alias("since"))
        old = known.select("track", "segment", F.col("since").alias("_old"))
        better = F.col("_old").isNull() | ((F.col("since") < F.col("_old")) if forward else (F.col("since") > F.col("_old")))
        edge = written(entered.join(old.hint("merge"), known_as, "left").where(better).drop("_old"))
        known = written(known.unionByName(edge).groupBy(known_as).agg(own("since").alias("since")))
    return rows.join(_beside(known, known.count()), known_as).where(after(F.col("time"), F.col("since"))).select("obs_id")


def _beside(df: DataFrame, n: int) -> DataFrame:
    """A side of a join with n narrow rows: sent to all tasks where they are few, shuffled where not, whatever its files' size."""
    return F.broadcast(df) if n <= FEW else df.hint("merge")


def without_dead_ends(net: DataFrame, least_rows: int = 3, least_days: int = 0, rounds: int = 1) -> DataFrame:
    """Segments that are short and have fewer than two neighbours move to network 0 and lose their links."""
    for _ in range(rounds):
        size = net.where("track <> 0").groupBy("track", "segment").agg(F.count("*").alias("_n"), (F.max("time") - F.min("time")).alias("_d"))
        degree = segment_edges(net).groupBy("track", F.col("s").alias("segment")).agg(F.count("*").alias("_k"))
        gone = size.join(degree, ["track", "segment"], "left").where(((F.col("_n") < least_rows) | (F.col("_d") < least_days)) & (F.coalesce("_k", F.lit(0)) < 2)).select("track", "segment", F.lit(True).alias("_gone"))
        marked = net.join(gone, ["track", "segment"], "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
        ids = marked.where("_gone").select(F.col("obs_id").alias("_id"), F.lit(True).alias("_out"))
        for c in ("next_id", "prev_id"):
            out = ids.withColumnsRenamed({"_id": f"_i_{c}", "_out": f"_o_{c}"})
            marked = marked.join(out, F.col(c) == F.col(f"_i_{c}"), "left").withColumn(c, F.when(~F.col("_gone") & F.col(f"_o_{c}").isNull(), F.col(c))).drop(f"_i_{c}", f"_o_{c}")
        net = marked.withColumn("track", F.when(F.col("_gone"), 0).otherwise(F.col("track"))).select(*net.columns)
    return net


def dissociated(net: DataFrame) -> DataFrame:
    """New network numbers by the components of segment links."""
    node = lambda t, s: F.concat_ws("-", t, s)
    ids = net.where("track <> 0").select("track", "segment").distinct().withColumn("_node", F.xxhash64(node("track", "segment")))
    edges = segment_edges(net).where("track <> 0").select(F.xxhash64(node("track", "s")).alias("a"), F.xxhash64(node("track", "o")).alias("b"))
    label = ids.join(components(edges).withColumnRenamed("node", "_node"), "_node", "left").select("track", "segment", F.coalesce("component", "_node").alias("_c"))
    dense = renumbered(label, "_c", 1)
    return net.join(dense, ["track", "segment"], "left").withColumn("track", F.coalesce("_c", F.lit(0))).drop("_c")


def near_events(net: DataFrame, days: int = 3, merging: bool = True, splitting: bool = True) -> DataFrame:
    """Rows of the segments that meet at an event, within so many days of it."""
    events = [e.select("time", F.explode(F.array(*cols)).alias("obs_id")) for e, cols, use in ((merges(net), ("after", "before", "stopped"), merging), (splits(net), ("before", "after", "started"), splitting)) if use]
    at = union_all(events).where("obs_id is not null").join(net.select("obs_id", "track", "segment"), "obs_id").select("track", "segment", F.col("time").alias("_t")).distinct()
    return net.join(at, ["track", "segment"]).where(F.abs(F.col("time") - F.col("_t")) <= days).drop("_t").dropDuplicates(["obs_id"])


def sizes(net: DataFrame) -> DataFrame:
    """Per network: rows, segments and days from first to last row."""
    return net.where("track <> 0").groupBy("track").agg(F.count("*").alias("n_obs"), F.count_distinct("segment").alias("n_segments"), (F.max("time") - F.min("time")).alias("days"))


def longer_than(net: DataFrame, least: int = -1, most: int = -1) -> DataFrame:
    """Networks by days from first to last row, both counted; -1 is open."""
    days = net.groupBy("track").agg((F.max("time") - F.min("time") + 1).alias("_d"))
    keep = days.where((F.col("_d") >= least if least >= 0 else F.lit(True)) & (F.col("_d") <= most if most >= 0 else F.lit(True)))
    return net.join(keep.select("track"), "track", "left_semi")


def per_segment(net: DataFrame, value: Column, into: str) -> DataFrame:
    """A mean over each segment, on every row of it."""
    return net.withColumn(into, F.avg(value).over(by_segment()))


def corrected_close_events(net: DataFrame, most_days: int = 20) -> DataFrame:
    """Where a branch leaves a segment and comes back to it within so many days, its rows join the segment's number."""
    out = splits(net).select(F.col("before").alias("_from"), "started", F.col("time").alias("_t0"))
    back = merges(net).select(F.col("after").alias("_to"), "stopped", F.col("time").alias("_t1"))
    own = net.select("obs_id", "track", "segment")
    of = lambda df, c, n: df.join(own.select(F.col("obs_id").alias(c), F.col("track").alias(f"{n}_track"), F.col("segment").alias(f"{n}_segment")), c)
    leave, come = of(of(out, "_from", "p"), "started", "b"), of(of(back, "_to", "q"), "stopped", "c")
    loop = leave.join(come, (F.col("b_track") == F.col("c_track")) & (F.col("b_segment") == F.col("c_segment")) & (F.col("p_segment") == F.col("q_segment")) & (F.col("p_track") == F.col("q_track")))
    loop = loop.where(F.col("_t1") - F.col("_t0") < most_days).groupBy(F.col("b_track").alias("track"), F.col("b_segment").alias("segment")).agg(F.min("p_segment").alias("_new"))
    return net.join(loop, ["track", "segment"], "left").withColumn("segment", F.coalesce("_new", "segment")).drop("_new")


def close_networks(pairs: DataFrame, other: DataFrame, least: int = 10) -> DataFrame:
    """Rows of `other`'s networks that meet the first table in `least` pairs (b_track) at least."""
    near = pairs.groupBy("b_track").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return other.join(near.select(F.col("b_track").alias("track")), "track", "left_semi")


def only_one(net: DataFrame) -> DataFrame:
    """The table itself; ValueError if it holds more than one network."""
    if net.select("track").distinct().limit(2).count() > 1:
        raise ValueError("several networks")
    return net


def with_lifetime(net: DataFrame) -> DataFrame:
    """lifetime: days between the first and the last row of a row's network."""
    w = Window.partitionBy("track")
    return net.withColumn("lifetime", F.max("time").over(w) - F.min("time").over(w))


def segment_numbers(net: DataFrame) -> DataFrame:
    """(segment_id, track, segment): dense numbers over all segments of all networks."""
    return numbered(net.select("track", "segment"), ["track", "segment"], "segment_id")


def rekeyed(net: DataFrame, group: str = "track") -> DataFrame:
    """Rows numbered anew in the order of network, segment and time, with their links."""
    new = numbered(net.select(group, "segment", "time", "obs_id"), [group, "segment", "time", "obs_id"], "_new").select("obs_id", "_new")
    of = lambda c: new.select(F.col("obs_id").alias(c), F.col("_new").alias(f"_{c}"))
    out = net.join(new, "obs_id").join(of("next_id"), "next_id", "left").join(of("prev_id"), "prev_id", "left")
    return out.withColumns({"obs_id": F.col("_new"), "next_id": F.col("_next_id"), "prev_id": F.col("_prev_id")}).select(*net.columns)


def percentile_at_splits(net: DataFrame, value: str, window: int = 10, q: float = 0.5, least: int = 1) -> DataFrame:
    """Per split (started): the percentile of a value over both branches' rows within so many days after the event, the
    one that goes on (main) and the new one (branch); null where a branch has fewer than `least` values."""
    events = splits(net).where("after is not null").select("started", "after", F.col("time").alias("_t"))
    own = net.select(F.col("obs_id").alias("_id"), F.col("track").alias("_tr"), F.col("segment").alias("_sg"))
    out = events.select("started")
    for name, c in (("main", "after"), ("branch", "started")):
        at = events.join(own, events[c] == own["_id"]).select("started", "_tr", "_sg", "_t")
        rows = at.join(net, (F.col("_tr") == net["track"]) & (F.col("_sg") == net["segment"]) & (F.col("time") > F.col("_t")) & (F.col("time") <= F.col("_t") + window))
        stat = rows.groupBy("started").agg(F.when(F.count(value) >= least, F.percentile(value, q)).alias(name))
        out = out.join(stat, "started", "left")
    return out


def swapped(net: DataFrame, cost: str, most_main: int = 2, least_branch: int = 10, margin: float = -0.2) -> DataFrame:
    """At splits whose main line ends soon and freely, while the branch lives on and costs not much less, the labels
    change places: the main line's rows after the event take the branch's number, and the branch the main one's."""
    row = lambda n, *cs: net.select(F.col("obs_id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in cs])
    events = splits(net).where("after is not null").drop("time").join(row("before", "track", "segment", "time"), "before")
    events = events.join(row("after", "segment", cost), "after").join(row("started", "segment", "time", cost), "started")
    end = _edge_row(net, True)
    last = lambda n: end.select(F.col("track").alias("_t"), F.col("segment").alias("_s"), F.col("time").alias(f"{n}_end"), F.col("next_id").alias(f"{n}_next"))
    for n, c in (("main", "before_segment"), ("branch", "started_segment")):
        events = events.join(last(n), (F.col("before_track") == F.col("_t")) & (F.col(c) == F.col("_s"))).drop("_t", "_s")
    due = events.where((F.col("main_end") - F.col("before_time") <= most_main) & (F.col("branch_end") - F.col("started_time") >= least_branch) & F.col("main_next").isNull() & (F.col(f"started_{cost}") - F.col(f"after_{cost}") > margin))
    part = lambda old, new, since: due.select(F.col("before_track").alias("track"), F.col(old).alias("segment"), F.col(new).alias("_new"), F.col(since).alias("_since"))
    moves = part("before_segment", "started_segment", "before_time").unionByName(part("started_segment", "before_segment", "before_time"))
    # of several events of one segment the first one counts
    moves = moves.groupBy("track", "segment").agg(F.min_by("_new", "_since").alias("_new"), F.min("_since").alias("_since"))
    out = net.join(moves, ["track", "segment"], "left")
    return out.withColumn("segment", F.when(F.col("time") > F.col("_since"), F.col("_new")).otherwise(F.col("segment"))).select(*net.columns)
