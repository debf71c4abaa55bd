"""Hard negatives by inner product, over an index of one-dimensional distance keys.

A vector x gets one coordinate more, sqrt(M^2 - |x|^2), where M is the largest norm of all; a query gets 0. Then the nearest
vector is the one of largest inner product, and the triangle inequality holds. Every row belongs to its nearest pivot;
rows are stored sorted by (pivot, distance from it), in blocks that name the interval of their distances. A query whose
distance from a pivot is d finds all rows within r of itself in the interval [d - r, d + r] of that pivot's keys. A search
begins with the intervals of radius 0 and widens them round by round: each round reads the blocks that the wider intervals
meet and the narrower did not, and keeps the best of each request; it ends when r is at least the distance of every
request's last result (or of its lowest allowed score), as then no unread row can come before it. Queries near one pivot are packed
into blocks, whose intervals are read together. Pivots come from a sample of at most `SAMPLE` rows; every row is indexed,
and the results do not depend on the pivots.

A request asks for the first k rows of a query's own label, or of other labels, by (score, smaller id), with scores between
two bounds. Positives are one request an anchor; negatives one request for each positive, with scores from a share of the
positive's score up to that score.

Defined results: rows with a null id or label, or a vector that is null or empty or holds a null or non-finite component,
take no part; vectors of another length than the query's do not meet it; of rows repeated with one id each is a candidate,
and as an anchor the one with the smallest (label, vector) counts; an anchor does not meet rows of its own id; ties go to the smaller id; anchors without positives, and positives with a
negative score or no row in their band, give no rows; an empty table gives an empty result. Other columns are not read.
Components are whole numbers; sums of products must fit into 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrelake.llm.common import written

#: Rows that pivots are fitted on, pivots of each length of vectors, rows in a block of the index and of queries.
SAMPLE, PIVOTS, BLOCK, QUERIES = 4096, 16, 1024, 256
#: Into how many parts the blocks of one pivot are dealt.
SALTS = 8
MOST_SCORE = 1 << 62
INDEXED = "dim int, pivot int, low double, high double, ids binary, labels binary, width int, values binary"
ASKED = "dim int, pivot int, ids binary, labels binary, width int, values binary, distances binary, of binary, kinds binary, floors binary, caps binary, numbers binary"
STATE = "needs binary, reach binary, spans array<struct<pivot:int,low:double,high:double,low0:double,high0:double>>, open boolean"
REQUEST = "array<struct<number:int,same:boolean,floor:long,cap:long>>"


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in the fewest bytes that hold them all: the width and the bytes."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return width, values.astype(f"i{width}").tobytes()


def _vectors(raw: bytes, width: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, f"i{width}").reshape(-1, dim).astype(np.int64)


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


@dataclass(frozen=True)
class Pivots:
    """of: for each length of vectors, the pivots with their added coordinate; longest: the largest norm of all rows."""

    of: dict[int, np.ndarray]
    longest: float

    def centres(self, dim: int) -> np.ndarray:
        """Those of a length; a length that the sample lacks has one pivot, the origin."""
        return self.of[dim] if dim in self.of else np.zeros((1, dim + 1))

    def raised(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))[:, None]], 1)

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """From every pivot, a row for each of x."""
        points = np.concatenate([x.astype(float), np.zeros((len(x), 1))], 1) if query else self.raised(x)
        return np.stack([np.sqrt(((points - c) ** 2).sum(1)) for c in self.centres(x.shape[1])], 1) if len(x) else np.zeros((0, len(self.centres(x.shape[1]))))

    @property
    def slack(self) -> float:
        """More than rounding takes from a distance."""
        return 1e-6 * (self.longest + 1)


def _fitted(points: np.ndarray, pivots: int) -> np.ndarray:
    """Centres of `points` by a few rounds of k-means from the first different ones."""
    _, first = np.unique(points, axis=0, return_index=True)
    centres = points[np.sort(first)[:pivots]].copy()
    for _ in range(8):
        nearest = np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, 1)
        for k in range(len(centres)):
            if (nearest == k).any():
                centres[k] = points[nearest == k].mean(0)
    return centres


def _keyed(pivots: Pivots, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with dim, pivot and distance."""
    for batch in batches:
        vectors = batch["vector"]
        flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.asarray(vectors.value_lengths())
        starts = np.cumsum(sizes) - sizes
        pivot, distance = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            far = pivots.distances(flat[starts[at][:, None] + np.arange(dim)], False)
            pivot[at] = far.argmin(1)
            distance[at] = far.min(1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(pivot), pa.array(distance)], names=[*batch.schema.names, "dim", "pivot", "distance"])


def _blocks(rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """Rows in order of (dim, pivot), cut where those change and after so many."""
    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        waiting = (pa.concat_tables([waiting, table]) if waiting is not None else table).combine_chunks()
        key = waiting["dim"].to_numpy().astype(np.int64) << 32 | waiting["pivot"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        done = 0
        for a, b in zip(edges, edges[1:], strict=False):
            whole = b if b < len(key) else a + (b - a) // rows * rows  # the last group may go on in the next batch
            for x in range(a, whole, rows):
                part = waiting.slice(x, min(rows, whole - x))
                yield int(key[x] >> 32), int(key[x] & 0xFFFFFFFF), part
            done = max(done, whole)
        waiting = waiting.slice(done)
    if waiting is not None and waiting.num_rows:
        yield waiting["dim"][0].as_py(), waiting["pivot"][0].as_py(), waiting


def _table_vectors(part: pa.Table, dim: int) -> np.ndarray:
    return part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _indexed(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dim, pivot, part in _blocks(BLOCK, batches):
        distance = part["distance"].to_numpy()
        yield _row(schema, dim, pivot, float(distance.min()), float(distance.max()), part["id"].to_numpy().tobytes(), part["label"].to_numpy().tobytes(), *_packed(_table_vectors(part, dim)))


@dataclass(frozen=True)
class Index:
    """pivots, and the table of blocks: block, dim, pivot, low, high (of distances), and the packed rows."""

    pivots: Pivots
    blocks: DataFrame


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of flat columns."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def usable(rows: DataFrame) -> DataFrame:
    """id, label, vector of the rows that take part."""
    clean = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
    return rows.where(clean & ~F.exists("vector", lambda x: x.isNull())).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")


def build_index(rows: DataFrame, pivots: int = PIVOTS) -> Index | None:
    """Index of rows (id long, label long, vector array of long); None if there are none."""
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = rows.agg(F.max(norm)).first()[0]
    if longest is None:
        return None
    sample = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).collect()
    lengths = {len(r["vector"]) for r in sample}
    raised = Pivots({}, float(np.sqrt(longest)))
    of = {n: _fitted(raised.raised(np.array([r["vector"] for r in sample if len(r["vector"]) == n], np.int64)), pivots) for n in lengths}
    fitted = Pivots(of, raised.longest)
    keyed = rows.mapInArrow(partial(_keyed, fitted), "id long, label long, vector array<long>, dim int, pivot int, distance double")
    order = ["dim", "pivot", "distance", "id"]  # the id, as rows with one distance may be a third of all
    packed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_indexed, _arrow(INDEXED)), INDEXED)
    return Index(fitted, written(packed.withColumn("block", F.monotonically_increasing_id())))


def _asked(schema: pa.Schema, pivots: Pivots, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dim, pivot, part in _blocks(QUERIES, batches):
        x = _table_vectors(part, dim)
        requests = [(i, r["same"], r["floor"], r["cap"], r["number"]) for i, rs in enumerate(part["requests"].to_pylist()) for r in rs]
        of, same, floor, cap, number = (np.array(v, t) for v, t in zip(zip(*requests, strict=True), ("i4", "i1", "i8", "i8", "i4"), strict=True))
        arrays = (pivots.distances(x, True), of, same, floor, cap, number)
        yield _row(schema, dim, pivot, part["id"].to_numpy().tobytes(), part["label"].to_numpy().tobytes(), *_packed(x), *(v.tobytes() for v in arrays))


def _reach(pivots: Pivots, x: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The distance, of each query, within which all rows of such scores lie."""
    x = x.astype(float)
    norm = (x * x).sum(1)
    far = np.sqrt(np.maximum(norm + pivots.longest**2 - 2 * scores.astype(float), 0))
    return np.minimum(far, np.sqrt(norm) + pivots.longest) + pivots.slack


def _aimed(pivots: Pivots, rounds: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next round of each block of queries: needs (the lowest score of use, per request), reach (per query) and spans
    (per pivot: keys to read, and keys read already). Blocks whose reach was enough already are not open."""
    span = pa.list_(pa.struct([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("low0", pa.float64()), ("high0", pa.float64())]))
    for batch in batches:
        for r in batch.to_pylist():
            x = _vectors(r["values"], r["width"], r["dim"])
            far = np.frombuffer(r["distances"]).reshape(len(x), -1)
            of, floors, numbers = np.frombuffer(r["of"], "i4"), np.frombuffer(r["floors"], "i8"), np.frombuffer(r["numbers"], "i4")
            kth = {(f["id"], f["number"]): f["score"] for f in r["found"] or []}
            ids = np.frombuffer(r["ids"], "i8")
            needs = np.array([max(kth.get((int(ids[i]), int(n)), f), f) for i, n, f in zip(of, numbers, floors.tolist(), strict=True)], np.int64)
            lowest = np.full(len(x), MOST_SCORE, np.int64)
            np.minimum.at(lowest, of, needs)
            need = _reach(pivots, x, lowest)
            before = np.frombuffer(r["reach"]) if r["reach"] is not None else None
            if before is None:
                reach = np.zeros(len(x))
            else:  # half of the way first, then all of it; while too few are found the way is doubled
                least = pivots.longest / 4
                reach = np.minimum(need, np.maximum(2 * before, np.maximum(need / 2 if rounds == 1 else need, least) if lowest.min() > -MOST_SCORE else least))
                reach = np.maximum(reach, before)
            low, high = (far - reach[:, None]).min(0) - pivots.slack, (far + reach[:, None]).max(0) + pivots.slack
            # the first round reads what lies at the queries' own distances from their own pivot
            spans, past = [], {s["pivot"]: s for s in r["spans"] or []}
            for p in range(far.shape[1]) if before is not None else [r["pivot"]]:
                old = past.get(p)
                new = {"pivot": p, "low": low[p], "high": high[p], "low0": old["low"] if old else None, "high0": old["high"] if old else None}
                if old:
                    new |= {"low": min(low[p], old["low"]), "high": max(high[p], old["high"])}
                spans.append(new)
            still = before is None or bool((need > before).any())
            out = {"needs": needs.tobytes(), "reach": reach.tobytes(), "spans": spans, "open": still}
            kept = [batch.schema.field(n) for n in batch.schema.names if n not in ("found", *out)]
            arrays = [pa.array([r[f.name]], f.type) for f in kept]
            arrays += [pa.array([out["needs"]], pa.binary()), pa.array([out["reach"]], pa.binary()), pa.array([out["spans"]], span), pa.array([out["open"]], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f.name for f in kept), *out])


def _scanned(k: int, pivots: Pivots, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, number, vec_id, score): of a block of queries and a block of rows, the k best of each request at most."""
    schema = pa.schema([("id", pa.int64()), ("number", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
    for batch in batches:
        for r in batch.to_pylist():
            q, x = _vectors(r["q_values"], r["q_width"], r["dim"]), _vectors(r["values"], r["width"], r["dim"])
            q_ids, ids = np.frombuffer(r["q_ids"], "i8"), np.frombuffer(r["ids"], "i8")
            q_labels, labels = np.frombuffer(r["q_labels"], "i8"), np.frombuffer(r["labels"], "i8")
            of, same = np.frombuffer(r["of"], "i4"), np.frombuffer(r["kinds"], "i1").astype(bool)
            needs, caps, numbers = np.frombuffer(r["needs"], "i8"), np.frombuffer(r["caps"], "i8"), np.frombuffer(r["numbers"], "i4")
            bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * r["dim"]
            scores = (q.astype(float) @ x.astype(float).T).astype(np.int64) if bound < 2**53 else q @ x.T
            use = (scores[of] >= needs[:, None]) & (scores[of] <= caps[:, None]) & (q_ids[of][:, None] != ids)
            use &= (q_labels[of][:, None] == labels) == same[:, None]
            out: list[list[np.ndarray]] = [[], [], [], []]
            for j in np.flatnonzero(use.any(1)):
                at = np.flatnonzero(use[j])
                mine = scores[of[j], at]
                best = np.lexsort((ids[at], -mine))[:k]
                for column, v in zip(out, (np.full(len(best), q_ids[of[j]]), np.full(len(best), numbers[j]), ids[at[best]], mine[best]), strict=True):
                    column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), f.type) for v, f in zip(out, schema, strict=True)], schema=schema)


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(queries, id) of each block of queries."""
    for batch in batches:
        for block, raw in zip(batch["queries"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            ids = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids)], names=["queries", "id"])


def search(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """id, number, rank (from 1), vec_id, score: the k best rows of each request. asked: id, label, vector, and requests
    (number, same label or another, lowest and highest score); ids differ."""
    spark = asked.sparkSession
    keyed = asked.mapInArrow(partial(_keyed, index.pivots), f"id long, label long, vector array<long>, requests {REQUEST}, dim int, pivot int, distance double")
    order = ["dim", "pivot", "id"]
    packed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_asked, _arrow(ASKED), index.pivots), ASKED)
    blocks = packed.withColumn("queries", F.monotonically_increasing_id())
    blocks = written(blocks)
    owners = blocks.select("queries", "ids").mapInArrow(_owners, "queries long, id long")
    none = spark.createDataFrame([], f"queries long, {STATE}")
    state, found = blocks.join(none, "queries", "left"), spark.createDataFrame([], "id long, number int, vec_id long, score long")
    meta = index.blocks.select("block", "dim", "pivot", "low", "high", F.pmod("block", F.lit(SALTS)).cast("int").alias("salt"))
    best_first = Window.partitionBy("id", "number").orderBy(F.desc("score"), "vec_id")
    columns = f"{ASKED}, queries long, {STATE}"
    names = [x.name for x in spark.createDataFrame([], columns).schema]
    rounds = 0
    while True:
        kth = found.groupBy("id", "number").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
        needs = kth.join(owners, "id").groupBy("queries").agg(F.collect_list(F.struct("id", "number", "score")).alias("found"))
        state = state.select(names).join(needs, "queries", "left").select(*names, "found")
        state = written(state.mapInArrow(partial(_aimed, index.pivots, rounds), columns))
        live = state.where("open")
        if live.isEmpty():
            break
        spans = live.select("queries", F.col("dim").alias("d"), F.explode("spans").alias("s")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = (F.col("d") == F.col("dim")) & (F.col("s.pivot") == F.col("pivot")) & (spans["salt"] == meta["salt"])
        fresh = (F.col("high") >= F.col("s.low")) & (F.col("low") <= F.col("s.high"))
        read = F.coalesce((F.col("high") >= F.col("s.low0")) & (F.col("low") <= F.col("s.high0")), F.lit(False))
        pairs = spans.join(meta, met & fresh & ~read).select("queries", "block")
        asking = live.select("queries", "of", "kinds", "needs", "caps", "numbers", *(F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "width", "values")))
        rows = index.blocks.select("block", "dim", "ids", "labels", "width", "values")
        new = pairs.join(asking, "queries").join(rows, "block").mapInArrow(partial(_scanned, k, index.pivots), "id long, number int, vec_id long, score long")
        found = written(found.unionByName(new).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).drop("rank"))
        rounds += 1
    return found.withColumn("rank", F.row_number().over(best_first)).select("id", "number", "rank", "vec_id", "score")


def lowest_share(score: Column, percent: int) -> Column:
    """The smallest whole number n with 100 * n >= percent * score, for scores from 0 up."""
    rest = 100 - percent
    return score - (F.floor(score / F.lit(100).cast("decimal(20,0)")).cast("long") * rest + F.floor(F.pmod(score, F.lit(100)) * rest / 100).cast("long"))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of `anchors` (rows among `rows`: id,
    label, vector) its best rows of the same label, and for each of those the best of other labels that score `percent` to 100 of it."""
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = usable(rows)
    index = build_index(rows)
    if index is None:
        return rows.sparkSession.createDataFrame([], result)
    one = usable(anchors).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.label", "v.vector")
    one = written(one)
    every = F.array(F.struct(F.lit(0).alias("number"), F.lit(True).alias("same"), F.lit(-MOST_SCORE).alias("floor"), F.lit(MOST_SCORE).alias("cap")))
    best = search(index, one.withColumn("requests", every.cast(REQUEST)), positives)
    best = written(best.select("id", F.col("rank").cast("int").alias("number"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score")
    band = F.struct("number", F.lit(False).alias("same"), lowest_share(score, percent).alias("floor"), score.alias("cap"))
    wanted = best.where(score >= 0).groupBy("id").agg(F.collect_list(band).cast(REQUEST).alias("requests"))
    found = search(index, one.join(wanted, "id"), negatives)
    return found.join(best, ["id", "number"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
