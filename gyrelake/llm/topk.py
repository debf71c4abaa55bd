"""Exact top-k by inner product, by distributed histogram selection.

Vectors are turned into integers, so that scores are exact. Queries and candidates are packed into blocks of a few
thousand vectors; each block of queries is dealt to every group of candidate blocks by an equal key, and a task scores a
pair of blocks with one matrix product. The first pass counts, per query, how many scores lie in each of `BINS` equal
ranges of all possible scores; the sums over all blocks tell the range that holds the query's kth score. Further passes
count within that range until it is one score wide. A last pass keeps what lies above the kth score, and of its ties
the smallest ids.

A block can leave out of its counts the ranges below its own kth score: the kth score of all blocks together is never
lower. Each block sends k rows a query at most in every pass, whatever the data.

Defined results: vectors that are null or empty, or hold a null, NaN or infinite component, take no part, nor do rows
without an id; vectors of another length than the query's do not meet it; ties go to the smaller id; of rows repeated
with the same id each is a candidate, and as a query the smallest vector of an id counts; a query with fewer than k candidates gets them all; no queries, or an empty table,
give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrelake.llm.common import written

#: Vectors in a block of queries and of candidates; ranges counted in one pass.
QUERY_BLOCK, BLOCK, BINS = 512, 2048, 1024
BLOCKED = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())])


def _blocks(rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of integer vectors of one length: ids and values as packed 64-bit numbers."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def packed(dim: int, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], schema=BLOCKED)

    for batch in batches:
        ids = batch["id"].to_numpy()
        vectors = batch["vector"]
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        sizes = np.asarray(vectors.value_lengths())
        starts = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            waiting.setdefault(int(dim), []).append((ids[at], flat[starts[at][:, None] + np.arange(dim)]))
            if sum(len(x) for x, _ in waiting[dim]) >= rows:
                yield from (packed(int(dim), i[a : a + rows], v[a : a + rows]) for i, v in [_joined(waiting.pop(dim))] for a in range(0, len(i), rows))
    for dim, parts in waiting.items():
        i, v = _joined(parts)
        yield from (packed(dim, i[a : a + rows], v[a : a + rows]) for a in range(0, len(i), rows))


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per pair of blocks: (query ids, low ends, steps, candidate ids, scores with a query's own row at the lowest)."""
    for batch in batches:
        for r in batch.to_pylist():
            q, c = (np.frombuffer(r[x], np.int64) for x in ("q_values", "values"))
            q_ids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
            q, c = q.reshape(len(q_ids), -1), c.reshape(len(ids), -1)
            bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
            # products of doubles are exact while sums stay below 2**53
            scores = (q.astype(float) @ c.astype(float).T).astype(np.int64) if bound < 2**53 else q @ c.T
            yield q_ids, np.frombuffer(r["lows"], np.int64), np.frombuffer(r["steps"], np.int64), ids, scores, q_ids[:, None] != ids


def _counts(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (query_id, bin, n): scores in each range from the block's own kth score up; above the last range all in one."""
    schema = pa.schema([("query_id", pa.int64()), ("bin", pa.int32()), ("n", pa.int64())])
    for q_ids, lows, steps, _, scores, other in _scored(batches):
        out = [], [], []
        for q, low, step, row, use in zip(q_ids.tolist(), lows.tolist(), steps.tolist(), scores, other, strict=True):
            row = row[use & (row >= low)]
            if len(row) > k:
                row = row[row >= np.partition(row, len(row) - k)[len(row) - k]]
            bins, n = np.unique(np.minimum((row - low) // step, BINS), return_counts=True)
            out[0].extend([q] * len(bins))
            out[1].extend(bins.tolist())
            out[2].extend(n.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)


def _kept(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (query_id, vec_id, score): scores above the kth, and the k smallest ids among its ties."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    for q_ids, lows, _, ids, scores, other in _scored(batches):
        out = [], [], []
        for q, low, row, use in zip(q_ids.tolist(), lows.tolist(), scores, other, strict=True):
            above = np.flatnonzero(use & (row > low))
            ties = np.flatnonzero(use & (row == low))
            if len(ties) > k:
                ties = ties[np.argsort(ids[ties], kind="stable")[:k]]
            at = np.concatenate([above, ties])
            out[0].extend([q] * len(at))
            out[1].extend(ids[at].tolist())
            out[2].extend(row[at].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, largest norm) of each block."""
    for batch in batches:
        for r in batch.to_pylist():
            v = np.frombuffer(r["values"], np.int64).reshape(-1, r["dim"]).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), pa.array([float(np.sqrt((v * v).sum(1)).max(initial=0))])], names=["dim", "norm"])


def _with_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks with the low end of the possible scores and the step of the first pass."""
    names = ["dim", "q_ids", "q_values", "lows", "steps"]
    for batch in batches:
        for r in batch.to_pylist():
            v = np.frombuffer(r["values"], np.int64).reshape(-1, r["dim"]).astype(float)
            most = np.ceil(np.sqrt((v * v).sum(1)) * r["norm"] * (1 + 1e-9)).astype(np.int64) + 1
            steps = np.maximum((2 * most + BINS) // BINS, 1)
            yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), *(pa.array([x], pa.binary()) for x in (r["ids"], r["values"], (-most).tobytes(), steps.tobytes()))], names=names)


def _widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([max(np.frombuffer(x, np.int64).tolist(), default=1) for x in batch["steps"].to_pylist()], pa.int64())], names=["step"])


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks with the ranges that `found` (id, bin) names, cut into BINS parts."""
    names = ["dim", "q_ids", "q_values", "lows", "steps"]
    for batch in batches:
        for r in batch.to_pylist():
            ids, lows, steps = (np.frombuffer(r[x], np.int64) for x in ("q_ids", "lows", "steps"))
            bins = {x["query_id"]: x["bin"] for x in r["found"] or []}
            lows = lows + np.array([max(bins.get(i, 0), 0) for i in ids.tolist()], np.int64) * steps
            steps = np.maximum((steps + BINS - 1) // BINS, 1)
            yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), *(pa.array([x], pa.binary()) for x in (r["q_ids"], r["q_values"], lows.tobytes(), steps.tobytes()))], names=names)


QUERY_SCHEMA = "dim int, q_ids binary, q_values binary, lows binary, steps binary"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, groups: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of `vectors` for each of `queries`, its own id left out.

    Both have id (long) and vector (array of long). groups: into how many parts the candidate blocks are dealt (the
    session's shuffle partitions unless given); each part meets every query block once.
    """
    groups = groups or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clean = lambda df: df.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull()))
    blocked = "dim int, ids binary, values binary"
    candidates = written(clean(vectors).select("id", "vector").mapInArrow(partial(_blocks, BLOCK), blocked).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")))
    bounds = candidates.mapInArrow(_bounds, "dim int, norm double").groupBy("dim").agg(F.max("norm").alias("norm"))
    asked = clean(queries).groupBy("id").agg(F.min("vector").alias("vector")).mapInArrow(partial(_blocks, QUERY_BLOCK), blocked)
    state = written(asked.join(bounds, "dim").mapInArrow(_with_bounds, QUERY_SCHEMA))

    def paired(state: DataFrame) -> DataFrame:
        dealt = state.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumnRenamed("dim", "q_dim")
        both = candidates.join(dealt, "part").where(F.col("dim") == F.col("q_dim"))
        return both.select("q_ids", "q_values", "lows", "steps", "ids", "values")

    best_first = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    step = None
    while step != 1:  # each pass divides the ranges by BINS; the pass whose ranges are one score wide is the last
        step = state.mapInArrow(_widest, "step long").agg(F.max("step")).first()[0] or 1
        counts = paired(state).mapInArrow(partial(_counts, k), "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        counted = counts.withColumn("above", F.sum("n").over(best_first)).withColumn("all", F.sum("n").over(Window.partitionBy("query_id")))
        kth = counted.where(F.col("above") >= F.least(F.lit(k), "all")).groupBy("query_id").agg(F.max("bin").alias("bin"))
        owners = state.select(F.xxhash64("q_ids", "q_values").alias("block"), "q_ids").mapInArrow(_listed, "block long, query_id long")
        found = owners.join(kth, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "bin")).alias("found"))
        state = written(state.withColumn("block", F.xxhash64("q_ids", "q_values")).join(found, "block", "left").drop("block").mapInArrow(_narrowed, QUERY_SCHEMA))
    kept = paired(state).mapInArrow(partial(_kept, k), "query_id long, vec_id long, score long")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, query_id) for each id of a block."""
    for batch in batches:
        for block, raw in zip(batch["block"].to_pylist(), batch["q_ids"].to_pylist(), strict=True):
            ids = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids), pa.int64()), pa.array(ids)], names=["block", "query_id"])


def whole_numbers(column: str, scale: int = 256):
    """A column expression: each component x as floor(scale * x); null where any component is null or not finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))
