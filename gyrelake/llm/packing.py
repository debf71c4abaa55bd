"""Best-fit packing of tokenised documents into sequences of a fixed length.

Pieces have three sizes: tokens, documents (1) and attention cost (the square of the tokens). All three follow from the
token count, so packing works on the histogram of piece lengths, which has at most `limit` rows whatever the input: the
lengths are taken from the longest down, and each goes to the open bin (again by counts of equal bins) that takes it
under every capacity and scores best, by the weighted dot product of the residuals with the piece, or by the norm of the
residuals it would leave. The result is a list of patterns and their counts. Pieces are then ranked within their length,
by counts of (length, slice) pairs and a window within each, and each rank finds its place in the list by its length.

Defined results: a null text equals an empty one, which holds the end id alone; documents of more than `limit` tokens
are cut into pieces of `limit`, the first of which may be shorter; rows with equal ids and texts are packed each for
itself; an empty table gives an empty result; a null doc_id is kept.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrelake.llm.common import written
from gyrelake.llm.tokens import ByteBpe

#: Characters of the texts that a task remembers, to give copies the same pieces without tokenising them again.
REMEMBERED = 16_000_000
#: Rows that one slice of the commonest length holds about, and the most slices; slices of a length are ranked apart.
SLICE, SLICES = 2_000, 65_536
PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cuts(ids: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int]]:
    """Starts, lengths and CRC-32s of the pieces: the first takes what full pieces leave."""
    n = len(ids)
    first = n % limit or limit
    starts = [0, *range(first, n, limit)]
    ends = [*starts[1:], n]
    raw = ids.astype("<u4").tobytes()
    return starts, [b - a for a, b in zip(starts, ends, strict=True)], [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]


def _pieces(path: str, limit: int, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = ByteBpe(path)
    met: dict[str, tuple] = {}
    held = 0
    for batch in batches:
        out = {name: [] for name in PIECE.names}
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            text = text or ""
            if (cut := met.get(text)) is None:
                cut = _cuts(np.append(bpe.ids(text), np.uint32(end_id)), limit)
                if held + len(text) > REMEMBERED:
                    met.clear()
                    held = 0
                if len(text) <= REMEMBERED // 100:
                    met[text] = cut
                    held += len(text)
            out["doc_id"] += [doc_id] * len(cut[0])
            out["piece"] += range(len(cut[0]))
            for name, values in zip(("start", "length", "ids_crc32"), cut, strict=True):
                out[name] += values
        yield pa.RecordBatch.from_pydict(out, PIECE)


def pieces(docs: DataFrame, path: str, limit: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_pieces, path, limit, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def patterns(counts: dict[int, int], limit: int, most_docs: int, most_cost: int, weights=(1.0, 0.05, 0.2), by: str = "dot") -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order, how many bins hold them) for a histogram of lengths, by vector best fit decreasing.

    Open bins with equal contents are one entry with a count. weights: of tokens, documents and attention cost, each as
    a share of its capacity. by: "dot" takes the bin whose weighted residuals fit the piece least loosely (smallest dot
    product with the piece), "norm" the bin that leaves the smallest residual norm.
    """
    caps = np.array([limit, most_docs, most_cost], float)
    w = np.array(weights)
    open_bins: dict[tuple[int, int, int], dict[tuple[int, ...], int]] = defaultdict(dict)  # by residuals
    for length in sorted(counts, reverse=True):
        need = (length, 1, length * length)
        if any(a > b for a, b in zip(need, (limit, most_docs, most_cost), strict=True)):
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        left = counts[length]
        share = np.array(need) / caps
        fits = [r for r in open_bins if open_bins[r] and all(a <= b for a, b in zip(need, r, strict=True))]
        if fits:
            r = np.array(fits) / caps
            score = (r * share * w).sum(1) if by == "dot" else (w * (r - share) ** 2).sum(1)
            queue = [fits[i] for i in np.lexsort((r[:, 2], r[:, 1], r[:, 0], score))]
        else:
            queue = []
        while left and queue:
            r = queue.pop(0)
            again: tuple[int, int, int] | None = None
            for content, n in list(open_bins[r].items()):
                if not left:
                    break
                use = min(n, left)
                left -= use
                if use == n:
                    del open_bins[r][content]
                else:
                    open_bins[r][content] = n - use
                again = (r[0] - need[0], r[1] - need[1], r[2] - need[2])
                into = open_bins[again]
                into[content + (length,)] = into.get(content + (length,), 0) + use
            if not open_bins[r]:
                del open_bins[r]
            if again and all(a <= b for a, b in zip(need, again, strict=True)):
                queue.insert(0, again)  # the bins just filled are the fullest that still take the piece
        if left:
            each = min(limit // length, most_docs, most_cost // need[2])
            for k, n in ((each, left // each), (left % each, 1)):
                if k and n:
                    into = open_bins[(limit - k * length, most_docs - k, most_cost - k * need[2])]
                    into[(length,) * k] = into.get((length,) * k, 0) + n
    return [(content, n) for group in open_bins.values() for content, n in group.items()]


def _slots(found: list[tuple[tuple[int, ...], int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(length, first rank, bins, first sequence_id, offset): ranks from the first on go to consecutive bins, and again
    from the first bin on for each further copy of the length in the pattern.

    A length splits one entry of `patterns` at most and adds two, so there are 3 patterns a length at most; a pattern of
    1024 tokens has 44 different lengths at most. That bounds the table at 135,000 rows for 1024 tokens.
    """
    sequence, used = 0, defaultdict(int)
    for content, n in found:
        offset = 0
        for length, copies in Counter(content).items():
            yield length, used[length], n, sequence, offset
            used[length] += n * copies
            offset += length * copies
        sequence += n


def pack(cut: DataFrame, limit: int = 1024, most_docs: int = 1024, most_cost: int = 1024 * 1024, by: str = "dot") -> DataFrame:
    """Rows of `cut` (which has length) with sequence_id and offset.

    `cut` is read three times, so it should be a written table. Ranks are by slice, doc_id, piece; what is equal in all
    of them may change places.
    """
    spark = cut.sparkSession
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `limit` rows at most
    if not sizes:
        return cut.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    slots = list(_slots(patterns(sizes, limit, most_docs, most_cost, by=by)))
    slices = min(SLICES, 1 + max(sizes.values()) // SLICE)
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    # rows of each length and slice, and how many rows of that length the slices before hold
    before = cut.groupBy("length", "slice").agg(F.count("*").alias("rows_here"))
    before = before.withColumn("ahead", F.sum("rows_here").over(Window.partitionBy("length").orderBy("slice")) - F.col("rows_here")).drop("rows_here")
    ranked = cut.withColumn("place", F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "slice"]).withColumn("place", F.col("place") + F.col("ahead"))
    # one row per length: its slots by first rank
    table = pd.DataFrame(slots, columns=["length", "first", "bins", "sequence", "at"]).sort_values(["length", "first"])
    rows = [(int(k), g[["first", "bins", "sequence", "at"]].to_numpy().tolist()) for k, g in table.groupby("length")]
    where = spark.createDataFrame(rows, "length long, slots array<array<long>>")
    placed = ranked.join(F.broadcast(where), "length").withColumn("slot", _last_at_most("slots", "place"))
    nth = F.col("place") - F.col("slot")[0]
    sequence = F.col("slot")[2] + nth % F.col("slot")[1]
    offset = F.col("slot")[3] + F.floor(nth / F.col("slot")[1]) * F.col("length")
    return placed.select(*[c for c in cut.columns if c != "slice"], sequence.alias("sequence_id"), offset.cast("long").alias("offset"))


def _last_at_most(slots: str, place: str):
    """The last of the slots (sorted by first rank) that begins at or before `place`."""
    return F.element_at(F.filter(F.col(slots), lambda s: s[0] <= F.col(place)), -1)


def pack_documents(docs: DataFrame, path: str, limit: int = 1024, end_id: int = 2) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(pieces(docs, path, limit, end_id)), limit, limit, limit * limit)
