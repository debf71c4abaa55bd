"""Removal of repeated byte strings, by backward extension of anchored intervals.

A byte goes when a string of `LEAST` bytes that covers it also starts earlier, in the order of (doc_id, start). Suffixes
of the whole corpus cannot be sorted in one place, so they are sorted where they can be equal: every window of `LEAST`
bytes holds an anchor, the smallest hash among its `ANCHOR`-byte strings, and two equal windows hold the same anchor at
the same offset. Occurrences of an anchor that occurs once are done. For the others the bytes around the anchor decide:

1. Occurrences with equal bytes on both sides: all but the first repeat it as a whole. Within a block of documents this is
   told before the shuffle, so that copies of a passage send one record a block, however many there are.
2. The first ones of each different context start as one interval per anchor. The interval is extended backward, one byte
   at a time and all intervals at once, as on a Burrows-Wheeler transform: an interval and the byte before it give the
   next intervals. The same forward, for the bytes after the anchor. Lengths grow until anchor and extensions reach
   `LEAST` bytes; a window is an interval of each side whose lengths add up to it, and all its members but the first are
   repeats. An interval of one member can repeat nothing and leaves at once.
3. An anchor with more than `LARGEST` different contexts does not go to one task: its windows are dealt by their own
   digests, and the first of each is found by a grouped minimum.

Anchors travel packed, one row per block of documents and bucket, so a shuffle moves 28 bytes an anchor, and 12 for one
that repeats another of its block; those are dealt by document, not by anchor.

Defined results: a null text equals an empty one; nothing is removed from texts shorter than `LEAST` bytes; rows with the
same doc_id and equal texts come in any order, one of them first; a null doc_id sorts before all others; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrelake.llm.common import written

LEAST, ANCHOR = 100, 32
#: Different contexts of one anchor that one task extends; bytes of anchors that one bucket holds about.
LARGEST, BUCKET_BYTES = 8192, 8_000_000
_B = 0x9E3779B97F4A7C15
_BI = pow(_B, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RECORD = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("row", "<i8"), ("at", "<i4")])
PLACE = np.dtype([("row", "<i8"), ("at", "<i4")])
CHUNK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash's base and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.append(np.uint64(1), np.full(size, _B, np.uint64)))
            self.down = np.cumprod(np.append(np.uint64(1), np.full(size, _BI, np.uint64)))
        return self.up[:n], self.down[:n]


def prefix_sums(raw: bytes, powers: Powers) -> np.ndarray:
    up, _ = powers(len(raw) + 1)
    return np.append(np.uint64(0), np.cumsum(_BYTES[np.frombuffer(raw, np.uint8)] * up[: len(raw)], dtype=np.uint64))


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of the bytes from start to end; equal strings have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return _mix((sums[end] - sums[start]) * down[start])


def _extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every `width` neighbours, by doubling."""
    reach = 1
    while reach * 2 <= width:
        x = pick(x[:-reach], x[reach:])
        reach *= 2
    return pick(x[: len(x) - (width - reach)], x[width - reach :]) if reach < width else x


def anchors(sums: np.ndarray, powers: Powers) -> np.ndarray:
    """Places of all anchors: the smallest hashes of a window's strings, of equal ones all."""
    n = len(sums) - 1
    if n < LEAST:
        return np.zeros(0, np.int64)
    place = np.arange(n - ANCHOR + 1)
    h = hashes(sums, place, place + ANCHOR, powers)
    width = LEAST - ANCHOR + 1
    least = _extreme(h, width, np.minimum)  # of the window that starts here
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(h == _extreme(np.concatenate([pad, least, pad]), width, np.maximum)[: len(h)])


def reach(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the bytes that windows with this anchor can cover."""
    side = LEAST - ANCHOR
    return np.maximum(at - side, 0), np.minimum(at + LEAST, size)


def _blocked(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, records, again): the anchors of a block of documents; again are the places of those that have the
    same context as an earlier one of the block."""
    powers = Powers()
    schema = pa.schema([("bucket", pa.int32()), ("records", pa.binary()), ("again", pa.binary())])

    def packed(x: np.ndarray, bucket: np.ndarray, column: str) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        x, bucket = x[order], bucket[order]
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        rows = {"records": [b""] * len(cut), "again": [b""] * len(cut), column: [y.tobytes() for y in np.split(x, cut[1:])]}
        return pa.RecordBatch.from_pydict({"bucket": bucket[cut].astype(np.int32), **rows}, schema)

    def dealt(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(parts)
        every = every[np.lexsort((every["at"], every["row"], every["context"], every["anchor"]))]
        same = np.append(False, (every["anchor"][1:] == every["anchor"][:-1]) & (every["context"][1:] == every["context"][:-1]))
        first = every[~same]
        yield packed(first, (first["anchor"] >> np.uint64(20)) % np.uint64(buckets), "records")
        if same.any():
            again = np.empty(int(same.sum()), PLACE)
            again["row"], again["at"] = every["row"][same], every["at"][same]
            yield packed(again, again["row"] % buckets, "again")

    waiting, n = [], 0
    for batch in batches:
        for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
            raw = (text or "").encode()
            if len(raw) < LEAST:
                continue
            sums = prefix_sums(raw, powers)
            at = anchors(sums, powers)
            start, end = reach(at, len(raw))
            found = np.empty(len(at), RECORD)
            found["anchor"] = hashes(sums, at, at + ANCHOR, powers)
            # how far the context reaches is part of it: at the edges of a text it is shorter
            found["context"] = _mix(hashes(sums, start, end, powers) + ((at - start) * 1000 + (end - at)).astype(np.uint64))
            found["row"], found["at"] = row, at
            waiting.append(found)
            n += len(found)
            if n >= CHUNK:
                yield from dealt(waiting)
                waiting, n = [], 0
    if n:
        yield from dealt(waiting)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """All records of one bucket at a time, and places as they come; rows come sorted by bucket."""
    bucket, parts = None, []
    for batch in batches:
        again = b"".join(batch["again"].to_pylist())
        if again:
            yield np.frombuffer(again, PLACE)
        for b, raw in zip(batch["bucket"].to_pylist(), batch["records"], strict=True):
            if b != bucket and parts:
                yield np.concatenate(parts)
                parts = []
            bucket = b
            if len(raw.as_buffer()):
                parts.append(np.frombuffer(raw.as_buffer(), RECORD))
    if parts:
        yield np.concatenate(parts)


def _judged(largest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, kind, places): places of anchors whose whole context repeats (kind 0), is to be extended (1), or belongs to
    an anchor with very many contexts (2). One row per document and bucket and kind."""
    schema = pa.schema([("row", pa.int64()), ("kind", pa.int8()), ("places", pa.binary())])
    for x in _by_bucket(batches):
        if x.dtype == PLACE:
            kind = np.zeros(len(x), np.int8)
        else:
            x = x[np.lexsort((x["at"], x["row"], x["context"], x["anchor"]))]
            same_anchor = np.append(False, x["anchor"][1:] == x["anchor"][:-1])
            same = same_anchor & np.append(False, x["context"][1:] == x["context"][:-1])
            group = np.cumsum(~same_anchor) - 1
            contexts = np.bincount(group[~same], minlength=group[-1] + 1)[group]
            kind = np.where(same, 0, np.where(contexts > largest, 2, 1)).astype(np.int8)
            keep = same | (contexts > 1)
            x, kind = x[keep], kind[keep]
        order = np.lexsort((x["at"], kind, x["row"]))
        x, kind = x[order], kind[order]
        if len(x):
            cut = np.flatnonzero(np.append(True, (x["row"][1:] != x["row"][:-1]) | (kind[1:] != kind[:-1])))
            for a in range(0, len(cut), 20_000):
                ends = [*cut[a + 1 : a + 20_001].tolist()]
                ends += [len(x)] if len(ends) < len(cut[a : a + 20_000]) else []
                yield pa.RecordBatch.from_pydict({"row": x["row"][cut[a : a + 20_000]], "kind": kind[cut[a : a + 20_000]], "places": [x["at"][i:j].tobytes() for i, j in zip(cut[a : a + 20_000].tolist(), ends, strict=True)]}, schema)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, row, at, before, after) for every place to be extended; kind 2 as its windows' digests instead."""
    powers = Powers()
    schema = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("bytes", pa.binary()), ("window", pa.bool_())])
    for batch in batches:
        for row, text, kind, lists in zip(*(batch[c].to_pylist() for c in ("row", "text", "kind", "places")), strict=True):
            raw = text.encode()
            at = np.concatenate([np.frombuffer(x, "<i4") for x in lists]).astype(np.int64)
            sums = prefix_sums(raw, powers)
            if kind == 1:
                start, end = reach(at, len(raw))
                anchor = hashes(sums, at, at + ANCHOR, powers).view(np.int64)
                out = {"anchor": anchor, "row": np.full(len(at), row), "at": at.astype(np.int32), "start": start.astype(np.int32), "bytes": [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], "window": np.zeros(len(at), bool)}
            else:
                side = LEAST - ANCHOR
                places = np.unique((at[:, None] - np.arange(side + 1)).ravel())
                places = places[(places >= 0) & (places + LEAST <= len(raw))]
                h = hashes(sums, places, places + LEAST, powers).view(np.int64)
                n = len(places)
                out = {"anchor": h, "row": np.full(n, row), "at": places.astype(np.int32), "start": places.astype(np.int32), "bytes": [b""] * n, "window": np.ones(n, bool)}
            yield pa.RecordBatch.from_pydict(out, schema)


def _classes(known: np.ndarray, byte: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Extend intervals by one byte: members with the same interval and byte share the next one. Members that are alone,
    or have no byte there, get -1 for good."""
    out = np.full(len(known), -1, np.int64)
    at = np.flatnonzero(live & (known >= 0) & (byte >= 0))
    if len(at):
        key = known[at] * 256 + byte[at]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        out[at] = np.where(count[inverse] > 1, inverse, -1)
    return out


def extended(anchor: np.ndarray, text: np.ndarray, width: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each number of bytes before the anchor: a window's starting offset (0 or less) and the members, in their own
    order, whose window there repeats an earlier member's.

    text: the contexts side by side, one row each, aligned at the anchor's place `left`; width: (before, after) that each has.
    """
    side = LEAST - ANCHOR
    n = len(anchor)
    _, start = np.unique(anchor, return_inverse=True)
    live = np.ones(n, bool)
    column = lambda k, ok: np.where(ok, text[:, k].astype(np.int64), -1)
    forward = [start]
    for k in range(side):
        forward.append(_classes(forward[-1], column(side + ANCHOR + k, width[:, 1] > ANCHOR + k), live))
    backward = start
    for a in range(side + 1):
        if a:
            backward = _classes(backward, column(side - a, width[:, 0] >= a), live)
            if (backward < 0).all():
                return
        other = forward[side - a]
        at = np.flatnonzero((backward >= 0) & (other >= 0))
        if len(at):
            key = backward[at] * n + other[at]
            first = np.zeros(len(at), bool)
            first[np.unique(key, return_index=True)[1]] = True
            if (~first).any():
                yield -a, at[~first]


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, places): starts of repeated windows, from contexts that come sorted by anchor. Whole anchors at a time."""
    side = LEAST - ANCHOR
    full = side + LEAST

    def judged(parts: list[tuple]) -> pa.RecordBatch:
        anchor, row, at, start = (np.concatenate([p[i] for p in parts]) for i in range(4))
        raw = [b for p in parts for b in p[4]]
        order = np.lexsort((at, row, anchor))
        anchor, row, at, start = anchor[order], row[order], at[order].astype(np.int64), start[order].astype(np.int64)
        raw = [raw[i] for i in order.tolist()]
        before = at - start
        text = np.frombuffer(b"".join((b"\0" * (side - a) + r).ljust(full, b"\0") for a, r in zip(before.tolist(), raw, strict=True)), np.uint8).reshape(len(raw), full)
        width = np.column_stack([before, np.array([len(r) for r in raw]) - before])
        rows, places = [], []
        for offset, members in extended(anchor, text, width, before):
            rows.append(row[members])
            places.append(at[members] + offset)
        return _starts(np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(places) if places else np.zeros(0, np.int64))

    waiting, n = [], 0
    for batch in batches:
        part = [batch[c].to_numpy(zero_copy_only=False) for c in ("anchor", "row", "at", "start")] + [batch["bytes"].to_pylist()]
        if n >= 60_000:  # a group is whole once the next anchor begins
            last = waiting[-1][0][-1]
            k = int(np.argmax(part[0] != last)) if (part[0] != last).any() else len(part[0])
            waiting.append(tuple(x[:k] for x in part))
            part = [x[k:] for x in part]
            if len(part[0]):
                yield judged(waiting)
                waiting, n = [], 0
        if len(part[0]):
            waiting.append(tuple(part))
            n += len(part[0])
    if n:
        yield judged(waiting)


def _starts(row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """One row per document: (row, places) with the places packed."""
    order = np.lexsort((place, row))
    row, place = row[order], place[order].astype("<i4")
    cut = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
    return pa.RecordBatch.from_pydict({"row": row[cut], "places": [x.tobytes() for x in np.split(place, cut[1:])] if len(row) else []}, pa.schema([("row", pa.int64()), ("places", pa.binary())]))


def covered(size: int, places: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which bytes go: those under windows that start at `places`, and under every window with an anchor in `whole`."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + LEAST, -1)
    if len(whole):
        start, end = reach(whole, size)
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def _cleaned(texts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, *([("kept_text", pa.string())] if texts else [])])
    for batch in batches:
        out = {n: [] for n in schema.names}
        for doc_id, text, lists, whole in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "places", "whole")), strict=True):
            raw = (text or "").encode()
            out["doc_id"].append(doc_id)
            out["n_bytes"].append(len(raw))
            if not lists and not whole:
                removed, spans, kept = 0, 0, raw
            else:
                unpack = lambda xs: np.concatenate([np.frombuffer(x, "<i4") for x in xs]).astype(np.int64) if xs else np.zeros(0, np.int64)
                gone = covered(len(raw), unpack(lists), unpack(whole))
                removed, spans = int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out["n_removed"].append(removed)
            out["n_spans"].append(spans)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if texts:  # a cut may fall inside a character
                out["kept_text"].append(kept.decode(errors="ignore"))
        yield pa.RecordBatch.from_pydict(out, schema)


def _numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text: row is the doc_id itself; where ids repeat or are null, numbers in the order of doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return texts.withColumn("row", F.col("doc_id"))
    # rows of one id come in any order, so that a hot id is dealt to many tasks
    return written(texts.orderBy(F.asc_nulls_first("doc_id"), F.rand(1)).withColumn("row", F.monotonically_increasing_id()))


def _found(docs: DataFrame, largest: int) -> tuple[DataFrame, DataFrame]:
    """(texts, lists): texts has row, doc_id, text; lists has row and lists of packed places (places, whole)."""
    spark = docs.sparkSession
    texts = _numbered(docs)
    size = texts.agg(F.sum(F.octet_length("text")), F.max("row")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((size[0] or 0) * 0.034 * RECORD.itemsize / BUCKET_BYTES) + 1)
    dealt = texts.where(F.octet_length("text") >= LEAST).mapInArrow(partial(_blocked, buckets), "bucket int, records binary, again binary")
    judged = written(dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(partial(_judged, largest), "row long, kind byte, places binary"))
    asked = judged.where("kind > 0").groupBy("row", "kind").agg(F.collect_list("places").alias("places"))
    contexts = asked.join(texts, "row").select("row", "text", "kind", "places").mapInArrow(_contexts, "anchor long, row long, at int, start int, bytes binary, window boolean")
    contexts = written(contexts)
    starts = contexts.where("not window").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_extended, "row long, places binary")
    windows = contexts.where("window").select(F.col("anchor").alias("digest"), "row", "at")
    first = windows.groupBy("digest").agg(F.min(F.struct("row", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = windows.join(first, "digest").where("struct(row, at) > first").select("row", F.col("at"))
    # packed as the other places: four bytes, lowest first
    packed = F.concat(*[F.unhex(F.lpad(F.hex(F.shiftrightunsigned("at", 8 * i).bitwiseAND(255)), 2, "0")) for i in range(4)])
    again = again.select("row", packed.alias("places"))
    marks = starts.select("row", F.lit(1).alias("side"), "places").unionByName(again.select("row", F.lit(1).alias("side"), "places")).unionByName(judged.where("kind = 0").select("row", F.lit(0).alias("side"), "places"))
    lists = marks.groupBy("row").agg(F.collect_list(F.when(F.col("side") == 1, F.col("places"))).alias("places"), F.collect_list(F.when(F.col("side") == 0, F.col("places"))).alias("whole"))
    return texts, lists


def repeated(docs: DataFrame, texts: bool = False, largest: int = LARGEST) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts also kept_text (whole characters)."""
    own, lists = _found(docs, largest)
    kept = own.join(lists, "row", "left").select("doc_id", "text", "places", "whole")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if texts else "")
    return kept.mapInArrow(partial(_cleaned, texts), schema)
