"""Exact deduplication with cuckoo-filter indexes.

Every text gets a SHA-256 digest. Digests are dealt by hash to buckets; each bucket keeps a cuckoo filter over its live
digests beside the stored keys. A digest that the filter does not know is new. A hit may be a fingerprint that two
digests share, so it is verified against the bucket's stored keys. A filter that overflows is rebuilt at twice the size
from the stored keys. Deleted digests leave both the filter and the keys.

Before the digests are shuffled, copies are added up per task, so that a group of copies sends one row per task at most,
whatever its size.

Defined results: a null text equals an empty one; texts are compared byte by byte without any change; rows with the same
doc_id and text are copies; a null doc_id counts as smaller than all others and its group is kept by the largest
non-null doc_id, or by null if there is none; an empty table gives an empty result; other columns pass through
`dedup_exact` and do not appear in `copy_groups`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrelake.llm.common import free_name

GROUP = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_MASK = (1 << 64) - 1
#: Entries that one bucket of a filter holds, and moves before the filter counts as full.
SLOTS, KICKS = 4, 200
#: Rows of partial groups that one task's index holds about.
INDEXED = 1_000_000


def _mixed(x: int) -> int:
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & _MASK
    return x ^ (x >> 29)


class CuckooIndex:
    """A cuckoo filter over digests (bytes of 16 or more) with the stored keys that verify its hits.

    `find` tells whether a digest is live; `add` and `delete` keep filter and keys in step; an insertion that fails
    doubles the filter and fills it again from the keys.
    """

    def __init__(self, buckets: int = 64):
        self.keys: dict[bytes, list] = {}
        self.resizes = self.false_hits = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.n = buckets
        self.cells: list[list[int]] = [[] for _ in range(buckets)]

    def _place(self, digest: bytes) -> tuple[int, int]:
        """The fingerprint (16 bits, never 0) and the first bucket; the second is the first XOR the fingerprint's hash."""
        x = int.from_bytes(digest[:8], "little")
        return (x & 0xFFFF) or 1, (x >> 16) % self.n

    def _other(self, at: int, mark: int) -> int:
        return at ^ (_mixed(mark) % self.n)  # n is a power of two, so this undoes itself

    def hit(self, digest: bytes) -> bool:
        mark, at = self._place(digest)
        return mark in self.cells[at] or mark in self.cells[self._other(at, mark)]

    def find(self, digest: bytes) -> list | None:
        """The value stored with a live digest; None without it. A filter miss needs no look at the keys."""
        if not self.hit(digest):
            return None
        found = self.keys.get(digest)
        self.false_hits += found is None
        return found

    def add(self, digest: bytes, value: list) -> None:
        """Store a digest that is not live."""
        self.keys[digest] = value
        if not self._put(digest):
            self._grow()

    def _put(self, digest: bytes) -> bool:
        mark, at = self._place(digest)
        for x in (at, self._other(at, mark)):
            if len(self.cells[x]) < SLOTS:
                self.cells[x].append(mark)
                return True
        for kick in range(KICKS):
            cell = self.cells[at]
            mark, cell[kick % SLOTS] = cell[kick % SLOTS], mark
            at = self._other(at, mark)
            if len(self.cells[at]) < SLOTS:
                self.cells[at].append(mark)
                return True
        return False

    def _grow(self) -> None:
        size = self.n
        while True:
            size *= 2
            self.resizes += 1
            self._clear(size)
            # digests that agree in the bits read here cannot be told apart by growing: the keys still hold them all
            if all(self._put(d) for d in self.keys):
                return
            if size > 64 * SLOTS * max(64, len(self.keys)):
                raise OverflowError("too many digests share one fingerprint and bucket")

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it is not live."""
        if self.find(digest) is None:
            return False
        del self.keys[digest]
        mark, at = self._place(digest)
        for x in (at, self._other(at, mark)):
            if mark in self.cells[x]:
                self.cells[x].remove(mark)
                break
        return True


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: put the partial groups of its digests into an index; a row with gone = true deletes its digest."""
    index = CuckooIndex()
    gone: set[bytes] = set()
    for batch in batches:
        for digest, largest, size, dead in zip(*(batch[c].to_pylist() for c in ("digest", "largest", "size", "gone")), strict=True):
            if dead:
                gone.add(digest)
            elif (live := index.find(digest)) is None:
                index.add(digest, [largest, size])
            else:
                live[0] = max((x for x in (live[0], largest) if x is not None), default=None)
                live[1] += size
    for digest in gone:
        index.delete(digest)
    keys = list(index.keys)
    for i in range(0, len(keys), 10_000):
        part = keys[i : i + 10_000]
        yield pa.RecordBatch.from_pydict({"digest": part, "keep_id": [index.keys[d][0] for d in part], "group_size": [index.keys[d][1] for d in part]}, GROUP)


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and text_sha256 (lowercase hex) of every row."""
    return docs.select("doc_id", F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256"))


def live_groups(marked: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Per live digest: text_sha256, keep_id, group_size, from rows of doc_id and text_sha256.

    deleted: rows of text_sha256 that are no longer live; they get no group.
    """
    part = marked.groupBy("text_sha256", F.spark_partition_id().alias("part")).agg(F.max("doc_id").alias("largest"), F.count("*").alias("size"))
    rows = part.select(F.unhex("text_sha256").alias("digest"), "largest", "size", F.lit(False).alias("gone"))
    if deleted is not None:
        rows = rows.unionByName(deleted.select(F.unhex("text_sha256").alias("digest"), F.lit(None).cast("long").alias("largest"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("gone")))
    # as many parts as keep an index within its bound, whatever the session's number of partitions
    parts = max(int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")), marked.count() // INDEXED + 1)
    groups = rows.repartition(parts, "digest").mapInArrow(_indexed, "digest binary, keep_id long, group_size long")
    return groups.select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size")


def copy_groups(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest doc_id stays; of repeated rows with that doc_id all are marked.
    """
    marked = digests(docs)
    joined = marked.join(live_groups(marked), "text_sha256")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedup_exact(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with its columns: of equal texts the row with the largest doc_id.

    Rows repeated in both doc_id and text stay once.
    """
    mark, key = free_name(docs, "text_sha256"), free_name(docs, "doc_key")
    lowest = F.lit(-(1 << 63))
    groups = live_groups(digests(docs)).select(F.col("text_sha256").alias(mark), F.coalesce("keep_id", lowest).alias(key))
    marked = docs.withColumn(mark, F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn(key, F.coalesce("doc_id", lowest))
    # both keys at once: no group of copies meets in one task, and the second step needs no further exchange
    return marked.join(groups, [mark, key]).dropDuplicates([mark, key]).select(*docs.columns)
