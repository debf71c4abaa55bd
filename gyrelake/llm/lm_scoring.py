"""Stupid-backoff scores of documents by the n-grams of all other documents.

Texts are cut into lower-case words by white space; every n-gram of 1 to `order` words is a 64-bit hash. Documents are
packed into blocks of bounded size, and the n-grams of a block are added up before they leave it: an n-gram sends one
count a block, however many documents hold it, so no n-gram is hot. The counts are dealt to tables by hash and added up
there; each block is then joined with the totals of its own n-grams, which give every n-gram of every document its score:
how often it occurs elsewhere over how often its first words do, or, where it does not occur, 0.4 times the score of the
shorter n-gram without its first word. Logs are summed per document.

A document's own counts are taken away before it is scored, so a text that nothing else resembles scores low.

Defined results: a null or empty text, and one of white space, has no words, n_words 0 and a null score; a document's
first words are scored by the shorter n-grams that begin it; a word that no other document holds counts as one in all words; every row is a
document of its own, so repeated rows tell of each other, and a null doc_id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrelake.llm.common import written

#: The factor for each step of backing off (the method's fixed value).
BACKOFF = 0.4
#: Words of a block about; bytes of counts that one part of the tables holds about.
BLOCK_WORDS, PART_BYTES = 1_000_000, 16_000_000
#: Words whose hashes a task remembers.
KNOWN = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
SPACES = str.maketrans(dict.fromkeys(map(chr, (9, 10, 11, 12, 13)), " "))
BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n", pa.int64()), ("vocabulary", pa.binary()), ("words", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _small(x: np.ndarray, width: int = 4) -> bytes:
    """Numbers of `width` bytes, compressed with all lowest bytes first, then the next ones: high bytes are mostly zero."""
    raw = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _large(raw: bytes, width: int = 4) -> np.ndarray:
    plain = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCKS: documents' ids and numbers of words, and the words as places in the block's vocabulary of hashes."""
    import xxhash

    each = xxhash.xxh3_64_intdigest
    known: dict[str, int] = {}
    ids, parts, n = [], [], 0

    def packed() -> pa.RecordBatch:
        vocabulary, words, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        common = np.argsort(-count, kind="stable")  # common words get small numbers
        rank = np.empty(len(common), np.int64)
        rank[common] = np.arange(len(common))
        vocabulary, words = vocabulary[common], rank[words]
        row = {"block": [uuid.uuid4().int >> 65], "ids": [ids], "lengths": [[len(p) for p in parts]], "n": [n], "vocabulary": [vocabulary.tobytes()], "words": [_small(words)]}
        return pa.RecordBatch.from_pydict(row, BLOCKS)

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = [w for w in (text or "").lower().translate(SPACES).split(" ") if w]
            if len(known) > KNOWN:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = each(w)
            ids.append(doc_id)
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            n += len(words)
            if n + len(ids) >= BLOCK_WORDS:
                yield packed()
                ids, parts, n = [], [], 0
    if ids:
        yield packed()


class Block:
    """A block's documents and the hashes of their n-grams. grams[n] holds one hash for each place where one begins."""

    def __init__(self, lengths: list[int], vocabulary: bytes, words: bytes, order: int):
        self.lengths = np.array(lengths, np.int64)
        self.document = np.repeat(np.arange(len(lengths)), self.lengths)
        left = np.repeat(np.cumsum(self.lengths), self.lengths) - np.arange(len(self.document))  # words from here to the document's end
        h = np.frombuffer(vocabulary, np.uint64)[_large(words)]
        self.places, self.grams = {}, {}
        for k in range(1, order + 1):
            at = np.flatnonzero(left >= k)
            gram = np.full(len(at), k, np.uint64)
            for j in range(k):
                gram = _mix(gram * _ODD + h[at + j])
            self.places[k], self.grams[k] = at, gram

    def counted(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All distinct n-grams by hash: their parts (equal ranges of hashes), hashes and counts, and for every place which one it is."""
        key, which, count = np.unique(np.concatenate([*self.grams.values()]), return_inverse=True, return_counts=True)
        return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), key, count, which


def _cut(part: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: len(part)]


def _counts(order: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, block, grams, counts): what each block holds of each part of the tables."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
    for batch in batches:
        for r in batch.to_pylist():
            part, key, count, _ = Block(r["lengths"], r["vocabulary"], r["words"], order).counted(parts)
            cut = _cut(part)
            ends = [*cut[1:].tolist(), len(part)]
            for a in range(0, len(cut), 256):
                spans = [*zip(cut[a : a + 256].tolist(), ends[a : a + 256], strict=True)]
                yield pa.RecordBatch.from_pydict({"part": part[cut[a : a + 256]].astype(np.int32), "block": [r["block"]] * len(spans), "grams": [_small(np.append(key[i], np.diff(key[i:j])), 8) for i, j in spans], "counts": [_small(count[i:j]) for i, j in spans]}, schema)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, part, totals) in the order of each block's grams. Rows come sorted by part; one part at a time is held."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("totals", pa.binary())])

    def added(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        grams = [np.cumsum(_large(r[2], 8), dtype=np.uint64) for r in rows]  # they come as differences
        _, which = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(which, np.concatenate([_large(r[3]) for r in rows])).astype(np.int64)[which]
        at = 0
        for r, g in zip(rows, grams, strict=True):
            yield pa.RecordBatch.from_pydict({"block": [r[1]], "part": [r[0]], "totals": [_small(total[at : at + len(g)], 8)]}, schema)
            at += len(g)

    waiting: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("part", "block", "grams", "counts")), strict=True):
            if waiting and row[0] != waiting[0][0]:
                yield from added(waiting)
                waiting = []
            waiting.append(row)
    if waiting:
        yield from added(waiting)


def _scored(order: int, parts: int, words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            block = Block(r["lengths"], r["vocabulary"], r["words"], order)
            n_docs = len(block.lengths)
            score = np.full(n_docs, np.nan)
            if r["found"]:
                _, _, _, which = block.counted(parts)
                total = np.concatenate([_large(x["totals"], 8) for x in sorted(r["found"], key=lambda x: x["part"])]).astype(np.int64)
                document = np.concatenate([block.document[at] for at in block.places.values()])
                _, same, own = np.unique(document * len(total) + which, return_inverse=True, return_counts=True)
                elsewhere = total[which] - own[same]
                sizes = np.cumsum([0, *(len(at) for at in block.places.values())])
                begin = np.cumsum(block.lengths) - block.lengths
                sums, logs = np.zeros(n_docs), None
                for k, at in block.places.items():
                    here = elsewhere[sizes[k - 1] : sizes[k]]
                    full = np.zeros(len(block.document) + 1)  # by the place of the n-gram's first word
                    if logs is None:
                        full[at] = np.log(np.maximum(here, 1) / max(words, 1))
                    else:
                        head = np.zeros(len(block.document), np.int64)
                        head[block.places[k - 1]] = before
                        full[at] = np.where(here > 0, np.log(np.maximum(here, 1) / np.maximum(head[at], 1)), logs[at + 1] + np.log(BACKOFF))
                    logs, before = full, here
                    if k < order:  # the k-th word of a document has no more words before it
                        sums[block.lengths >= k] += full[begin[block.lengths >= k]]
                    else:
                        sums += np.bincount(block.document[at], full[at], n_docs)
                some = block.lengths > 0
                score[some] = sums[some] / block.lengths[some]
            yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(block.lengths), pa.array(score, from_pandas=True)], schema=SCORES)


def scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """Per document: doc_id, n_words, score: the mean log of its words' stupid-backoff scores by all other documents."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = written(texts.mapInArrow(_blocked, "block long, ids array<long>, lengths array<int>, n long, vocabulary binary, words binary"))
    words = blocks.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words * order * 10 // PART_BYTES + 1)
    told = blocks.select("block", "lengths", "vocabulary", "words").mapInArrow(partial(_counts, order, parts), "part int, block long, grams binary, counts binary")
    totals = told.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_totals, "block long, part int, totals binary")
    found = totals.groupBy("block").agg(F.collect_list(F.struct("part", "totals")).alias("found"))
    return blocks.join(found, "block", "left").select("ids", "lengths", "vocabulary", "words", "found").mapInArrow(partial(_scored, order, parts, words), "doc_id long, n_words long, score double")
