"""Near-duplicate groups by min-max hashing.

A document is the set of its distinct word shingles. Each permutation of the shingle hashes gives two signature values,
the smallest and the largest, so that half as many hash evaluations fill a signature. `BANDS` bands of `ROWS` values each
put documents into buckets; a pair at the least similarity of 0.85 meets in no bucket with a probability below 1e-8.

Documents with equal sets are one node of the graph; candidates are confirmed on full sets. Nodes of a bucket are not
compared pair by pair. Every node is first compared with its bucket's centre, the member that meets most others over all
buckets; what is linked then is one component, and a bucket of one component is done. Of the nodes in the other buckets
two can still be linked, if they are of different components and share one of the first shingles of both, in the order of
how few nodes hold a shingle: each node shows so many of them, for every class of sizes that a partner can have, that no
link is missed. As the rarest come first, what all members of a group hold is hardly ever shown. Where nodes that show the
same would still make more than `SPARSE` pairs for each place in a bucket, they too are compared with a centre, and
again, until they don't; each such round settles every group's centre, so the rounds end and nothing is left out. The last
step joins what remains, linear in the rows by then; sizes and places in the order rule out all but a few pairs of it. Components are contracted after each step, so no step sees more
than its own new links.

Defined results: A to Z are lowered, no other letter; words are runs of characters other than space and the five controls
from tab to carriage return; texts of fewer words than a shingle are one shingle of all their words; a text without words, or a null text, has an
empty set and is linked with nothing; rows with the same doc_id are one node; a null doc_id is linked with nothing and
has a null component; an empty table gives an empty result; other columns pass through `dedup_near` and do not appear in
`near_groups`. Shingles are told apart by 64-bit hashes and equal sets by 128-bit digests of those.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrelake.llm.common import written
from gyrelake.operators.networks import components

WORDS = 5
BANDS, ROWS = 40, 6
#: Pairs by one shown shingle for each place of a node in a bucket, above which a centre is compared first: their sizes
#: and places are looked at within the join, in far less time than signing a text takes. Ratio of sizes within a class.
SPARSE, CLASS = 200, 1.02
#: Bits of the filter in front of a shuffle, in longs of 64: at most 262,144 rows of two longs are sent to each executor.
FILTER = 1 << 24
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of a text's distinct word shingles, sorted. Words' hashes are remembered up to a bound."""

    known_most = 400_000

    def __init__(self, words: int = WORDS):
        import xxhash

        self.words, self.hash = words, xxhash.xxh3_64_intdigest
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = WORD.findall((text or "").encode().translate(LOWER))
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.known_most:
            self.known.clear()
        known, each = self.known, self.hash
        for w in set(found):
            if w not in known:
                known[w] = each(w)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        if len(h) < self.words:
            out = np.full(1, len(h), np.uint64)
            for x in h:
                out = _mix(out * _ODD + x)
            return out
        n = len(h) - self.words + 1
        out = np.full(n, self.words, np.uint64)
        for j in range(self.words):
            out = _mix(out * _ODD + h[j : j + n])
        return np.unique(out)


def signature(shingles: np.ndarray, permutations: int) -> np.ndarray:
    """The smallest and the largest value of each permutation, side by side. Shingles are mixed hashes already, so a
    product with an odd number permutes them."""
    factors = _mix(np.arange(1, permutations + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    out = np.empty((permutations, 2), np.uint64)
    step = max(1, 32_768 // len(shingles))
    for i in range(0, permutations, step):
        x = factors[i : i + step, None] * shingles
        x.min(axis=1, out=out[i : i + step, 0])
        x.max(axis=1, out=out[i : i + step, 1])
    return out.ravel()


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band. The two values of a permutation go to different bands."""
    table = values.reshape(-1, 2).T.reshape(bands, rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        keys = _mix(keys * _ODD + table[:, j])
    return keys.view(np.int64)


def _signed(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    shingler = Shingler(words)
    for batch in batches:
        out = {n: [] for n in SIGNED.names}
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            s = shingler(text)
            out["doc_id"].append(doc_id)
            out["n_shingles"].append(len(s))
            out["digest"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            out["bands"].append(band_keys(signature(s, BANDS * ROWS // 2)) if len(s) else None)
        yield pa.RecordBatch.from_pydict(out, SIGNED)


def _sets(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(words)
    kind = pa.list_(pa.int64())
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array([shingler(t).view(np.int64) for t in batch["text"].to_pylist()], kind)], names=["node", "shingles"])


def _up(x: Column, by: int) -> Column:
    """x / by in whole numbers, rounded up."""
    return F.floor((x + (by - 1)) / by)


def _joint(a: Column, b: Column, least: int) -> Column:
    """Shingles that sets of these sizes share at least if they are linked."""
    return _up((a + b) * least, 100 + least)


def confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets; other columns stay. The centres' sets travel, one for a pair."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    similar = F.col("both") * 100 >= least * (F.size("sa") + F.size("sb") - F.col("both"))
    return written(both.where(similar).select(*pairs.columns).distinct())


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (node, component) after links between components (a, b); a component without links is its only node's id."""
    new = components(edges).select(F.col("node").alias("old"), F.col("component").alias("new"))
    every = labels.unionByName(new.select(F.col("old").alias("node"), F.col("old").alias("component"))).distinct()
    return written(every.join(new, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component")))


def thinned(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """`rows` without most of those whose `key` is not in `wanted`, for a join that drops the others after a shuffle.

    The filter's size is fixed. Once `wanted` has more keys than it has bits, nearly all rows pass and the shuffle is as
    large as without it; no wanted row is ever dropped. Rows with a null key may pass or not.
    """
    cell = F.pmod(F.xxhash64(key), F.lit(FILTER))
    word, bit = F.shiftright(cell, 6), F.pmod(cell, F.lit(64)).cast("int")
    bits = wanted.groupBy(word.alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))")).alias("_bits"))
    return rows.join(F.broadcast(bits), word == F.col("_word")).where(F.getbit("_bits", bit) == 1).drop("_word", "_bits")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def centred(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """(a, b): each group's centre with every other member that is not too large or too small to be linked with it."""
    best = rows.groupBy(*key).agg(F.max(F.struct("weight", F.negate("node").alias("other"), F.col("node").alias("a"), F.col("n").alias("na"))).alias("best"))
    best = written(best.select(*key, "best.a", "best.na"))
    sizes = F.greatest("na", "n") * least <= F.least("na", "n") * 100
    return written(rows.join(best, key).where((F.col("node") != F.col("a")) & sizes).select("a", F.col("node").alias("b")).distinct())


def shown(sets: DataFrame, least: int) -> DataFrame:
    """(shingle, kind, node, n, pos, small): the shingles that every set shows to sets of the class `kind` of sizes.

    Of two linked sets the smaller shows, in its own class (small), the first of the shingles that they share, and the
    larger shows it to that class. pos is its place in the set, in the order of how many sets hold a shingle.
    """
    own = sets.select(F.xxhash64("node", "shingles").alias("id"), "node", F.size("shingles").cast("long").alias("n"), "shingles")
    flat = own.select("id", F.explode("shingles").alias("shingle"))
    held = flat.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1")
    # shingles of one set only come first, and no other set shows them
    common = flat.join(held, "shingle").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("sets", "shingle"))).alias("common"))
    placed = own.select("id", "node", "n").distinct().join(common, "id").select("node", "n", F.posexplode("common").alias("pos", "common"), (F.col("n") - F.size("common")).alias("alone"))
    placed = placed.select("node", "n", F.col("common.shingle").alias("shingle"), (F.col("pos") + F.col("alone")).alias("pos"))
    least_n, width = _up(F.col("n") * least, 100), math.log(CLASS)
    kind = lambda n: F.floor(F.log(n) / width)
    placed = placed.where(F.col("pos") <= F.col("n") - least_n).withColumn("kind", F.explode(F.sequence(kind(least_n), kind(F.col("n")))))
    lowest = F.greatest(least_n, F.floor(F.exp(F.col("kind") * width)) - 1)
    placed = placed.where(F.col("pos") <= F.col("n") - _joint(lowest, F.col("n"), least))
    small = (F.col("kind") == kind(F.col("n"))) & (F.col("pos") <= F.col("n") - _joint(F.col("n"), F.col("n"), least))
    return placed.select("shingle", "kind", "node", "n", "pos", small.alias("small"))


def near_links(docs: DataFrame, least: int = 85, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, labels): members has node, doc_id, n_shingles of every row; labels has node, component of all nodes that
    are linked by pairs with 100 * shared >= least * united. A component's name is its smallest node."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(texts.mapInArrow(partial(_signed, words), "doc_id long, n_shingles long, digest binary, bands array<long>"))
    # one node for equal sets: their smallest doc_id
    nodes = written(signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node")))
    members = signed.select("doc_id", "n_shingles", "digest").join(nodes, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node"))
    owners = signed.select("digest", F.col("doc_id").alias("node"), "bands", "n_shingles").join(nodes, ["digest", "node"], "left_semi")
    keyed = written(owners.select("node", "bands", "n_shingles")).select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = written(keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("bucket", "size"))
    meets = written(thinned(keyed, "bucket", shared).join(shared, "bucket"))
    # how many others a node meets over all its buckets: the text that the others were made from meets most
    central = meets.groupBy("node").agg(F.sum("size").alias("weight"))
    active = written(meets.join(central, "node").select("bucket", "node", "n", "weight"))
    few = active.select("node").distinct()
    # an inner join: the optimizer would move a semi join in front of the filter
    own = thinned(texts.withColumnRenamed("doc_id", "node"), "node", few).join(few, "node")
    sets = written(own.mapInArrow(partial(_sets, words), "node long, shingles array<long>"))

    labels = written(components(confirmed(centred(active, ["bucket"], least), sets, least)))
    active = written(labelled(active, labels))
    mixed = active.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("bucket")
    open_ = written(active.join(mixed, "bucket", "left_semi").select("node", "weight", "component").distinct())
    if open_.isEmpty():
        return members, labels
    met = active.count()
    rows = written(shown(sets.join(open_.select("node"), "node", "left_semi"), least).join(open_, "node"))
    key = ["shingle", "kind"]
    while True:
        part = rows.groupBy(*key, "component").agg(F.count_if("small").alias("x"), F.count("*").alias("y"))
        group = part.groupBy(*key).agg((F.sum("x") * F.sum("y") - F.sum(F.col("x") * F.col("y"))).alias("pairs"), F.sum("y").alias("size")).where("pairs > 0")
        rows = written(rows.join(group, key))
        pairs = rows.agg(F.sum(F.col("pairs") / F.col("size"))).first()[0]
        if pairs is None:
            return members, labels
        rows = rows.drop("pairs", "size")
        if pairs <= SPARSE * met:
            break
        led = centred(rows, key, least)
        known = rows.select("node", "component").distinct()
        of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))  # noqa: E731, B023
        new = confirmed(led.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select("a", "b", "ca", "cb"), sets, least)
        # the centre has been compared with all of its group
        best = rows.groupBy(*key).agg(F.max(F.struct("weight", F.negate("node").alias("other"))).alias("best")).select(*key, F.negate("best.other").alias("node"))
        rows = rows.join(best, [*key, "node"], "left_anti")
        if not new.isEmpty():
            edges = new.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            labels = merged(labels, edges)
            rows = labelled(rows.drop("component"), labels)
        rows = written(rows)
    x, y = rows.where("small").alias("x"), rows.alias("y")
    joint = _joint(F.col("x.n"), F.col("y.n"), least)
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    fits = (F.col("y.n") * least <= F.col("x.n") * 100) & (F.col("x.pos") <= F.col("x.n") - joint) & (F.col("y.pos") <= F.col("y.n") - joint)
    same = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.kind") == F.col("y.kind"))
    pairs = x.join(y, same & order & fits & (F.col("x.component") != F.col("y.component")))
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb")).distinct()
    new = confirmed(pairs, sets, least)
    return members, labels if new.isEmpty() else merged(labels, new.select(F.col("ca").alias("a"), F.col("cb").alias("b")))


def near_groups(docs: DataFrame, least: int = 85, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept."""
    members, labels = near_links(docs, least, words)
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return labelled(members, labels).select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def dedup_near(docs: DataFrame, least: int = 80, words: int = WORDS) -> DataFrame:
    """The rows of `docs` that stay, with its columns: of each group the smallest doc_id; rows with a null doc_id stay."""
    groups = near_groups(docs, least, words).where(~F.col("kept")).select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(groups, F.col("doc_id") == F.col("dropped_id"), "left_anti").select(*docs.columns)
