"""Spelling variants: words of a corpus one edit apart, and for each word the frequent form that it is a slip of.

Words are counted by Spark (added up before the shuffle). Pairs within one edit come from a self-join of the vocabulary's
trie, dealt over tasks: a word of m letters goes, for every stretch [a, b) of its letters, to the group of words that
agree before a and after b; in a group the trie of what lies between is walked level by level, with the set of active
node pairs: pairs of nodes of one depth whose paths differ by one replaced letter, and pairs a level apart whose paths
differ by one inserted letter. A pair that has spent its edit goes on by equal letters only; where both nodes end a word,
the pair is given. Words of m letters meet each other, and words of m + 1 letters, in the groups of m. At first there are
two stretches, the halves: below the first half's node the trie of the words that begin with it, and over the second half
that of the words which end with it. A group of more than `MOST` words is dealt again with its stretch halved, until it
is one letter long, where a group is no larger than the alphabet allows; so no group is unbounded and no pair is lost. The
edit's place lies in one stretch only (an inserted letter's at the last place that it can have), so each pair is given once.

A word's form is its near word of largest count, if that is `ratio` times its own at least. Counts grow by that ratio from
form to form, so chains are short and have no rings; roots follow by joining forms with forms.

Defined results: null and empty texts have no words; documents without an id lose no letters; repeated rows count as
often as they stand there; ties between near words go to the smallest in code-point order; no words give an empty table;
columns other than doc_id and text are not read. Time in a group grows with its longest word: a level of its trie is a
step, so very long words (a million letters) are slow, but whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrelake.llm.common import written
from gyrelake.llm.decontamination import lowered

BETWEEN = "[^A-Za-zÀ-ÿ]+"
#: Words of a group; rows that a task holds at once; one more than the largest code point.
MOST, CHUNK, LETTERS = 4096, 65_536, 0x110000
NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, delete_one_in: int | None = None) -> DataFrame:
    """word, n: lower-cased (A-Z) runs of letters of `docs`. With `delete_one_in`, one occurrence in so many (told by the
    crc32 of `<doc_id>:<word>`) loses the letter that the same number names, as a slip of the pen does."""
    word = F.col("word")
    words = docs.select("doc_id", F.explode(F.split("text", BETWEEN)).alias("word")).where(F.length(word) >= least_length)
    words = words.select("doc_id", lowered(word).alias("word"))
    if delete_one_in:
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), word).cast("binary"))
        at = F.pmod(F.col("h"), F.length(word)).cast("int")
        without = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
        words = words.withColumn("h", h).select(F.when(F.pmod("h", F.lit(delete_one_in)) == 0, without).otherwise(word).alias("word"))
        words = words.where(F.length(word) >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _key() -> Column:
    """The group of a word: its class m, its stretch, the letters before and after that."""
    word, m, a, b = (F.col(x) for x in ("word", "m", "a", "b"))
    return F.xxhash64(m, a, b, F.substring(word, F.lit(1), a), F.substring(word, b + F.length(word) - m + 1, F.length(word)))


def _dealt(rows: DataFrame, stretches: Column) -> DataFrame:
    rows = rows.select("word", "n", "m", F.explode(stretches).alias("s")).select("word", "n", "m", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    return rows.withColumn("key", _key())


def _halves(a: Column, b: Column) -> Column:
    middle = F.floor((a + b) / 2).cast("int")
    return F.array(F.struct(a.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), b.alias("b")))


def _groups(vocabulary: DataFrame, most: int, least_length: int) -> DataFrame:
    """word, n, m, a, b, key: every word in its groups, none of which has over `most` words while its stretch can be halved."""
    length = F.length("word")
    classes = vocabulary.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where(F.col("m") >= max(least_length, 1))
    rows = _dealt(classes, F.when(F.col("m") > 1, _halves(F.lit(0), F.col("m"))).otherwise(F.array(F.struct(F.lit(0).alias("a"), F.col("m").alias("b")))))
    while True:
        large = written(rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.col("b") - F.col("a")).alias("width")).where((F.col("size") > most) & (F.col("width") > 1)).select("key", "size"))
        if large.isEmpty():
            return rows
        a, b = F.col("a"), F.col("b")
        rows = _dealt(rows.join(large, "key", "left"), F.when(F.col("size").isNotNull() & (b - a > 1), _halves(a, b)).otherwise(F.array(F.struct(a, b))))


@dataclass
class Level:
    """The trie's nodes of one depth, in order of (parent, letter), and the rows below them."""

    rows: np.ndarray
    node: np.ndarray  # of each row
    keys: np.ndarray
    parent: np.ndarray
    short: np.ndarray  # whether a word of m letters lies below
    long: np.ndarray  # whether one of m + 1 does
    short_end: np.ndarray  # the row that ends here, or -1
    long_end: np.ndarray

    @property
    def size(self) -> int:
        return len(self.keys)


class Forest:
    """The tries of many groups. at: where a row's stretch begins in `flat`; depth: its letters; long: it has m + 1 letters."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, depth: np.ndarray, group: np.ndarray, long: np.ndarray):
        self.flat, self.at, self.depth, self.long = flat, at, depth, long
        self.roots = self._level(np.arange(len(at)), group.astype(np.int64) * LETTERS, 0)

    def _level(self, rows: np.ndarray, keys: np.ndarray, d: int) -> Level:
        unique, node = np.unique(keys, return_inverse=True)
        kinds = [np.zeros(len(unique), bool) for _ in range(2)]
        ends = [np.full(len(unique), -1) for _ in range(2)]
        over = self.depth[rows] == d
        for k, mine in enumerate((~self.long[rows], self.long[rows])):
            kinds[k][node[mine]] = True
            ends[k][node[mine & over]] = rows[mine & over]
        return Level(rows, node, unique, unique // LETTERS, *kinds, *ends)

    def below(self, level: Level, d: int) -> Level:
        """The nodes of depth d + 1."""
        more = self.depth[level.rows] > d
        rows = level.rows[more]
        return self._level(rows, level.node[more] * LETTERS + self.flat[self.at[rows] + d], d + 1)


def _children(nodes: np.ndarray, level: Level) -> tuple[np.ndarray, np.ndarray]:
    """For each child, in `level`, of each of `nodes`: the place of its parent in `nodes`, and the child."""
    first = np.searchsorted(level.parent, nodes, "left")
    count = np.searchsorted(level.parent, nodes, "right") - first
    of = np.repeat(np.arange(len(nodes)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _onward(u: np.ndarray, v: np.ndarray, below_u: Level, below_v: Level, kind_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children by equal letters, of `u` with a word of m letters below and of `v` with one of the kind wanted."""
    of, child = _children(u, below_u)
    keep = below_u.short[child]
    of, child = of[keep], child[keep]
    want = v[of] * LETTERS + below_u.keys[child] % LETTERS
    place = np.minimum(np.searchsorted(below_v.keys, want), max(below_v.size - 1, 0))
    met = below_v.keys[place] == want if below_v.size else np.zeros(len(want), bool)
    child, place = child[met], place[met]
    keep = kind_v[place]
    return child[keep], place[keep]


def _siblings(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes with one parent, both with words of m letters below."""
    nodes = np.flatnonzero(level.short)
    parent = level.parent[nodes]
    rest = np.searchsorted(parent, parent, "right") - np.arange(len(nodes)) - 1
    first = np.repeat(np.arange(len(nodes)), rest)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(rest) - rest, rest)
    return nodes[first], nodes[second]


def active_pairs(forest: Forest, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows one edit apart. last: whether a row's stretch ends its word; a letter put in behind a stretch that
    does not belongs to the next one."""
    none = np.zeros(0, np.int64)
    level, d = forest.roots, 0
    below = forest.below(level, d)
    replaced, inserted = (none, none), (none, none)
    while level.size:
        after = forest.below(below, d + 1)
        fresh = np.flatnonzero(below.long & level.short[below.parent]) if below.size else none
        u, v = np.concatenate([inserted[0], below.parent[fresh]]), np.concatenate([inserted[1], fresh])
        told = np.unique(u * max(below.size, 1) + v)
        u, v = told // max(below.size, 1), told % max(below.size, 1)
        a, b = level.short_end[replaced[0]], level.short_end[replaced[1]]
        yield a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]
        if len(u):
            a, b = level.short_end[u], below.long_end[v]
            met = (a >= 0) & (b >= 0) & ~((below.parent[v] == u) & ~last[np.maximum(a, 0)])
            yield a[met], b[met]
        first, second = _onward(*replaced, below, below, below.short)
        more = _siblings(below)
        replaced = np.concatenate([first, more[0]]), np.concatenate([second, more[1]])
        inserted = _onward(u, v, below, after, after.long)
        level, below, d = below, after, d + 1


def _met(table: pa.Table) -> pa.RecordBatch:
    """The near pairs within the groups of a table in order of `key`."""
    keys = table["key"].to_numpy()
    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    keep = size[group] > 1
    table, group = table.filter(pa.array(keep)), group[keep]
    words, n = table["word"].to_pylist(), table["n"].to_numpy()
    m, a, b = (table[x].to_numpy().astype(np.int64) for x in ("m", "a", "b"))
    length = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    forest = Forest(flat, np.cumsum(length) - length + a, length - m + b - a, group, length > m)
    found = list(active_pairs(forest, b == m)) if len(words) else []
    i, j = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    texts = pa.array(words, pa.string())
    return pa.RecordBatch.from_arrays([texts.take(pa.array(i)), pa.array(n[i]), texts.take(pa.array(j)), pa.array(n[j])], schema=NEAR)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups as they come, in order of `key`, some CHUNK rows at a time; a group is never cut."""
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            table = pa.Table.from_batches(waiting).combine_chunks()
            keys = table["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield _met(table.slice(0, cut))
            rest = table.slice(cut)
            waiting, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield _met(pa.Table.from_batches(waiting).combine_chunks())


def near_words(vocabulary: DataFrame, least_length: int = 1, most: int = MOST) -> DataFrame:
    """word, n, near, near_n: each pair of words of `vocabulary` (word, n; different words, none shorter than
    `least_length`) that are one inserted, deleted or replaced letter apart, once."""
    rows = _groups(vocabulary, most, least_length).repartition("key").sortWithinPartitions("key")
    pairs = rows.mapInArrow(_walked, "word string, n long, near string, near_n long")
    return pairs.where(F.levenshtein("word", "near", 1) == 1)  # two groups with the same hash


def forms(vocabulary: DataFrame, ratio: int = 10, least_length: int = 1) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of `vocabulary` (written already) with its form and where forms lead."""
    pairs = near_words(vocabulary, least_length)
    both = pairs.select(F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    told = vocabulary.select("word", "n").join(best, "word", "left")
    is_form = -F.col("best.less") >= F.col("n") * ratio
    told = written(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    step = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # every round doubles the steps that a root is away from its word; counts grow by `ratio` a step
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(step.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return told.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, ratio: int = 10, least_length: int = 7, least_count: int = 2, delete_one_in: int | None = None) -> DataFrame:
    """`forms` of the words of `docs`."""
    return forms(written(word_counts(docs, least_length, least_count, delete_one_in)), ratio, least_length)
