"""Toxicity by a support vector machine over a gapped subsequence kernel with Nystroem landmarks.

Two words are alike by the subsequences of three letters they share, where letters may lie apart: a subsequence counts
`DECAY` to the power of its span in each word, and word begin and end are letters too. So an insult with letters between,
dots inside or a new ending still shares most of its weight with the insult itself. Signs inside a word are left out,
digits that stand for letters count as those, and a row of single letters counts as one word.

Training reads a bounded sample of labelled documents, cut into sentences; equal places count once. A sentence of a
toxic document is only possibly toxic, so the words that begin as words do that occur in sentences of toxic documents
and hardly in others become the positive words, and common or similar-looking words of clean sentences the negative ones. Landmarks are drawn
from both. The kernel's values at the landmarks, whitened, are the features of a linear SVM with squared hinge loss;
hard negatives are added over rounds. As the kernel is a product of subsequence counts, the trained machine folds into
one weight per subsequence, and every distinct word of a text costs a few table lookups.

A document's score is a logistic step, fitted on the labelled sample, over the highest margins of its distinct words.

Defined results: a null or empty text scores as one without words; rows with equal texts score equally; without labels
of both kinds every document scores 0.0; a word of any length is read whole, in parts, a bounded number at a time; empty
tables give empty results.
"""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kernel: weight of each further position a subsequence spans, and the widest span that counts.
DECAY, SPAN = 0.6, 7
#: Letters that are told apart: 26, other letters by a hash, begin and end of a word.
OTHER, BEGIN, END = 27, 46, 47
LETTERS = 48
#: Longest part of a word that is compared; longer ones are read in overlapping parts of this length.
LONGEST = 24
#: Bounds of the fit: labelled documents, words of each kind, landmarks, hard-negative rounds.
LABELLED, POSITIVE, NEGATIVE, LANDMARKS, ROUNDS = 12_000, 500, 3_000, 300, 4
#: Scores of words that a task remembers, the longest such word, and rows of letters that are compared at a time.
KNOWN, MEMO, ROWS = 300_000, 64, 2048
#: Digits and signs read as letters (fixed values).
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _code(c: str) -> int:
    """The letter's number, 0 for a sign that is left out."""
    c = LEET.get(c, c)
    if "a" <= c <= "z":
        return ord(c) - 96
    return OTHER + ord(c) % (BEGIN - OTHER) if c.isalpha() else 0


class _Codes(dict):
    def __missing__(self, c: int) -> str:
        code = _code(chr(c))
        made = self[c] = chr(code) if code else ""
        return made


_CODES = _Codes()


def cut(word: str) -> Iterator[str]:
    """The word, or overlapping parts of a long one that cover all of it."""
    return (word[at : at + LONGEST] for at in (range(0, max(len(word) - SPAN, 1), LONGEST - SPAN) if len(word) > LONGEST else (0,)))


def coded_blocks(words: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words as rows of letter numbers with begin and end, 0 beyond; and the row's word. Long words take several rows.
    No block has more than `most` rows, however long a word is."""
    parts = ((i, chr(BEGIN) + p + chr(END)) for i, w in enumerate(words) for p in cut(w.translate(_CODES)))
    while block := list(islice(parts, most)):
        width = max(len(p) for _, p in block)
        raw = "".join(p.ljust(width, "\0") for _, p in block).encode("latin-1")
        yield np.frombuffer(raw, np.uint8).reshape(len(block), width), np.array([i for i, _ in block], int)


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' rows at once, for few words."""
    return next(coded_blocks(words, 1 << 62), (np.zeros((0, 2), np.uint8), np.zeros(0, int)))


def _gaps() -> list[tuple[int, int, float]]:
    """(second letter's distance, third's, weight) of all subsequences of three within the widest span."""
    return [(j, k, DECAY ** (k + 1 - 3)) for j in range(1, SPAN) for k in range(j + 1, SPAN)]


def subsequences(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: (row, subsequence number, weight) of every place where it fits a row."""
    wide = rows.astype(np.int32)
    for j, k, weight in _gaps():
        if k >= rows.shape[1]:
            continue
        a, b, c = wide[:, : rows.shape[1] - k], wide[:, j : rows.shape[1] - k + j], wide[:, k:]
        at, place = np.nonzero(c)
        yield at, (a[at, place] * LETTERS + b[at, place]) * LETTERS + c[at, place], weight


def combined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence number, weight) of the distinct subsequences of every row, each row's weights of length 1."""
    parts = [(r.astype(np.int64) * LETTERS**3 + number, np.full(len(r), weight)) for r, number, weight in subsequences(rows)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    row, number = np.divmod(key[first], LETTERS**3)
    weight = np.add.reduceat(weight, first) if len(first) else weight
    norm = np.sqrt(np.bincount(row, weight**2, len(rows)))
    return row, number, weight / norm[row]


def spread(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Rows' weights at these subsequences (sorted numbers), one column each; of the length 1 over all subsequences."""
    row, number, weight = combined(rows)
    at = np.minimum(np.searchsorted(columns, number), len(columns) - 1)
    known = columns[at] == number
    out = np.zeros((len(rows), len(columns)), np.float32)
    out[row[known], at[known]] = weight[known]
    return out


def margins(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's margin for each word: its best part's."""
    out = np.full(len(words), -2.0)
    for rows, owner in coded_blocks(words, ROWS):
        row, number, weight = combined(rows)
        np.maximum.at(out, owner, np.bincount(row, table[number] * weight, len(rows)) + bias)
    return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float, steps: int = 25) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps on the rows inside the margin; y is +1 or -1."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    reg = ridge * np.eye(len(w))
    reg[-1, -1] = 1e-9  # the bias is free
    for _ in range(steps):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside][:, None]
        new = np.linalg.solve(a.T @ x[inside] + reg, a.T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


class Machine:
    """Weights per subsequence, a bias, and the logistic step from word margins to a document's score."""

    def __init__(self, table: np.ndarray, bias: float, step: np.ndarray):
        self.table, self.bias, self.step = table, bias, step
        self.known: dict[str, float] = {}

    def __reduce__(self):
        return Machine, (self.table, self.bias, self.step)

    def tops(self, texts: list[str]) -> np.ndarray:
        """For each text the highest three margins of its distinct words, and the log of their number."""
        out = np.full((len(texts), 4), -2.0)
        for a in range(0, len(texts), 32):  # few texts at a time: their words as objects take far more room than they do
            part = [words_of(t) for t in texts[a : a + 32]]
            new = list({w for s in part for w in s if w not in self.known})
            if len(self.known) + len(new) > KNOWN:
                self.known.clear()
                new = list(set().union(*part))
            self.known.update(zip(new, margins(new, self.table, self.bias).tolist(), strict=True))
            for i, s in enumerate(part, a):
                best = heapq.nlargest(3, map(self.known.__getitem__, s))
                out[i, : len(best)] = best
                out[i, 3] = np.log1p(len(s))
            for w in new:
                if len(w) > MEMO:
                    del self.known[w]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = evidence(self.tops(texts)) @ self.step[:-1] + self.step[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def evidence(tops: np.ndarray) -> np.ndarray:
    """What the logistic step reads: the three highest margins, held within -0.5 and 1, as how far a clean word lies
    from the others tells nothing; and the log of the words, as more words reach further by chance, alone and times the
    best and second margin."""
    best = np.clip(tops[:, :3], -0.5, 1.0)
    size = tops[:, 3:] / 5
    return np.column_stack([best, size, size * best[:, :2]])


def words_of(text: str) -> set[str]:
    """Distinct words by white space in lower case, and rows of four or more single letters as one word each."""
    text = text.lower()
    words = set(text.split())
    if SPELLED.search(text):
        words.update("".join(m.group().split()) for m in SPELLED.finditer(text))
    return words


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash of the word before, word, label) for the words of every sentence; a long word as all of its parts."""
    for batch in batches:
        out = [], [], []
        for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
            found = set()
            for sentence in SENTENCE.split(text or ""):
                words = [w for w in (w.strip(string.punctuation) for w in sentence.lower().split()) if w]
                found.update(zip(["", *words], words))
                found.update(("", "".join(m.group().split())) for m in SPELLED.finditer(sentence.lower()))
            pairs = [(hash_of(a), part) for a, w in found for part in cut(w)]
            out[0].extend(a for a, _ in pairs)
            out[1].extend(part for _, part in pairs)
            out[2].extend([y] * len(pairs))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], names=["before", "word", "y"])


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Machine | None:
    """A machine from labelled documents (labels: doc_id, toxic); None without labels of both kinds.

    A share of the labels by a hash of the id bounds the sample at about LABELLED documents.
    """
    marked = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("labelled_id"), F.col("toxic").cast("int").alias("y"))
    n = marked.count()
    near = F.pmod(F.xxhash64("labelled_id", F.lit("toxic")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, LABELLED * 0.95 / max(n, 1)))
    sample = docs.select("doc_id", "text").join(F.broadcast(marked.where(near)), F.col("doc_id") == F.col("labelled_id")).select("text", "y").persist()
    rows = sample.mapInArrow(_word_rows, "before long, word string, y int")
    # a word counts once for each word that it follows, so that copies of a document, and near copies, tell no more
    # than one; it counts as toxic there only where all its documents are
    once = rows.groupBy("before", "word").agg(F.min("y").alias("y"))
    words = once.groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).persist()
    share = words.agg(F.sum("pos"), F.sum("neg")).first()
    if not share[0] or not share[1]:
        words.unpersist(), sample.unpersist()
        return None
    base = share[0] / (share[0] + share[1])
    n_words = words.count()
    # a word is told by its own counts, or by a beginning that it shares with many others
    surprise = lambda p, n: p * F.log((p + 0.1) / ((p + n) * base)) + n * F.log((n + 0.1) / ((p + n) * (1 - base)))
    telling = lambda p, n: (surprise(F.col(p), F.col(n)) > float(np.log(n_words)) + 2) & (F.col(n) <= 0.15 * F.col(p))
    begun = words.where(F.length("word") >= 4).withColumn("stem", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(4), F.lit(7)), lambda n: F.substr("word", F.lit(1), n)))))
    stems = begun.groupBy("stem").agg(F.sum("pos").alias("stem_pos"), F.sum("neg").alias("stem_neg")).where(telling("stem_pos", "stem_neg") & (F.col("stem_neg") <= 0.01 * F.col("stem_pos")))
    by_stem = begun.join(stems, "stem").where("pos > 0 and neg <= pos * 0.02").select("word", "pos", (F.log1p("pos") + F.log1p("stem_pos")).alias("weight"))
    by_word = words.where(telling("pos", "neg")).select("word", "pos", (2 * F.log1p("pos")).alias("weight"))
    positive = by_word.unionByName(by_stem).groupBy("word").agg(F.max("pos").alias("pos"), F.max("weight").alias("weight"))
    positive = positive.orderBy(F.desc("weight"), "word").limit(POSITIVE).toPandas()
    if not len(positive):
        words.unpersist(), sample.unpersist()
        return None
    chosen = set(positive["word"])
    # clean words: the commonest half, and a hash's choice of the others
    clean = words.where((F.col("neg") > 0) & (F.col("pos") <= F.col("neg")))
    frequent = clean.orderBy(F.desc("neg"), "word").limit(NEGATIVE // 2)
    pool = clean.orderBy(F.xxhash64("word"), "word").limit(20 * NEGATIVE)
    negative = [w for w in frequent.toPandas()["word"] if w not in chosen]
    pool = [w for w in pool.toPandas()["word"] if w not in chosen]
    words.unpersist()
    rng = np.random.default_rng(seed)
    table, bias = _machine(list(positive["word"]), positive["weight"].to_numpy(float), negative, pool, rng)
    machine = Machine(table, bias, np.zeros(7))
    # the logistic step on the sample's documents
    tops = sample.mapInArrow(partial(_topped, machine), "a double, b double, c double, d double, y int").toPandas()
    sample.unpersist()
    from gyrelake.llm.quality import fit_logistic

    machine.step = fit_logistic(evidence(tops[["a", "b", "c", "d"]].to_numpy()), tops["y"].to_numpy(float))
    return machine


def _machine(positive: list[str], weight: np.ndarray, negative: list[str], pool: list[str], rng) -> tuple[np.ndarray, float]:
    """Landmarks, Nystroem features, SVM, hard negatives; folded into weights per subsequence."""
    half = LANDMARKS // 2
    marks = [*positive[:half], *(rng.choice(negative, min(half, len(negative)), replace=False) if negative else [])]
    rows, _ = coded(marks)  # one each, as long words came in parts
    columns = np.unique(combined(rows)[1])  # what no landmark has adds nothing to a kernel value
    anchors = spread(rows, columns)
    k = anchors @ anchors.T
    value, vector = np.linalg.eigh(k.astype(float))
    keep = value > 1e-4 * value.max()
    white = vector[:, keep] / np.sqrt(value[keep])  # features are k(word, landmarks) @ white

    def features(words: list[str]) -> np.ndarray:
        parts = []
        for at in range(0, len(words), 256):
            parts.append((spread(coded(words[at : at + 256])[0], columns) @ anchors.T) @ white)
        return np.concatenate(parts) if parts else np.zeros((0, white.shape[1]))

    xp, negative = features(positive), list(negative)
    xn = features(negative)
    table, bias = np.zeros(LETTERS**3), -1.0
    for step in range(ROUNDS):
        x = np.concatenate([xp, xn])
        y = np.append(np.ones(len(xp)), -np.ones(len(xn)))
        # both kinds weigh the same in all; the ridge is a tenth of an average positive word
        cost = np.append(0.5 * weight / weight.sum(), np.full(len(xn), 0.5 / max(len(xn), 1)))
        w, bias = train_svm(x, y, cost, ridge=0.05 / len(xp))
        table[columns] = anchors.T @ (white @ w)
        if step + 1 < ROUNDS and pool:
            m = margins(pool, table, bias)
            order = np.argsort(-m)
            hard = [pool[i] for i in order[: NEGATIVE // 4] if m[i] > -1]
            if not hard:
                break
            xn = np.concatenate([xn, features(hard)])
            pool = [pool[i] for i in order[len(hard) :]]
    return table, bias


def _topped(machine: Machine, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = machine.tops([t or "" for t in batch["text"].to_pylist()])
        yield pa.RecordBatch.from_arrays([*(pa.array(tops[:, i]) for i in range(4)), batch["y"]], names=["a", "b", "c", "d", "y"])


def _scores(machine: Machine, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(machine.scores([t or "" for t in batch["text"].to_pylist()]))], schema=SCORED)


def toxicity(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score of every document."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if machine is None:
        return ids.select("doc_id", F.lit(0.0).alias("score"))
    return ids.mapInArrow(partial(_scores, machine), "doc_id long, score double")
