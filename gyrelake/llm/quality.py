"""Quality classification by co-training on two views of a document.

The text view sees what words a document has, by weights of hashed words learnt from one half of the labelled rows (the
other half is what the views are fitted on), and counts of characters, words and lines; the metadata view sees weights
of source and language, learnt from the same half, the declared length and how it agrees with the text. Each view is a
logistic model. Over a few rounds each model labels those of all other documents that it is most sure of, a share that
grows by round, and the other model is fitted on them too. Each view is then calibrated on labelled documents kept out
of its training, and a last logistic step on both calibrated log-odds combines them; a view that tells nothing gets a
weight near 0.

Features are computed by Spark in one scan of the documents and written, some 80 bytes a document. Only the labelled
sample reaches the driver. What the views are sure of is found by histograms of log-odds over all other documents, and
a Newton step adds up their gradients and curvatures in tasks: a few hundred numbers come back. Where copies tie at the
bound of the share, all of them count in part, so no choice among equal rows is made. Taught rows weigh as much in all
as `TRUST` of the labelled ones, at every size of the table.

Defined results: a null text equals an empty one; a null or unseen source or language weighs 0; a declared length that
is no finite number counts as missing; the labels' rows without a label or document are left out; a document with
several labels takes their mean; without usable labels of both kinds every document scores 0.5 and is kept; repeated
rows count each and score alike, and so do rows without an id; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrelake.llm.common import free_name, written

#: Labelled rows at most, about, that are fitted on.
LABELLED = 20_000
#: Rounds of fitting; the share of the other documents that a view labels in a round grows by SHARE each; how sure it is.
ROUNDS, SHARE, SURE = 4, 0.05, 0.95
#: Weight of all taught rows against that of the labelled ones.
TRUST = 0.5
#: Log-odds are held within REACH and counted in BINS steps.
REACH, BINS = 30.0, 6000
#: Numbers that words are hashed to, for their weights.
BUCKETS = 4096
#: Newton steps of a round at most.
STEPS = 12
TEXT_FEATURES = ("content", "length", "symbols", "digits", "uppers", "spaces", "lines", "pipes", "ends", "word_length", "repeats", "twice", "short")
META_FEATURES = ("declared", "agrees", "missing", "source", "lang")


def hashed_words(text: Column) -> Column:
    """Numbers of a text's words in lower case, cut at spaces and line ends."""
    return F.transform(F.split(F.lower(F.translate(text, "\n\t", "  ")), " "), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def word_weights(marked: DataFrame) -> list[float]:
    """For each number of words the log of how much likelier a good document (y = 1) has it than another. Rows: text, y."""
    has = marked.select("y", F.explode(F.array_distinct(hashed_words(F.coalesce("text", F.lit("")))) ).alias("bucket"))
    seen = {r["bucket"]: (r["good"], r["all"] - r["good"]) for r in has.groupBy("bucket").agg(F.sum("y").alias("good"), F.count("*").alias("all")).collect()}
    good, every = marked.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count("*")).first()
    return [float(np.log((g + 1) / (good + 2)) - np.log((b + 1) / (every - good + 2))) for g, b in (seen.get(i, (0, 0)) for i in range(BUCKETS))]


def value_weights(marked: DataFrame, column: str) -> list[tuple[str, float]]:
    """For each value of a column how much likelier than all rows its rows are good, as a difference of log-odds. As many values as
    labelled rows at most. Rows: the column, y."""
    seen = marked.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum("y"), F.count("*")).collect()
    good, every = marked.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count("*")).first()
    base = (good + 1) / (every + 2)
    return [(r[0], float(np.log((r[1] + 2 * base) / (r[2] - r[1] + 2 * (1 - base))) - np.log(base / (1 - base)))) for r in seen]


def text_view(text: Column, weights: list[float]) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    words = hashed_words(text)
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")  # one constant of the plan
    content = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.get(table, w)) / F.greatest(F.size(words), F.lit(1))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    # the characters of a class are what replacing them takes away; translate runs no pattern
    gone = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    spaces = gone(" ")
    lines = (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("double")
    pieces = F.split(text, "\n")
    return {
        "content": content,
        "length": F.log1p(F.length(text).cast("double")),
        "symbols": F.sqrt(gone("#$%&*@^~<>{}[]\\=_+")),
        "digits": F.sqrt(gone("0123456789")),
        "uppers": F.sqrt(gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "spaces": spaces,
        "lines": F.log1p(lines / n * 100),
        "pipes": F.sqrt(gone("|")),
        "ends": F.sqrt(gone(".,;:!?")),
        "word_length": F.log1p(n / (spaces * n + lines)),
        "repeats": 1 - F.size(F.array_distinct(pieces)) / F.greatest(F.size(pieces), F.lit(1)),
        "twice": F.sqrt(F.regexp_count(text, F.lit(r"(?<!\S)(\S++) (?=\1(?!\S))")) / (spaces * n + lines)),
        "short": 1 / F.sqrt(n),
    }


def meta_view(df: DataFrame, source: Column, lang: Column) -> dict[str, Column]:
    declared = F.col("n_chars").try_cast("double") if "n_chars" in df.columns else F.lit(None).cast("double")
    declared = F.when(F.abs(declared) < 1e18, declared)  # nor NaN
    actual = F.length(F.coalesce("text", F.lit(""))).cast("double")
    return {
        "declared": F.coalesce(F.log1p(F.greatest(declared, F.lit(0.0))), F.lit(0.0)),
        "agrees": F.coalesce((declared == actual).cast("double"), F.lit(0.0)),
        "missing": declared.isNull().cast("double"),
        "source": F.coalesce(source, F.lit(0.0)),
        "lang": F.coalesce(lang, F.lit(0.0)),
    }


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights (bias last) by Newton steps with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) / len(x) + ridge * w)
        w -= step * min(1.0, 5 / (np.linalg.norm(step) + 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w


class View:
    """A logistic model over columns standardised by the labelled rows."""

    def __init__(self, x: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.w = np.zeros(x.shape[1] + 1)

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.w, -REACH, REACH)

    def raw(self) -> tuple[np.ndarray, float]:
        """Weights and bias for columns as they are."""
        w = self.w[:-1] / self.scale
        return w, float(self.w[-1] - (w * self.mean).sum())


def slopes(z: np.ndarray, y: np.ndarray, w: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Curvature of the logistic loss with its gradient as a last row, added up over the rows."""
    p = 1 / (1 + np.exp(-np.clip(z @ w, -REACH, REACH)))
    return np.vstack([(z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z, z.T @ (weight * (p - y))])


def bins(odds: np.ndarray) -> np.ndarray:
    return np.clip(((odds + REACH) * (BINS / (2 * REACH))).astype(int), 0, BINS - 1)


def surest(counts: np.ndarray, base: float, share: float) -> np.ndarray:
    """How much a row of each bin counts as taught, so that of each label a share is taken in all, the surest first.
    Bins above the middle teach label 1. Nothing less sure than SURE is taken; the last bin in part."""
    out = np.zeros(BINS)
    sure = int(bins(np.array([np.log(SURE / (1 - SURE))]))[0]) + 1
    for c, take, part in ((counts[::-1][: BINS - sure], out[::-1][: BINS - sure], base), (counts[: BINS - sure], out[: BINS - sure], 1 - base)):
        wanted = share * part * counts.sum()
        take[:] = np.clip(wanted - (np.cumsum(c) - c), 0, c) / np.maximum(c, 1)
    return out


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch[c].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), n).astype(float) for c, n in (("t", len(TEXT_FEATURES)), ("m", len(META_FEATURES))))


def _added(found: list[np.ndarray]) -> pa.RecordBatch:
    """Numbers of both views in a row, without zeros."""
    value = np.concatenate([f.ravel() for f in found])
    at = np.flatnonzero(value)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(value[at])], names=["at", "value"])


def _counts(views: list[View], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [np.zeros(BINS), np.zeros(BINS)]
    for batch in batches:
        for view, x, f in zip(views, _matrices(batch), found, strict=True):
            f += np.bincount(bins(view.odds(x)), minlength=BINS)
    yield _added(found)


def _slopes(views: list[View], teachers: list[View], taken: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [np.zeros((len(v.w) + 1, len(v.w))) for v in views]
    for batch in batches:
        both = _matrices(batch)
        for v in (0, 1):
            at = bins(teachers[1 - v].odds(both[1 - v]))
            rows = np.flatnonzero(taken[1 - v][at])
            at = at[rows]
            found[v] += slopes(views[v].design(both[v][rows]), (at >= BINS // 2).astype(float), views[v].w, taken[1 - v][at])
    yield _added(found)


def _sums(others: DataFrame, work, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """What tasks find in all the other documents, added up number by number."""
    rows = others.mapInArrow(work, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    flat = np.zeros(sum(int(np.prod(n)) for n in shapes))
    flat[rows["at"].to_numpy(int)] = rows["value"].to_numpy(float)
    cut = int(np.prod(shapes[0]))
    return [flat[:cut].reshape(shapes[0]), flat[cut:].reshape(shapes[1])]


def co_train(mine: list[np.ndarray], y: np.ndarray, held: np.ndarray, others: DataFrame, ridge: float = 1e-3) -> tuple[list[View], np.ndarray]:
    """Both views, calibrated, and the weights that combine them (text, metadata, bias). `mine`: the labelled rows'
    numbers by view; `held` marks those kept for calibration; `others` have columns t and m."""
    fit, cal = (~held, held) if len(y) >= 50 and len(set(y[held])) > 1 and len(set(y[~held])) > 1 else (np.ones(len(y), bool),) * 2
    views = [View(x[fit]) for x in mine]
    shapes = [(len(v.w) + 1, len(v.w)) for v in views]
    for v in (0, 1):
        views[v].w = fit_logistic((mine[v][fit] - views[v].mean) / views[v].scale, y[fit], ridge=ridge)
    for r in range(1, ROUNDS):
        counts = _sums(others, partial(_counts, views), [(BINS,), (BINS,)])
        taken = [surest(c, y[fit].mean(), SHARE * r) for c in counts]
        taught = [float((taken[1 - v] * counts[1 - v]).sum()) for v in (0, 1)]
        if not any(taught):
            break
        teachers = [View(x[fit]) for x in mine]
        for teacher, view in zip(teachers, views, strict=True):
            teacher.w = view.w.copy()
        for _ in range(STEPS):
            more = _sums(others, partial(_slopes, views, teachers, taken), shapes)
            moved = 0.0
            for v, view in enumerate(views):
                trust = TRUST * fit.sum() / taught[v] if taught[v] else 0.0
                both = slopes(view.design(mine[v][fit]), y[fit], view.w) + trust * more[v]
                n = fit.sum() + trust * taught[v]
                step = np.linalg.solve(both[:-1] / n + ridge * np.eye(len(view.w)), both[-1] / n + ridge * view.w)
                step *= min(1.0, 5 / (np.linalg.norm(step) + 1e-9))
                view.w = view.w - step
                moved = max(moved, float(np.abs(step).max()))
            if moved < 1e-4:
                break
    each = []
    for v in (0, 1):  # Platt's step for each view
        a = fit_logistic(views[v].odds(mine[v][cal])[:, None], y[cal])
        views[v].w = np.append(views[v].w[:-1] * a[0], views[v].w[-1] * a[0] + a[1])
        each.append(views[v].odds(mine[v][cal]))
    return views, fit_logistic(np.column_stack(each), y[cal], ridge=1e-2)


def described(docs: DataFrame, words: list[float], values: dict[str, list[tuple[str, float]]]) -> tuple[DataFrame, Column, Column]:
    """`docs` with columns added for the weights of source and language, and both views' numbers as expressions over it."""
    out, found = docs, {}
    for c, known in values.items():
        if c not in docs.columns:
            found[c] = F.lit(None).cast("double")
            continue
        key, weight = free_name(out, f"{c}_value"), free_name(out, f"{c}_weight")
        # no more rows than LABELLED
        of = F.broadcast(docs.sparkSession.createDataFrame(known, f"{key} string, {weight} double"))
        out = out.join(of, F.col(c).cast("string") == F.col(key), "left")
        found[c] = F.col(weight)
    text, meta = text_view(F.col("text"), words), meta_view(docs, found["source"], found["lang"])
    row = lambda view, names: F.array(*[view[k].cast("float") for k in names])
    return out, row(text, TEXT_FEATURES), row(meta, META_FEATURES)


class Classifier:
    """What `fit` learns: weights of words and values, both views and how they combine; None in place of views without labels of both kinds."""

    def __init__(self, words: list[float], values: dict[str, list[tuple[str, float]]], views: list[View] | None, joint: np.ndarray | None):
        self.words, self.values, self.views, self.joint = words, values, views, joint

    def score(self, text: Column, meta: Column) -> Column:
        """Score of a row from both views' numbers."""
        if self.views is None:
            return F.lit(0.5)
        clip = lambda c: F.greatest(F.least(c, F.lit(REACH)), F.lit(-REACH))
        odds = F.lit(float(self.joint[2]))
        for view, numbers, share in zip(self.views, (text, meta), self.joint, strict=False):
            w, bias = view.raw()
            odds = odds + float(share) * clip(sum((F.lit(float(x)) * numbers[i].cast("double") for i, x in enumerate(w)), F.lit(bias)))
        return 1 / (1 + F.exp(-clip(odds)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Classifier, DataFrame]:
    """A classifier, and the numbers of all documents as a table (doc_id, t, m) that it was taught on."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    # a share of the labels by a hash of the id bounds the sample
    share = min(1.0, LABELLED * 0.95 / max(marked.count(), 1))
    chosen = written(marked.where(F.pmod(F.xxhash64("labelled_id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * share)))
    part = lambda salt, n: F.pmod(F.xxhash64("labelled_id", F.lit(salt)), F.lit(n)) == 0
    sample = docs.select("doc_id", "text", *[c for c in ("source", "lang", "n_chars") if c in docs.columns])
    known = sample.join(F.broadcast(chosen.where(part("words", 2))), F.col("doc_id") == F.col("labelled_id")).persist()
    words = word_weights(known)
    values = {c: value_weights(known.withColumn(c, F.col(c).cast("string")), c) if c in sample.columns else [] for c in ("source", "lang")}
    known.unpersist()
    rows, text, meta = described(sample.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"), "left"), words, values)
    rows = written(rows.select("doc_id", "y", part("words", 2).alias("read"), part("held", 5).alias("held"), text.alias("t"), meta.alias("m")))
    lab = rows.where("y is not null and not read").toPandas()
    y = lab["y"].to_numpy(float)
    if len(set(y)) < 2:
        return Classifier(words, values, None, None), rows
    mine = [np.vstack(lab[c].to_numpy()).astype(float) for c in ("t", "m")]
    views, joint = co_train(mine, y, lab["held"].to_numpy(bool), rows.where("y is null").select("t", "m"))
    return Classifier(words, values, views, joint), rows


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Per document: doc_id, score and kept (score >= least)."""
    model, rows = fit(docs, labels)
    out = rows.select("doc_id", model.score(F.col("t"), F.col("m")).alias("score"))
    return out.withColumn("kept", F.col("score") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` that score `least` at least, with its columns."""
    model, _ = fit(docs, labels)
    out, text, meta = described(docs, model.words, model.values)
    return out.where(model.score(text, meta) >= least).select(*docs.columns)
