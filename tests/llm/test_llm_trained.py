"""Trained operators by held-out accuracy and odd inputs; the pipeline stage by stage."""

import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gyrelake.llm import quality, queries, toxicity


def area(score, y):
    """The chance that a row of label 1 scores higher than one of label 0."""
    rank = score.rank()
    return (rank[y].mean() - (y.sum() + 1) / 2) / (~y).sum()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op1_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    y = rows["toxic"] == 1
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.7)).all()
    assert area(rows["score"], y) > 0.95 and (rows["predicted"] == 1)[y].mean() > 0.8 and (rows["predicted"] == 1)[~y].mean() < 0.02


def test_kernel_stands_gaps_and_signs():
    rows, _ = toxicity.coded(["dreadful", "dreaddful", "dr.ead.ful", "dre4dful", "mountain"])
    x = toxicity.spread(rows, np.arange(toxicity.LETTERS**3))
    near = x @ x[0]
    assert near[2] == near[3] == pytest.approx(1, abs=1e-5) and near[1] > 0.7 > 0.2 > near[4]


def test_folded_machine_equals_the_kernel():
    """One weight per subsequence gives the same margins as products with spread-out words."""
    rng = np.random.default_rng(2)
    table = rng.normal(size=toxicity.LETTERS**3)
    words = ["dreadful", "a", "mountains", "aaaaaa"]
    rows, _ = toxicity.coded(words)
    assert toxicity.margins(words, table, 0.5) == pytest.approx(toxicity.spread(rows, np.arange(len(table))) @ table + 0.5, abs=1e-3)


def plain_kernel(a, b):
    """The kernel by all triples of letters that lie within the span."""

    def counts(word):
        letters, found = [toxicity.BEGIN, *(ord(c) - 96 for c in word), toxicity.END], Counter()
        for x in combinations(range(len(letters)), 3):
            if x[2] - x[0] < toxicity.SPAN:
                found[tuple(letters[i] for i in x)] += toxicity.DECAY ** (x[2] - x[0] - 2)
        return found

    p, q = counts(a), counts(b)
    return sum(n * q[k] for k, n in p.items()) / np.sqrt(sum(n * n for n in p.values()) * sum(n * n for n in q.values()))


def test_machine_equals_a_plain_kernel_machine():
    """Landmark products, whitening and the SVM from kernel values alone."""
    positive, negative, unseen = ["dreadful", "dreadfully", "awful"], ["mountain", "river", "full", "a"], ["dreaadful", "rivers", "xyz"]
    weight = np.array([3.0, 1.0, 2.0])
    table, bias = toxicity._machine(positive, weight, negative, [], np.random.default_rng(1))
    marks = positive + negative
    of = lambda words: np.array([[plain_kernel(w, m) for m in marks] for w in words])
    value, vector = np.linalg.eigh(of(marks))
    white = vector / np.sqrt(value)
    cost = np.append(0.5 * weight / weight.sum(), np.full(len(negative), 0.5 / len(negative)))
    w, b = toxicity.train_svm(of(marks) @ white, np.append(np.ones(len(positive)), -np.ones(len(negative))), cost, ridge=0.05 / len(positive))
    assert bias == pytest.approx(b, abs=1e-3)
    assert toxicity.margins(marks + unseen, table, bias) == pytest.approx(of(marks + unseen) @ white @ w + b, abs=1e-2)


def test_long_words_in_bounded_memory():
    """An insult anywhere in an unbroken word of a million letters counts, and memory does not grow with the word."""
    rng = np.random.default_rng(3)
    table, bias = toxicity._machine(["dreadful"], np.ones(1), ["mountain", "river", "stone"], [], rng)
    machine = toxicity.Machine(table, bias, np.ones(7))
    blob = "".join(rng.choice(list("bcghjkmnpqvwxz"), 1_000_000))
    peaks = []
    for n in (100_000, 1_000_000):
        text = blob[: n // 2] + "dreadful" + blob[n // 2 : n]
        tracemalloc.start()
        best = machine.tops([text])[0, 0]
        peaks.append(tracemalloc.get_traced_memory()[1] / 2**20)
        tracemalloc.stop()
        assert best > machine.tops([blob[:n]])[0, 0] + 0.2
    assert peaks[1] < 150 and peaks[1] < peaks[0] + 30 and not machine.known


def test_parts_cover_a_word():
    for n in (1, 24, 25, 31, 32, 100, 999):
        word = "".join(chr(200 + i) for i in range(n))
        assert {c for p in toxicity.cut(word) for c in p} == set(word) and all(len(p) <= toxicity.LONGEST for p in toxicity.cut(word))


def test_toxicity_odd_inputs(spark, make, prose):
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(prose))], "doc_id long, toxic int")
    docs = make([*prose, *prose])
    machine = toxicity.fit(docs, labels)
    rows = toxicity.toxicity(docs, machine).collect()
    assert len(rows) == len(prose) * 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and toxicity.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.toxicity(docs, None).collect()} == {0.0}
    assert toxicity.toxicity(make([]), machine).count() == 0


def test_quality_on_unseen_documents(spark):
    """Fitted on two thirds of the labels, held against the rest."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    rows = quality.quality_scores(docs, labels.where(~held)).join(labels.where(held), "doc_id").toPandas()
    y = rows["quality"] == 1
    assert area(rows["score"], y) > 0.95 and (rows["score"] >= corpus_pipeline.LEAST_QUALITY)[y].mean() > 0.99


def plain_co_train(mine, y, held, pool):
    """Co-training with every row in memory: each view fitted anew on the labelled rows and those it is taught."""
    fit, views = ~held, [quality.View(x[~held]) for x in mine]

    def fitted(v, rows=(), label=(), weight=()):
        x = np.vstack([mine[v][fit], pool[v][list(rows)]])
        weight = np.append(np.ones(fit.sum()), weight)
        views[v].w = quality.fit_logistic((x - views[v].mean) / views[v].scale, np.append(y[fit], label), weight * len(x) / weight.sum())

    for v in (0, 1):
        fitted(v)
    for r in range(1, quality.ROUNDS):
        taught = []
        for v in (0, 1):
            at = quality.bins(views[1 - v].odds(pool[1 - v]))
            found = {}
            for label, base, order in ((1, y[fit].mean(), sorted(set(at.tolist()), reverse=True)), (0, 1 - y[fit].mean(), sorted(set(at.tolist())))):
                left = quality.SHARE * r * base * len(at)
                for b in order:
                    odds = (b if label else b + 1) / quality.BINS * 2 * quality.REACH - quality.REACH
                    if (odds if label else -odds) < np.log(quality.SURE / (1 - quality.SURE)) or left <= 0:
                        break
                    rows = np.flatnonzero(at == b).tolist()
                    found |= {i: (label, min(1, left / len(rows))) for i in rows}
                    left -= len(rows)
            taught.append(found)
        for v in (0, 1):
            weight = np.array([w for _, w in taught[v].values()])
            fitted(v, taught[v], [label for label, _ in taught[v].values()], weight * quality.TRUST * fit.sum() / weight.sum() if len(weight) else [])
    each = []
    for v in (0, 1):
        odds = views[v].odds(mine[v][held])
        a = quality.fit_logistic(odds[:, None], y[held])
        views[v].w = np.append(views[v].w[:-1] * a[0], views[v].w[-1] * a[0] + a[1])
        each.append(views[v].odds(mine[v][held]))
    return views, quality.fit_logistic(np.column_stack(each), y[held], ridge=1e-2)


def test_co_training_equals_the_plain_one(spark):
    rng = np.random.default_rng(4)
    sizes = len(quality.TEXT_FEATURES), len(quality.META_FEATURES)

    def drawn(n, turn=0.0):
        y = (rng.random(n) < 0.6).astype(float)
        return y, [(rng.normal(size=(n, k)) + (y[:, None] * 2 - 1 + turn) * np.linspace(0, 1.2, k)).astype(np.float32).astype(float) for k in sizes]

    y, mine = drawn(200)
    _, pool = drawn(3000, 0.3)
    pool = [np.vstack([p, np.repeat(p[:1], 1000, 0)]) for p in pool]  # a hot group of copies
    held = np.arange(200) % 5 == 0
    others = spark.createDataFrame([(t.tolist(), m.tolist()) for t, m in zip(*pool, strict=True)], "t array<float>, m array<float>").repartition(5)
    views, joint = quality.co_train(mine, y, held, others)
    plain, plain_joint = plain_co_train(mine, y, held, pool)
    alone = quality.fit_logistic((mine[1][~held] - views[1].mean) / views[1].scale, y[~held])
    assert joint == pytest.approx(plain_joint, abs=2e-2)
    for v in (0, 1):
        assert views[v].w == pytest.approx(plain[v].w, abs=2e-2)
    assert np.abs(views[1].w / np.linalg.norm(views[1].w) - alone / np.linalg.norm(alone)).max() > 0.01  # the exchange has an effect


def test_score_expression_equals_the_views(spark):
    rng = np.random.default_rng(6)
    numbers = [rng.normal(size=(50, len(n))).astype(np.float32).astype(float) for n in (quality.TEXT_FEATURES, quality.META_FEATURES)]
    views = [quality.View(x) for x in numbers]
    for view in views:
        view.w = rng.normal(size=len(view.w))
    model = quality.Classifier([], {}, views, np.array([0.7, 0.4, -0.2]))
    df = spark.createDataFrame([(t.tolist(), m.tolist()) for t, m in zip(*numbers, strict=True)], "t array<float>, m array<float>").coalesce(1)
    z = 0.7 * views[0].odds(numbers[0]) + 0.4 * views[1].odds(numbers[1]) - 0.2
    assert [r[0] for r in df.select(model.score(F.col("t"), F.col("m"))).collect()] == pytest.approx(1 / (1 + np.exp(-z)))


def test_share_of_the_surest():
    counts = np.zeros(quality.BINS)
    counts[-1], counts[-5], counts[quality.BINS // 2], counts[0] = 30, 1000, 500, 10
    taken = quality.surest(counts, 0.5, 0.2)
    assert taken[-1] == 1 and taken[-5] == pytest.approx((154 - 30) / 1000) and taken[0] == 1 and taken[quality.BINS // 2] == 0


def test_quality_odd_columns(spark):
    """Declared lengths that are no numbers, unseen values, columns that clash with inner names, copies and no ids."""
    rows = [(i if i % 7 else None, f"word {'x' * (i % 5)} text {i % 3}", f"s{i % 4}", ("nan", "12", None, "many")[i % 4], "v", 0.5) for i in range(60)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars string, source_value string, y double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(5, 0)], "doc_id long, quality int")
    out = quality.quality_scores(docs, labels).toPandas()
    assert len(out) == 120 and out["score"].between(0, 1).all() and out.groupby("doc_id")["score"].nunique().max() == 1
    kept = quality.keep_good(docs, labels, 0.5)
    assert kept.columns == docs.columns and kept.count() == out["kept"].sum()


def test_quality_odd_inputs(spark, make, prose):
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(prose))] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, quality int")
    docs = make(prose)
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(prose) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.keep_good(docs, labels, 0.0).columns == docs.columns and quality.keep_good(docs, labels, 0.0).count() == len(prose)
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(make([]), labels).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).persist()
        assert out.columns == before and 0 < out.count() <= docs.count(), name
        if name == "exact_dedup":
            assert out.count() == docs.select("text").distinct().count()
        if name == "pii":
            assert out.count() == docs.count() and not out.where(F.col("text").rlike(r"[a-z]@[a-z]+\.[a-z]")).count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, sf).count() == last.count()
