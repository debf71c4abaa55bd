"""Hard negatives, spelling variants and decontamination against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrelake.llm import decontamination, hard_negatives, spelling

# --- decontamination


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text))


def plain_hits(docs, items, size=10):
    """Per document: words, positions hit, items met."""
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(len(w), size)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, met = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    met |= windows[tuple(w[k : k + n])]
        ids = sorted(str(x) for x in met if x is not None)
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture(scope="module")
def leaked():
    """Documents with whole, cut, re-cased and repeated passages of items, and items of every small length."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "straße", "漢字", "9", "x2y"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([0, 1, 2, 5, 9, 10, 11, 30])))) for i in range(25)]
    items += [(100, items[-1][1]), (100, items[-1][1]), (None, " ".join(text(12))), (101, None), (102, "  ..! ")]
    docs = []
    for _ in range(40):
        own = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(len(w) - 8, 0))
            own[len(own) // 2 : len(own) // 2] = w[a : a + rng.randint(5, 30)]
        docs.append((rng.choice([" ", ", ", "\n-"])).join(w.upper() if rng.random() < 0.3 else w for w in own))
    return docs + [None, "", "...", "w1", items[7][1] or "w2", (items[-3][1] + " ") * 40], items


def test_windows_hit(spark, make, leaked):
    docs, items = leaked
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("hash", F.lit("x"))
    found = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontamination.judged(make(docs), table).collect()}
    assert found == plain_hits(list(enumerate(docs)), items)


def test_windows_in_blocks(spark, make, leaked):
    """A benchmark too large for one broadcast is scanned in blocks, with the same hits."""
    docs, items = leaked
    told, _, lengths = decontamination.windows(spark.createDataFrame(items, "item_id long, text string"))
    hits = lambda most: sorted(decontamination.hits(make(docs), told, lengths, most).drop("text_hash").collect())
    assert hits(1 << 20) == hits(2000)


def test_removal(spark, make, leaked):
    docs, items = leaked
    table = spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(list(enumerate(docs)), items)
    rows = {r["doc_id"]: r["text"] for r in decontamination.decontaminated(make(docs), table).collect()}
    assert len(rows) == len(docs)
    for i, text in rows.items():
        assert len(plain_words(text)) == want[i][0] - want[i][1]
        assert want[i][4] or text == docs[i]
    assert {r["doc_id"] for r in decontamination.decontaminated(make(docs), table, drop_documents=True).collect()} == {i for i, w in want.items() if not w[4]}
    assert decontamination.decontaminated(make(docs), table).columns == make(docs).columns


def test_decontamination_of_odd_tables(spark, make):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    none = items.limit(0)
    assert [(r["n_words"], r["contaminated"]) for r in decontamination.judged(make(["a b", None]), none).orderBy("doc_id").collect()] == [(2, False), (0, False)]
    assert decontamination.judged(make([]), items).count() == 0
    rows = [(None, "x a b c d e f g h i j"), (None, "x a b c d e f g h i j"), (5, "no"), (5, "a b c d e f g h i j k"), (6, "word " * 200_000)]
    found = sorted(((r["doc_id"] or 0), r["n_hit"], r["n_items"]) for r in decontamination.judged(make(rows), items).collect())
    assert found == [(0, 10, 1), (0, 10, 1), (5, 0, 0), (5, 11, 1), (6, 0, 0)]


# --- spelling


def plain_vocabulary(docs, least=7, one_in=31):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = ascii_lower(run)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_forms(vocabulary, ratio=10):
    near = {a: [b for b in vocabulary if one_edit(a, b)] for a in vocabulary}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= ratio * vocabulary[w] else None
    out = {}
    for w in vocabulary:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, vocabulary[w], len(near[w]), vocabulary.get(form[w]))
    return out


def found_forms(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.fixture(scope="module")
def slips():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcé", k=rng.randint(7, 9))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "bababab"]

    def slip(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[:k] + rng.choice("abc") + w[k + 1 :]])

    docs = []
    for _ in range(120):
        own = [rng.choice(words[:6]) for _ in range(30)] + [slip(rng.choice(words)) for _ in range(12)] + [slip(slip(rng.choice(words))) for _ in range(5)]
        docs.append(" ".join(w.upper() if rng.random() < 0.2 else w for w in own))
    docs += ["acbbacbé " * 600, "acbbacb " * 40, "acbcacb acbcacb acbcacb"]  # a slip of a slip
    return docs + [None, "", "short", "ÀÉ×÷ÿÀÉ ÀÉ×÷ÿÀÉ", "x" * 3000 + " " + "x" * 3000, "x" * 2999 + " " + "x" * 2999]


def test_forms(make, slips):
    want = plain_forms(plain_vocabulary(list(enumerate(slips))))
    assert any(w[0] and w[1] != w[0] for w in want.values())  # chains of forms
    assert found_forms(spelling.spelling_groups(make(slips), delete_one_in=31)) == want


@pytest.mark.parametrize("most", [1, 5, 10**6])
def test_near_words(spark, make, slips, most):
    """Groups dealt again until they are small give each pair once, too."""
    rng = random.Random(6)
    vocabulary = {w for i in range(400) for w in ["".join(rng.choices("ab", k=rng.randint(1, 9)))]} | set(plain_vocabulary(list(enumerate(slips))))
    table = spark.createDataFrame([(w, len(w)) for w in sorted(vocabulary)], "word string, n long")
    found = [tuple(sorted((r["word"], r["near"]))) for r in spelling.near_words(table, most=most).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in vocabulary for b in vocabulary if a < b and one_edit(a, b)}


def test_spelling_of_odd_tables(make):
    assert spelling.spelling_groups(make([])).count() == 0
    assert spelling.spelling_groups(make([None, "", "abc"])).count() == 0
    rows = [(None, "wordings"), (None, "wordings"), (3, "Wordings wordingz"), (3, "wordingz")]
    assert found_forms(spelling.spelling_groups(make(rows))) == {"wordings": (None, "wordings", 3, 1, None), "wordingz": (None, "wordingz", 2, 1, None)}


# --- hard negatives


def plain_negatives(rows, anchors, percent=80, k=5):
    rows = [(i, label, v) for i, label, v in rows if None not in (i, label) and v and None not in v]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = set()
    for a, label, v in rows:
        if a not in anchors:
            continue
        scored = [(-score(v, w), i, lab) for i, lab, w in rows if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:k]:
            band = sorted(x for x in scored if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out |= {(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(band)}
    return out


def found_negatives(df):
    rows = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, vector array<long>").withColumns({"score": F.lit(1), "pivot": F.lit("x"), "rank": F.lit(2)})


@pytest.mark.parametrize("spread", [1, 60])
def test_hard_negatives(spark, monkeypatch, spread):
    """Clusters and ties, a third of the rows equal, other lengths, rows that take no part."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    monkeypatch.setattr(hard_negatives, "QUERIES", 4)
    rng = np.random.default_rng(spread)
    centres = rng.integers(-100, 100, (6, 8))
    rows = [(i, int(rng.integers(4)), (centres[rng.integers(6)] + rng.integers(-spread, spread + 1, 8)).tolist()) for i in range(500)]
    rows += [(i, i % 3, [50] * 8) for i in range(500, 750)]
    rows += [(750, 1, [3, 4]), (800, 1, [3, 5]), (801, 2, [3, 4]), (802, 3, []), (803, None, [1] * 8), (None, 1, [1] * 8), (804, 2, None), (850, 2, [1, None]), (900, 2, [0] * 8)]
    found = found_negatives(hard_negatives.hard_negatives(vectors(spark, rows), vectors(spark, rows).where("id % 50 = 0")))
    assert found == plain_negatives(rows, set(range(0, 901, 50)))
    assert len(found) > 100


def test_search_in_far_clusters(spark, monkeypatch):
    """One query whose answers lie in the blocks of one pivot."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, (np.eye(8, dtype=int)[i % 8] * 1000 + rng.integers(-3, 4, 8)).tolist()) for i in range(800)]
    made = hard_negatives.build_index(hard_negatives.usable(vectors(spark, rows)), pivots=8)
    asked = vectors(spark, rows[:1]).select("id", "label", "vector", F.array(F.struct(F.lit(0).alias("number"), F.lit(True).alias("same"), F.lit(-(1 << 62)).alias("floor"), F.lit(1 << 62).alias("cap"))).cast(hard_negatives.REQUEST).alias("requests"))
    found = [r["vec_id"] for r in hard_negatives.search(made, asked, 5).orderBy("rank").collect()]
    scores = {i: int(np.dot(v, rows[0][2])) for i, label, v in rows[1:] if label == 0}
    assert found == sorted(scores, key=lambda i: (-scores[i], i))[:5]


def test_hard_negatives_of_odd_tables(spark):
    assert hard_negatives.hard_negatives(vectors(spark, []), vectors(spark, [])).count() == 0
    rows = [(1, 1, [1, 2]), (1, 1, [2, 1]), (2, 1, [1, 1]), (3, 2, [1, 1])]
    assert hard_negatives.hard_negatives(vectors(spark, rows), vectors(spark, rows[:0])).count() == 0
    # the anchor's smallest row counts; its other row is no candidate for itself
    assert found_negatives(hard_negatives.hard_negatives(vectors(spark, rows), vectors(spark, rows[:2]))) == {(1, 2, 1, 3, 3, 3)}
