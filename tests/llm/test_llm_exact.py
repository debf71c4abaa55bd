"""Operators with exact results against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gyrelake.llm import exact_dedup, lm_scoring, near_dedup, packing, pii, repeats, sentencepieces, topk

BPE, SPM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# --- near duplicates


def plain_groups(rows, least=85):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


@pytest.mark.parametrize("least", [85, 80])
def test_near_groups(make, prose, least):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(make(prose), least).collect()}
    assert found == plain_groups(list(enumerate(prose)), least)


@pytest.mark.parametrize("sparse", [0, 10**9])
def test_near_groups_by_centres_or_pairs(make, prose, monkeypatch, sparse):
    """What the buckets' centres leave over is settled by further centres, or by pairs."""
    monkeypatch.setattr(near_dedup, "SPARSE", sparse)
    rng = random.Random(8)
    words = [f"v{i}" for i in range(300)]
    base, rows = [rng.choice(words) for _ in range(150)], list(prose)
    for _ in range(60):  # copies about as far from each other as the bound
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(150)] = rng.choice(words[:6])
        rows.append(" ".join(own[rng.randint(0, 20) : 150 - rng.randint(0, 20)]))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(make(rows)).collect()}
    assert found == plain_groups(list(enumerate(rows)))


@pytest.mark.parametrize("least, own, shift", [(85, 84, 6), (80, 79, 8)])
def test_near_groups_inside_a_centre(make, least, own, shift):
    """Two linked excerpts of longer, much copied texts: neither is linked with those, and all they share lies inside them."""
    word = lambda k: f"w{k}"
    core = [word(k) for k in range(own + shift + 4)]
    rows = [" ".join(core[: own + 4]), " ".join(core[shift:])]
    for family in range(8):
        tail = [word(1000 * (family + 1) + k) for k in range(100 - own - shift + 3)]
        rows += [" ".join(core + tail[: len(tail) - less]) for less in range(4)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(make(rows), least).collect()}
    want = plain_groups(list(enumerate(rows)), least)
    assert want[1][1] == 0 and sum(w[1] == 0 for w in want.values()) == 2
    assert found == want


def test_near_groups_odd_ids(make):
    t = "one two three four five six seven"
    rows = near_dedup.near_groups(make([(3, t), (3, t), (None, t), (1, t), (7, "other")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None) == [(1, 1), (3, 1), (3, 1), (7, 7)]
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    kept = near_dedup.dedup_near(make([(3, t), (None, t), (1, t), (7, "other")]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "7", "None"] and kept.columns == make([]).columns
    assert near_dedup.near_groups(make([])).count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_a_filter_drops_no_wanted_row(spark, monkeypatch, bits):
    """Keys of both signs; a filter with one word of bits passes more, never less."""
    monkeypatch.setattr(near_dedup, "FILTER", bits)
    rows = spark.range(-500, 500).selectExpr("id as node")
    for wanted in ([], [-500, -1, 0, 7, 499], list(range(-500, 500))):
        few = spark.createDataFrame([(x,) for x in wanted], "node long")
        got = {r.node for r in near_dedup.thinned(rows, "node", few).collect()}
        assert got >= set(wanted)
        if bits > 64:
            assert got == set(wanted)


def test_signature_is_unbiased():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = near_dedup.signature(x[:300], 500), near_dedup.signature(x[100:], 500)
    assert (a == b).mean() == pytest.approx(0.5, abs=0.06)


# --- exact copies


def test_copy_groups(make, prose):
    rows = [(i, t) for i, t in enumerate(prose * 2)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = {i: (max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}
    assert {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.copy_groups(make(rows)).collect()} == want
    kept = exact_dedup.dedup_exact(make(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values()) and kept.columns == make([]).columns


def test_copies_with_odd_ids(make):
    docs = make([(None, "a"), (2, "a"), (2, "a"), (None, "b"), (None, "b")])
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.dedup_exact(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text").collect()) == [(-1, "b"), (2, "a")]
    assert exact_dedup.copy_groups(docs).where("kept").count() == 4
    assert exact_dedup.copy_groups(make([])).count() == 0 and exact_dedup.dedup_exact(make([])).count() == 0


def test_cuckoo_index():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    index = exact_dedup.CuckooIndex(4)
    for i, k in enumerate(keys):
        assert index.find(k) is None
        index.add(k, [i])
    assert index.resizes and all(index.find(k) == [i] for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert all((index.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))


def test_deleted_digests_have_no_group(make):
    marked = exact_dedup.digests(make(["a", "b", "a"]))
    groups = exact_dedup.live_groups(marked, marked.where("doc_id = 1")).collect()
    assert [(r["text_sha256"], r["keep_id"], r["group_size"]) for r in groups] == [(sha("a"), 2, 2)]


# --- repeated byte strings


def plain_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, sha(np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("largest", [8192, 1])
def test_repeats(make, prose, largest):
    rows = list(enumerate([*prose, "z" * 350, "xy" * 200 + "z" * 120, "漢" * 90, prose[0][:100], prose[0][1:100]]))
    assert {r["doc_id"]: tuple(r)[1:] for r in repeats.repeated(make(rows), largest=largest).collect()} == plain_repeats(rows)


def test_repeats_told_within_and_between_blocks(make, prose, monkeypatch):
    """A block of one document, of some, and of all: what the blocks tell beforehand changes nothing."""
    rows = [(i * 7 % 61, t) for i, t in enumerate(([*prose, "z" * 350] * 4)[:61])]
    want = plain_repeats(rows)
    for chunk in (1, 40, 1 << 20):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        assert {r["doc_id"]: tuple(r)[1:] for r in repeats.repeated(make(rows)).collect()} == want


def test_repeats_on_the_test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r["doc_id"]: tuple(r)[1:] for r in repeats.repeated(docs).collect()} == plain_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_repeats_with_odd_ids(make):
    t = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    rows = repeats.repeated(make([(None, t), (5, t), (5, t), (4, None)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in rows) == [("4", 0), ("5", len(t)), ("5", len(t)), ("None", 0)]
    rows = repeats.repeated(make([(5, t), (5, t)])).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, len(t)]
    assert repeats.repeated(make([])).count() == 0


# --- packing


def pack_checked(df, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    rows = df.collect()
    at, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= 1024 and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        at[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in enumerate(ids):
        parts = sorted(at[i])
        assert [p[0] for p in parts] == list(range(-(-len(x) // 1024))) and sum(p[2] for p in parts) == len(x)
        assert all(a[1] + a[2] == b[1] for a, b in zip(parts, parts[1:], strict=False)) and all(p[2] == 1024 for p in parts[1:])
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and b[-1][0] + b[-1][1] <= 1024
    return len(bins), -(-sum(map(len, ids)) // 1024)


def test_packing(spark, sf, make, prose):
    texts = [*prose, " " * 5000 + "x", "spam " * 3000, "don't 'll 12,5\n\n\n  ok　\u0085 z"]
    pack_checked(packing.pack_documents(make(texts), BPE), texts)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    used, least = pack_checked(packing.pack_documents(docs, BPE), texts)
    assert used <= least * 1.02 + 1
    assert packing.pack_documents(make([]), BPE).count() == 0
    odd = packing.pack_documents(make([(None, "a b"), (1, "c"), (1, "c")]), BPE).collect()
    assert sorted(str(r["doc_id"]) for r in odd) == ["1", "1", "None"] and len({(r["sequence_id"], r["offset"]) for r in odd}) == 3


def test_patterns_keep_every_capacity():
    counts = {700: 5, 400: 9, 320: 11, 90: 40, 5: 300}
    for by in ("dot", "norm"):
        found = packing.patterns(counts, 1024, 12, 600_000, by=by)
        used = Counter()
        for content, n in found:
            assert sum(content) <= 1024 and len(content) <= 12 and sum(x * x for x in content) <= 600_000
            for x in content:
                used[x] += n
        assert used == counts
    with pytest.raises(ValueError):
        packing.patterns({2000: 1}, 1024, 12, 10**9)


# --- sentence pieces


def test_pieces(spark, sf, make, prose):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=SPM)
    texts = [*prose, *[r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]]
    for r in sentencepieces.encode_digests(make(texts), SPM).collect():
        ids = [*lib.encode(texts[r["doc_id"]] or ""), lib.eos_id()]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))
    assert sentencepieces.encode_digests(make([]), SPM).count() == 0
    assert sorted(str(r["doc_id"]) for r in sentencepieces.encode_digests(make([(None, "a"), (1, "b"), (1, "b")]), SPM).collect()) == ["1", "1", "None"]


def test_spans_cover_the_source(make):
    text = "Ａ ﬁne  ① day é 漢"
    (r,) = sentencepieces.encode(make([text]), SPM).collect()
    raw = text.encode()
    assert r["starts"][0] == 0 and max(r["ends"]) == len(raw)
    assert all(a <= b for a, b in zip(r["starts"], r["ends"], strict=True)) and r["starts"] == sorted(r["starts"])
    (d,) = sentencepieces.decode(sentencepieces.encode(make(["plain words"]), SPM), SPM).collect()
    assert d["text"] == "plain words"


@pytest.mark.parametrize("dummy", [True, False])
def test_normaliser_without_a_map(dummy):
    n = sentencepieces.Normaliser(b"", dummy)
    out, source = n(b"  a  b ")
    mark = sentencepieces.SPACE
    assert out == (mark if dummy else b"") + b"a" + mark + b"b" and len(source) == len(out) + 1
    assert source[-1] == 6 and source[out.index(b"b")] == 5


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def plain_spans(text):
    n = lambda s: sum(c.isdigit() for c in s)
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 12 <= n(s) <= 19 and luhn(s), "phone": lambda s: 9 <= n(s) <= 15}
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok[k](m.group())] for k, p in PLAIN.items()}


PERSONAL = [
    "mail a.b@c.de, x@y.z_w@q.r a@b@c.d @e.f 漢字 g@h.i", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 10.0.0.1.", "4111 1111 1111 1111 and 4111-1111-1111-1111 5500005555555559", "4111 1111 1111 1112 4111  1111 1111 1111 79927398713",
    "+1 (555) 123-4567 +49.30.1234567 +1 555 123-4567 +12", "call +44 20 7946 0958 or +1 555 123 4567 card 378282246310005", "user (at) host (dot) com 555-123-4567 10[.]0[.]0[.]7", "a@b" + ".c" * 20_000 + " +" + "1 " * 20_000, "9" * 3_000, "a" * 3_000 + "@x", "x@y.z " * 3000,
]


def test_personal_data(spark, sf, make, prose):
    texts = [*prose, *PERSONAL, *[r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]]
    rows = pii.personal_data(make(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PLAIN] == [len(want[k]) for k in PLAIN]
        order = sorted((s, list(PLAIN).index(k), e) for k in PLAIN for s, e in want[k])
        base = [f"{list(PLAIN)[o]}:{s}:{e}" for s, o, e in order]
        assert r["base_sha256"] == sha(",".join(base)) and set(base) <= set(r["spans"].split(",")) | {""}


def test_redacted(make):
    docs = make(["to a@b.de now", None, "", "1.2.3.4", "none"])
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "to [EMAIL] now", 1: None, 2: "", 3: "[IP]", 4: "none"}
    assert pii.redacted(make([])).count() == 0 and pii.personal_data(make([])).count() == 0


def test_labelers_are_told_apart():
    """Votes that agree with two others weigh more than a labeler that votes at random."""
    counts = [((1, 1, 1, 1), 40), ((1, 1, 1, -1), 40), ((-1, -1, -1, 1), 40), ((-1, -1, -1, -1), 40)]
    _, rates, post = pii.reliabilities(counts)
    assert post[(1, 1, 1, -1)] > 0.9 > 0.1 > post[(-1, -1, -1, 1)] and rates[0][0] > rates[3][0]
    w = pii.span_classifier(counts, post)
    assert w[1] > w[4]


# --- top k


def plain_top(rows, k):
    v = {i: np.floor(256 * np.array(x, float)).astype(np.int64) for i, x in rows if x and all(c is not None and np.isfinite(c) for c in x)}
    out = []
    for q in v:
        if q % 50 == 0:
            best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k(spark, sf):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(230)]
    rows += [(300 + i, rows[3][1]) for i in range(40)] + [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8)]
    for data in (rows, rows[:3], rows[1:2], []):
        v = spark.createDataFrame(data, "id long, e array<double>").select("id", topk.whole_numbers("e").alias("vector"))
        assert sorted(map(tuple, topk.top_k(v, v.where("id % 50 = 0"), 5).collect())) == plain_top(data, 5)


# --- language-model scores


def plain_scores(rows, order):
    docs = {i: [w for w in re.split(r"\s+", (t or "").lower(), flags=re.A) if w] for i, t in rows}
    grams = {i: Counter(tuple(d[a : a + k]) for k in range(1, order + 1) for a in range(len(d) - k + 1)) for i, d in docs.items()}
    every, total = sum(grams.values(), Counter()), sum(map(len, docs.values()))

    def scored(gram, own):
        here = every[gram] - own[gram]
        if len(gram) == 1:
            return max(here, 1) / total
        return here / (every[gram[:-1]] - own[gram[:-1]]) if here else 0.4 * scored(gram[1:], own)

    return {i: (len(d), np.mean([np.log(scored(tuple(d[max(k - order + 1, 0) : k + 1]), grams[i])) for k in range(len(d))]) if d else None) for i, d in docs.items()}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(make, prose, order):
    rows = [*prose, "one", "one two", "long " * 30_000 + "end"]
    found = {r["doc_id"]: (r["n_words"], r["score"]) for r in lm_scoring.scores(make(rows), order).collect()}
    want = plain_scores(list(enumerate(rows)), order)
    assert found.keys() == want.keys()
    for i, (n, s) in want.items():
        assert found[i] == (n, pytest.approx(s, rel=1e-9)) if s is not None else found[i] == (n, None)
    odd = lm_scoring.scores(make([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)]), order).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in odd) == [("1", 2), ("1", 2), ("2", 0), ("None", 2)]
    assert lm_scoring.scores(make([]), order).count() == 0
