"""Personal data by weak supervision, in DataFrame functions alone.

Base spans come from four fixed patterns with their checks. Wider patterns propose further candidates; labelers vote on
every candidate (a strict pattern, a gazetteer, cue words before it, and its edges), +1, -1 or 0 for no opinion.
Expectation-maximisation over the counts of vote patterns (at most 3^4 a kind) estimates how reliable each labeler is and
how likely each pattern is a true span. A logistic span classifier is trained on these soft labels, from counts as well,
and accepts the further candidates that it finds likely and that touch no base span. Base spans always stay.

A text is read once: what the scan finds is written as a small table, from which votes are counted and results made.

Defined results: a null text equals an empty one and has no spans; offsets count code points, ends are exclusive; the
same text always gives the same base spans; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrelake.llm.common import free_name, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that none of them tries a run of characters twice. They find the same spans as the
#: plain forms: a run that cannot begin a match fails at its first character alone, and \G allows a match to follow
#: another one at once. `card` already asks for 12 to 19 digits in the whole run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before the pattern is tried.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9][\x20().0-9-]"}
#: Wider forms that propose candidates. Phones and cards that stand side by side fail as one base match.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?\[?\.\]?\x20?[0-9]{1,3}+){3}+(?![0-9.]*[0-9])",
    "card": r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
WIDE_HINT = {"email": r"[(\[]at[)\]]", "ip": r"[0-9]\]?\x20?\.\x20?[0-9]|[0-9]\[\.", "card": r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
STRICT = {
    "email": r"^\S+$",
    "ip": r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$",
    "card": r"^[0-9]{16}$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$",
}
#: Gazetteers: top-level domains, networks that are never a person's, card issuers' prefixes, emergency and service codes.
LISTED = {
    "email": r"(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at)$",
    "ip": r"^(?!0|127\.|255\.|22[4-9]\.|23[0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^(?!.*(?:\b000\b|\b900\b)).*$",
}
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|courriel|correo|kontakt)\W*$",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse)\W*$",
    "card": r"(?i)(?:card|visa|credit|payment|karte|carte|tarjeta)\W*$",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|telefon|appel|llam\w*)\W*$",
}
#: Characters before a candidate in which a cue may stand.
BEFORE = 24
LABELERS = ("strict", "listed", "cue", "edges")
SPAN = "array<struct<s:bigint,e:bigint,t:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        x = F.substr(digits, -i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 1, x).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def found(text: Column, pattern: str, hint: str) -> Column:
    """Spans (s, e, t) of all matches of a pattern, by the lengths of the parts between them.

    Prefix sums run in blocks of the square root of their number, so a text with very many matches stays affordable.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def placed(m: Column) -> Column:  # m: struct of t (matches) and p (lengths of the parts before them)
        each = F.zip_with(m.t, m.p, lambda t, p: F.length(t) + p)
        step = F.ceil(F.sqrt(F.size(m.t))).cast("int")
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(m.t) - 1) / step).cast("int")), lambda j: total(F.slice(each, j * step + 1, step)))

        def span(t: Column, i: Column) -> Column:
            block = F.floor(i / step).cast("int")
            end = total(F.slice(sums, 1, block)) + total(F.slice(each, block * step + 1, i % step + 1))
            return F.struct((end - F.length(t)).alias("s"), end.alias("e"), t.alias("t"))

        return F.transform(m.t, span)

    packed = F.struct(matches.alias("t"), F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.length).alias("p"))
    # a lambda binds the struct once, so that no pattern runs twice
    spans = F.flatten(F.transform(F.array(packed), lambda m: F.when(F.size(m.t) > 0, placed(m)).otherwise(F.array().cast(SPAN))))
    return F.when(text.rlike(hint), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind that pass their check."""
    octets = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
    passes = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x.t.rlike(octets),
        "card": lambda x: luhn(digits_of(x.t)),
        "phone": lambda x: F.length(digits_of(x.t)).between(9, 15),
    }
    return {k: F.filter(found(text, BASE[k], HINT[k]), passes[k]) for k in KINDS}


def voted(text: Column, kind: str) -> Column:
    """Candidates of the wide pattern with their votes."""

    def votes(x: Column) -> Column:
        before = F.substr(text, F.greatest(x.s - BEFORE, F.lit(0)) + 1, F.least(x.s, F.lit(BEFORE)))
        after = F.substr(text, x.e + 1, F.lit(1))
        strict = x.t.rlike(STRICT[kind])
        if kind == "card":
            strict = strict & luhn(digits_of(x.t))
        cue = F.when(before.rlike(CUES[kind]), 1).otherwise(0)
        edges = F.when(before.rlike(r"(?:^|[\s\"'(<:,;=])$") & ((after == "") | after.rlike(r"^[\s\"')>.,;:!?]")), 1).otherwise(-1)
        return F.struct(x.s.alias("s"), x.e.alias("e"), F.when(strict, 1).otherwise(-1).alias("strict"), F.when(x.t.rlike(LISTED[kind]), 1).otherwise(-1).alias("listed"), cue.alias("cue"), edges.alias("edges"))

    return F.transform(found(text, WIDE[kind], WIDE_HINT[kind]), votes)


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, b_<kind> (base spans) and c_<kind> (candidates with votes), written as a table."""
    text = F.coalesce("text", F.lit(""))
    base = base_spans(text)
    ends = [F.transform(base[k], lambda x: F.struct(x.s.alias("s"), x.e.alias("e"))).alias(f"b_{k}") for k in KINDS]
    return written(docs.select("doc_id", *ends, *[voted(text, k).alias(f"c_{k}") for k in KINDS]))


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over counts of vote patterns.

    Returns the share of true spans, each labeler's rates of a right vote among true and false spans, and each
    pattern's probability of being true. Starts from the share of +1 among its votes.
    """
    post = {v: (1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for v, _ in counts}
    share, rates = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in counts)
        share = (sum(n * post[v] for v, n in counts) + 1) / (total + 2)
        rates = []
        for j in range(len(LABELERS)):
            yes = sum(n * post[v] for v, n in counts if v[j] > 0), sum(n * post[v] for v, n in counts if v[j])
            no = sum(n * (1 - post[v]) for v, n in counts if v[j] < 0), sum(n * (1 - post[v]) for v, n in counts if v[j])
            # a labeler is better than chance: priors of 8 right in 10 votes
            rates.append(((yes[0] + 8) / (yes[1] + 10), (no[0] + 8) / (no[1] + 10)))
        for v, _ in counts:
            odds = math.log(share / (1 - share))
            for x, (a, b) in zip(v, rates, strict=True):
                odds += math.log(a / (1 - b)) if x > 0 else math.log((1 - a) / b) if x < 0 else 0.0
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return share, rates, post


def span_classifier(counts: list[tuple[tuple[int, ...], int]], post: dict[tuple[int, ...], float], rounds: int = 400) -> list[float]:
    """Weights (bias first) of a logistic model of the votes, fitted to soft labels by gradient steps over the counts."""
    w = [0.0] * (1 + len(LABELERS))
    total = sum(n for _, n in counts) or 1
    for _ in range(rounds):
        grad = [0.01 * x for x in w]
        for v, n in counts:
            x = (1, *v)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for j, xj in enumerate(x):
                grad[j] += n / total * (p - post[v]) * xj
        w = [a - 0.5 * g for a, g in zip(w, grad, strict=True)]
    return w


def fitted(scan: DataFrame) -> dict[str, list[float]]:
    """The span classifier's weights of each kind, from the votes on all candidates."""
    every = None
    for k in KINDS:
        rows = scan.select(F.lit(k).alias("kind"), F.explode(f"c_{k}").alias("c")).select("kind", *[f"c.{x}" for x in LABELERS])
        every = rows if every is None else every.unionByName(rows)
    rows = every.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect()  # at most 4 * 3^4 rows
    out = {}
    for k in KINDS:
        counts = sorted((tuple(r[x] for x in LABELERS), r["n"]) for r in rows if r["kind"] == k)
        if counts:
            out[k] = span_classifier(counts, reliabilities(counts)[2])
    return out


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x.s.alias("s"), F.lit(KINDS.index(kind)).alias("o"), x.e.alias("e")))


def _accepted(candidates: Column, weights: list[float], base: Column, least: float) -> Column:
    """The candidates that the classifier finds at least so likely and that touch no base span."""
    bias, *each = weights

    def good(c: Column) -> Column:
        odds = sum((F.lit(w) * c[x] for w, x in zip(each, LABELERS, strict=True)), F.lit(bias))
        return (odds >= math.log(least / (1 - least))) & ~F.exists(base, lambda b: (b.s < c.e) & (c.s < b.e))

    return F.filter(candidates, good)


def with_spans(scan: DataFrame, weights: dict[str, list[float]], names: dict[str, str] | None = None, least: float = 0.5) -> DataFrame:
    """`scan` with base and spans: arrays of (s, o, e) where o is the kind's place in KINDS, sorted by start, then kind.

    names: the columns that stand for base, spans, b_<kind> and c_<kind>, if not these.
    """
    name = lambda x: (names or {}).get(x, x)
    scan = scan.withColumn(name("base"), F.array_sort(F.concat(*[_tagged(F.col(name(f"b_{k}")), k) for k in KINDS])))
    base = F.col(name("base"))
    more = [_tagged(_accepted(F.col(name(f"c_{k}")), weights[k], base, least), k) for k in KINDS if k in weights]
    return scan.withColumn(name("spans"), F.array_sort(F.concat(base, *more)))


def written_out(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.o), x.s, x.e)), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts and digest of its base spans, and all spans."""
    scan = scanned(docs)
    both = with_spans(scan, fitted(scan))
    count = lambda k: F.size(f"b_{k}").cast("long").alias(f"n_{k}")
    return both.select("doc_id", *map(count, KINDS), F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with each run of overlapping spans in its text replaced by the first one's kind in brackets.

    The spans are found again in each row's own text, so repeated rows and null ids need no join. Null texts stay null.
    """
    text = F.coalesce("text", F.lit(""))
    base = base_spans(text)
    ends = [F.transform(base[k], lambda x: F.struct(x.s.alias("s"), x.e.alias("e"))) for k in KINDS]
    keys = [f"{x}_{k}" for x in "bc" for k in KINDS]
    names = {x: free_name(docs, f"pii_{x}") for x in ("base", "spans", *keys)}
    scan = written(docs.select("*", *[c.alias(names[x]) for x, c in zip(keys, [*ends, *[voted(text, k) for k in KINDS]], strict=True)]))
    weights = fitted(scan.select(*[F.col(names[x]).alias(x) for x in keys]))
    scan, spans = with_spans(scan, weights, names), names["spans"]

    def merged(done: Column, x: Column) -> Column:  # done: the runs so far, the last of them last
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last.s.alias("s"), last.o.alias("o"), F.greatest(last.e, x.e).alias("e"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).e > x.s), joined).otherwise(F.concat(done, F.array(x)))

    empty = F.array().cast("array<struct<s:bigint,o:int,e:bigint>>")
    runs = F.aggregate(spans, empty, merged)
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rebuilt(r: Column) -> Column:
        kept = F.transform(r, lambda x, i: F.concat(F.substr("text", F.when(i > 0, F.get(r, i - 1).e).otherwise(F.lit(0)) + 1, x.s - F.when(i > 0, F.get(r, i - 1).e).otherwise(F.lit(0))), F.get(kinds, x.o)))
        return F.concat(F.array_join(kept, ""), F.substr("text", F.element_at(r, -1).e + 1, F.length("text")))

    new = F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(runs), rebuilt), 1)).otherwise(F.col("text"))
    return scan.withColumn("text", new).select(*docs.columns)
