"""Passages of a benchmark within training texts: found by windows of words, told per document, cut out or dropped.

Texts and items are lower-cased (A-Z only) and read as words. Every run of `SIZE` consecutive item words is a window; an
item of fewer words is one window. Hashes of all windows, with the words themselves, are broadcast; every window of the
documents is looked up by its hash where the document is read, and a hit is verified on its words in the same step, so no
text is shuffled. Only hits are grouped by document. A broadcast never holds more than `BROADCAST_BYTES` of windows: a
larger benchmark is cut by hash into as many blocks as that takes, and the documents are scanned once a block.

A window's hash comes from its halves' hashes, so that all windows of a text take a few passes over the array of its
words' hashes. All of it is DataFrame functions.

Defined results: a null or empty text has no words; an item without words has no window; rows of the benchmark without an
id mark words, but are not named; an item id given twice counts once; documents repeated with the same id and text get a
row each, with the same values; documents without an id are judged like others; empty tables give no rows, or rows
without hits; columns other than doc_id and text, or item_id and text, are not read. A text must fit into memory with its
words; a group never holds more than one document's hits. A benchmark window shared by many items costs one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrelake.llm.common import free_name, written

#: Words in a window.
SIZE = 10
#: What stands between words, before lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of windows sent to every executor at once.
BROADCAST_BYTES = 32 << 20
#: Into how many parts the documents of one set of items are dealt.
SALTS = 16


def lowered(text: Column) -> Column:
    """A-Z in lower case; the whole of an ASCII text at once."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text as they stand in it."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(lowered(w)))


def _paired(a: Column, b: Column, ahead: int) -> Column:
    """Hashes of a[i] and b[i + ahead], for all i that have both."""
    n = F.greatest(F.least(F.size(a), F.size(b) - ahead), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, ahead + 1, n), lambda x, y: F.xxhash64(x, y))


def _with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (with `words`) and, for each length l, h{l}: the hashes of its windows of l words. A step a column, so that each is told once."""
    df = df.withColumn("h1", _hashed(F.col("words")))
    have = {1}

    def add(df: DataFrame, n: int) -> DataFrame:
        if n in have:
            return df
        low = 1 << (n.bit_length() - 1)
        first, second = (low, n - low) if n > low else (low // 2, low // 2)
        df = add(add(df, first), second)
        have.add(n)
        return df.withColumn(f"h{n}", _paired(F.col(f"h{first}"), F.col(f"h{second}"), first))

    for n in lengths:
        df = add(df, n)
    return df


def windows(items: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame, list[int]]:
    """The benchmark's different windows (hash, len, gram, set_id), the sets of items (set_id, item_ids), the windows' lengths."""
    read = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).withColumn("len", F.least(F.size("words"), F.lit(size)))
    read = read.where("len > 0")
    lengths = sorted(r[0] for r in read.select("len").distinct().collect())
    parts = []
    for n in lengths:
        hashed = _with_hashes(read.where(F.col("len") == n), [n])
        each = hashed.select("item_id", "len", "words", F.posexplode(f"h{n}").alias("p", "hash"))
        parts.append(each.select("item_id", "len", "hash", lowered(F.array_join(F.slice("words", F.col("p") + 1, n), " ")).alias("gram")))
    if not parts:
        empty = items.sparkSession.createDataFrame([], "hash long, len int, gram string, set_id string"), items.sparkSession.createDataFrame([], "set_id string, item_ids array<string>")
        return *empty, []
    told = reduce(DataFrame.unionByName, parts).groupBy("hash", "len", "gram").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    told = written(told.withColumn("set_id", F.sha2(F.to_json("item_ids"), 256)))
    return told.select("hash", "len", "gram", "set_id"), told.groupBy("set_id").agg(F.min("item_ids").alias("item_ids")), lengths


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's hash: rows that agree in id and hash have the same result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))


def hits(docs: DataFrame, told: DataFrame, lengths: list[int], most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text_hash, start, end (words, end exclusive), set_id: every occurrence of a window in every text."""
    size = told.agg(F.sum(F.octet_length("gram") + 128)).first()[0] or 0
    blocks = -(-size // most_bytes) or 1
    read = _keyed(docs).withColumn("words", words_of(F.col("text"))).drop("text")
    read = _with_hashes(read, lengths)
    each = read.select("doc_id", "text_hash", "words", F.posexplode(F.concat(*(F.col(f"h{n}") for n in lengths))).alias("p", "hash"))
    # windows of the shorter lengths stand first
    before, passed = F.lit(0), []
    for n in lengths:
        passed.append((n, before))
        before = before + F.greatest(F.size("words") - n + 1, F.lit(0))
    start = F.col("p") - reduce(lambda c, x: c.when(F.col("len") == x[0], x[1]), passed, F).otherwise(F.lit(0))
    found = []
    for k in range(blocks):
        block = told if blocks == 1 else told.where(F.pmod("hash", F.lit(blocks)) == k)
        met = each.join(F.broadcast(block), "hash").withColumn("start", start)
        same = F.translate(F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " "), UPPER, LOWER) == F.col("gram")
        found.append(met.where((F.col("start") >= 0) & same).select("doc_id", "text_hash", "start", (F.col("start") + F.col("len")).alias("end"), "set_id"))
    return reduce(DataFrame.unionByName, found)


def _runs(positions: str) -> Column:
    """Maximal runs of a sorted array of different numbers, as (start, end)."""
    p = F.col(positions)
    starts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
    ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text_hash, spans (of hit words: start, end), item_ids (sorted): a row for each different document that has hits."""
    told, sets, lengths = windows(items, size)
    if not lengths:
        return docs.sparkSession.createDataFrame([], "text_hash long, spans array<struct<start:int,end:int>>, item_ids array<string>").select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "*")
    key = ["doc_id", "text_hash"]
    grouped = hits(docs, told, lengths, most_bytes).groupBy(*key).agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.collect_set("set_id").alias("set_ids"))
    grouped = grouped.withColumn("at", F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))))
    grouped = written(grouped.withColumn("spans", _runs("at")).drop("at"))
    # a set's documents may be a third of all: they are dealt over parts, each of which has the set
    salted = sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = grouped.select(*key, F.explode("set_ids").alias("set_id")).withColumn("salt", F.pmod(F.col("text_hash"), F.lit(SALTS)).cast("int")).join(salted, ["set_id", "salt"])
    named = named.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    named = named.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "item_ids")
    return grouped.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).select(*key, "spans", "item_ids")


def judged(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, items, size).select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("hit"), "item_ids"
    )
    counted = _keyed(docs).select("doc_id", "text_hash", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    both = counted.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    return both.select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("item_ids", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, drop_documents: bool = False, size: int = SIZE) -> DataFrame:
    """`docs` without hit words (with what stands before each), or without the documents that have any; all columns stay."""
    found = contamination(docs, items, size).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.col("spans").alias("_spans"))
    taken = [free_name(docs, x) for x in ("d", "t", "spans")]
    found = found.toDF(*taken)
    d, t, spans = (F.col(x) for x in taken)
    here = F.col("doc_id").eqNullSafe(d) & (F.xxhash64(F.coalesce("text", F.lit(""))) == t)
    if drop_documents:
        return docs.join(found, here, "left_anti")
    pieces = F.regexp_extract_all("text", F.lit(f"(?:{BETWEEN})?{WORD}"), F.lit(0))
    tail = F.regexp_extract("text", f"{BETWEEN}$", 0)
    kept = F.filter(pieces, lambda _, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])))
    text = F.when(spans.isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))
    return docs.join(found, here, "left").withColumn("text", text).select(*docs.columns)
