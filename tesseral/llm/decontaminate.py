"""Benchmark decontamination, with DataFrame functions only.

The benchmark's word windows are normalised into a set of hashes. While the set has at most ``max_literals``
entries and ``MAX_BYTES`` of text and ids, both counted, it goes to every task as a hash set inside the plan; beyond
that, the training windows are exploded and joined with it, so nothing grows with the benchmark on one machine. A
window is hashed only where its first two words open one of the set, and one whose hash is in the set is then
verified by its words.

Defined results: null texts have no words; an item with fewer words than a window is one shorter window; an
item without words is never found; null item ids are listed as empty strings; rows that repeat a document, or a
doc_id, are judged one by one; empty tables give no rows, or no hits; other columns of the input take no part in
``find`` and stay as they are in ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_names, quoted, text_of

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_LITERALS = 200_000
MAX_BYTES = 128 << 20


def words_of(df: DataFrame, text: str) -> Column:
    return F.regexp_extract_all(ascii_lower(text_of(df, text)), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(gram, gram_items): each distinct window of the benchmark with the ids of its items."""
    words = benchmark.select(F.coalesce(quoted(item_id).cast("string"), F.lit("")).alias("item"), words_of(benchmark, text).alias("w")).where("size(w) > 0")
    grams = words.select("item", F.explode(F.expr(f"IF(size(w) < {window}, array(w), transform(sequence(1, greatest(1, size(w) - {window - 1})), i -> slice(w, i, {window})))")).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set("item").alias("gram_items"))


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_literals: int = MAX_LITERALS) -> DataFrame:
    """One row for each row of ``docs``: the columns ``keep``, ``n_words``, ``hits`` (disjoint word ranges, start
    inclusive from 0, end exclusive, in order) and ``items`` (ids of the items found, sorted as strings)."""
    grams = windows(benchmark, item_id, item_text, window)
    word_hashes = F.transform("gram", lambda w: F.xxhash64(w))
    hashes = grams.select(F.size("gram").alias("l"), F.xxhash64(word_hashes).alias("h"), F.when(F.size("gram") > 1, F.xxhash64(word_hashes[0], word_hashes[1])).alias("opening"))
    weight = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 16)
    extent = grams.agg(F.count("*").alias("n"), F.sum(weight("gram") + weight("gram_items")).alias("bytes"), F.array_sort(F.collect_set(F.size("gram"))).alias("lengths")).first()
    lengths = extent.lengths  # at most ``window`` numbers
    few = extent.n <= max_literals and (extent.bytes or 0) <= MAX_BYTES

    base = docs.select(F.monotonically_increasing_id().alias("__row"), *[quoted(c).alias(f"__k{i}") for i, c in enumerate(keep)], words_of(docs, text).alias("__w"))
    base = base.withColumn("__h", F.expr("transform(__w, w -> xxhash64(w))")).withColumn("__n", F.size("__w"))
    places = []
    for n in lengths:
        found = f"sequence(0, __n - {n})"
        if few:
            mine = hashes.where(F.col("l") == n).select("h", "opening").collect()  # at most ``max_literals`` rows
            known, opening = (", ".join(f"{x}L" for x in sorted(xs)) for xs in ({r.h for r in mine}, {r.opening for r in mine} - {None}))
            opens = f"xxhash64(__h[i], __h[i + 1]) IN ({opening}) AND " if n > 1 else ""
            found = f"filter({found}, i -> {opens}xxhash64(slice(__h, i + 1, {n})) IN ({known}))"
        places.append(f"IF(__n < {n}, CAST(array() AS array<struct<at:int,gram:array<string>>>), transform({found}, i -> named_struct('at', i, 'gram', slice(__w, i + 1, {n}))))")
    head = ["__row", *[f"__k{i}" for i in range(len(keep))], "__n"]
    if places:
        rows = base.select(*head, F.explode_outer(F.expr(f"concat({', '.join(places)})")).alias("c"))
        rows = rows.select(*head, F.col("c.at").alias("at"), F.col("c.gram").alias("gram"))
        met = rows.join(F.broadcast(grams) if few else grams, "gram", "left")
    else:
        met = base.select(*head, F.lit(0).alias("at"), F.expr("CAST(NULL AS array<string>)").alias("gram"), F.expr("CAST(NULL AS array<string>)").alias("gram_items"))
    hit = F.when(F.col("gram_items").isNotNull(), F.struct("at", (F.col("at") + F.size("gram")).alias("end")))
    grouped = met.groupBy("__row").agg(*[F.first(c).alias(c) for c in head[1:]], F.array_sort(F.collect_set(hit)).alias("__hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("gram_items")))).alias("items"))
    merged = """aggregate(__hits, CAST(array() AS array<struct<at:int,end:int>>), (a, x) ->
        IF(size(a) > 0 AND x.at <= a[size(a) - 1].end,
           concat(slice(a, 1, size(a) - 1), array(named_struct('at', a[size(a) - 1].at, 'end', greatest(a[size(a) - 1].end, x.end)))),
           concat(a, array(x))))"""
    return grouped.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("__n").cast("long").alias("n_words"), F.expr(merged).alias("hits"), "items")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark window; whole documents go, not only the spans."""
    keyed = F.sha2(text_of(docs, text), 256)
    named = docs.select(quoted(doc_id).alias("__id"), text_of(docs, text).alias("__text"), keyed.alias("__key"))
    bad = find(named, benchmark, ["__id", "__key"], "__text", **options).where(F.size("hits") > 0).select(F.col("__id"), F.col("__key")).distinct()
    key, bad_key, bad_id = free_names(docs, "text_key", "bad_key", "bad_id")
    rows, bad = docs.withColumn(key, keyed), bad.select(F.col("__key").alias(bad_key), F.col("__id").alias(bad_id))
    return rows.join(bad, F.col(key).eqNullSafe(F.col(bad_key)) & quoted(doc_id).eqNullSafe(F.col(bad_id)), "left_anti").select(*[quoted(c) for c in docs.columns])
