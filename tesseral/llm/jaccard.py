"""Exact n-gram Jaccard join in the metric space of shingle sets, by Voronoi regions of pivots.

Distance is 1 - |A & B| / |A | B|; two documents link when it is at most ``eps``. The steps:

1. Documents with equal sets are one node, so copies cost nothing further.
2. The first pivots are single shingles, in one fixed order: common ones last, then by hash. A set's nearest
   pivots are its own shingles, all at the same distance, so its region is that of its first shingle; the
   triangle inequality tells how far a partner may lie (it lacks at most ``n - ceil((1 - eps) n)`` shingles of a
   set of n), and the set is replicated to just as many further regions. Linked sets always share a region.
   Whole documents can't be these pivots: nearly all of them are at distance 1 from any pivot document.
   Sets are replicated to ``SPARE`` percent more regions than that. Linked sets then share more than one, so each
   set can leave some of its most crowded ones: as many as both together never leave all that they share.
3. Inside a region a document is the pivot: its distance to all members is computed, members within ``eps``
   link to it. Regions whose members are now all connected are done. In the rest the pivot leaves, and members
   too close to it to reach any unlinked member (triangle inequality) leave.
4. What is left is joined with ``PIVOTS`` more documents of each region; members of large regions then with their
   likeliest partners, in rounds until these join little; and then pair by pair across components, all within the
   windows ``|d(x, p) - d(y, p)| <= eps``. Nothing is left out, so components are exact.

Order, regions and windows only steer the work: every link is verified on whole sets, and no pair that could
join two components is skipped. Which shingles are common is counted over all documents, in a table of counters by
the shingles' low bits of ``2**BITS`` places, against the mean count; shingles that share a counter merely move back
together. Shingles and sets are named by 64-bit hashes.

Defined results: null and wordless texts have no shingles and link with nothing; rows that share a doc_id and
a text are one document; a null doc_id gets the smallest id of its component, null if there is none.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytewise import FOLDED, bytes_of, hashes, mixed, words_of
from .common import quoted, ship, slices, stored, text_of

COUNT_WINDOW = 1 << 20
COMMON = (12, 200, 4000)
BITS, SLICE_BITS = 23, 15
BLOOM_BITS = 25
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    def __init__(self, size: int):
        self.size = size

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Of each text the sorted distinct hashes of its shingles."""
        data, offsets = bytes_of(texts)
        word, end, first = words_of(data, offsets)
        if not len(word):
            return [np.zeros(0, np.uint64) for _ in range(len(texts))]
        h = hashes(data, word, end, FOLDED)
        lengths, starts = np.diff(first), first[:-1]
        out = np.full(len(h), self.size, dtype=np.uint64)
        for i in range(self.size):
            out[: len(h) - i] = out[: len(h) - i] * _PRIME + h[i:]
        out = mixed(out)
        found = []
        for start, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            if n >= self.size:
                part = out[start : start + n - self.size + 1]
                part.sort()
                keep = np.ones(len(part), dtype=bool)
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                found.append(part[keep])
            elif n:  # the whole sequence is the one shingle
                one = np.full(1, n, dtype=np.uint64)
                for i in range(n):
                    one = one * _PRIME + h[start + i]
                found.append(mixed(one))
            else:
                found.append(np.zeros(0, np.uint64))
        return found


def packed(values: np.ndarray) -> bytes:
    return values.dtype.char.encode() + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    return np.frombuffer(pa.decompress(data[1:], kind.itemsize << SLICE_BITS, "zstd", asbytes=True), kind)


def set_name(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


#: By how much of a set its prefix is longer than it must be, as a percentage.
SPARE = 8
#: Regions of more members than this may be left out.
CROWDED = 4
#: Regions of more members than this are solved in blocks of ``BLOCK`` members, smaller ones by a join.
LARGE = 16
#: So many pairs a member of a large region gives in a round that only looks for its likeliest links.
BEST = 4
PIVOTS = 8
BLOCK = 1024


def prefix_length(n: int, percent: int) -> int:
    """So many first places that linked sets have ``1 + spare`` of them in common, spare being the smaller one's."""
    return min(n, n - (percent * n + 99) // 100 + 1 + SPARE * n // 100)


def common_shingles(texts: DataFrame, size: int, bits: int = BITS) -> np.ndarray:
    """For each value of a shingle's low bits, how many of the bounds in ``COMMON``, above the mean, its count reaches."""

    def count(batches):
        make, held, waiting = Shingler(size), [], 0
        counters = np.zeros(1 << bits, np.uint32)

        def settle():
            at, n = np.unique(np.concatenate(held) & np.uint64((1 << bits) - 1), return_counts=True)
            counters[at] += n.astype(np.uint32)

        for batch in slices(batches):
            found = make(batch.column(0))
            held += found
            waiting += sum(map(len, found))
            if waiting >= COUNT_WINDOW:
                settle()
                held, waiting = [], 0
        if held:
            settle()
        for i, part in enumerate(counters.reshape(-1, 1 << SLICE_BITS)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "counts": pa.array([packed(part.astype(np.min_scalar_type(part.max())))], pa.binary())})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = total.setdefault(i, np.zeros(1 << SLICE_BITS, np.int64))
                part += unpacked(data)
        for i, part in total.items():  # which shingles are in which slice is chance, so each has the mean of all
            level = sum((part >= bound + part.mean()).astype(np.uint8) for bound in COMMON)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "levels": pa.array([packed(level)], pa.binary())})

    rows = texts.select("text").mapInArrow(count, "slice int, counts binary").repartitionById(min(64, 1 << bits - SLICE_BITS), "slice").mapInArrow(add, "slice int, levels binary").collect()
    levels = np.zeros(1 << bits, np.uint8)  # whatever the input
    for r in rows:
        levels[r.slice << SLICE_BITS : (r.slice + 1) << SLICE_BITS] = unpacked(bytes(r.levels))
    return levels


def profiles(texts: DataFrame, size: int, percent: int, levels) -> DataFrame:
    """(doc_id, node, n, prefix) of each document; ``prefix`` has the regions that its set is replicated to.

    A region is numbered by its shingle's place in the fixed order: how common it is, then its hash."""

    def run(batches):
        mask = np.uint64(len(levels.value) - 1)
        make, level_of = Shingler(size), levels.value
        for batch in slices(batches):
            nodes, sizes, prefixes = [], [], []
            keys = [batch.column(2)] if batch.num_columns > 2 else []
            for s in make(batch.column(1)):
                sizes.append(len(s))
                nodes.append(set_name(s) if len(s) else None)
                order = (level_of[s & mask].astype(np.uint64) << np.uint64(61)) | (s >> np.uint64(3))
                order.sort()
                prefixes.append(order[: prefix_length(len(s), percent)].view(np.int64) if len(s) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))), *keys],
                names=["doc_id", "node", "n", "prefix", *["text_key" for _ in keys]],
            )

    return texts.mapInArrow(run, "doc_id long, node long, n long, prefix array<long>" + (", text_key string" if "text_key" in texts.columns else ""))


def _bloom_places(doc: np.ndarray) -> np.ndarray:
    """Three bits of a Bloom filter for each document id."""
    h = mixed(doc.astype(np.int64).view(np.uint64) * _PRIME)
    return np.stack([(h >> np.uint64(k)) & np.uint64((1 << BLOOM_BITS) - 1) for k in (0, 20, 39)]).astype(np.int64)


def sets_of(texts: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles) for the nodes in ``wanted`` (node, doc): their documents are read again.

    A Bloom filter of fixed size tells which; what it lets through beside goes in the join that follows."""
    spark = texts.sparkSession

    def fill(batches):
        filled = np.zeros(1 << BLOOM_BITS, dtype=bool)
        for batch in batches:
            filled[_bloom_places(np.asarray(batch.column(0).fill_null(0))).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(filled))], names=["at"])

    at = wanted.select("doc").mapInArrow(fill, "at long")
    rows = at.groupBy(F.shiftright("at", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("map")).collect()
    bloom = np.zeros((1 << BLOOM_BITS) // 8, dtype=np.uint8)  # at most 2**BLOOM_BITS bits, whatever the input
    for r in rows:
        bloom[r.bucket << 12 : (r.bucket + 1) << 12] = np.frombuffer(bytes(r.map), np.uint8)
    shared = spark.sparkContext.broadcast(bloom.tobytes())

    def run(batches):
        make, filled = Shingler(size), np.frombuffer(shared.value, np.uint8)
        for batch in slices(batches, 1024):
            at = _bloom_places(np.asarray(batch.column(0).fill_null(0)))
            batch = batch.filter(pa.array((filled[at >> 3] >> (at & 7) & 1).all(axis=0)))
            found = [s for s in make(batch.column(1)) if len(s)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)))], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def hopeful(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b, most) of each pair: ``most`` bounds how many shingles both sets have.

    Up to the smaller of their last prefix places both sets are known whole; beyond it, all could be common."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"p_{x}")) for x in "ab")
    both = pairs.join(right, "b").join(left, "a").withColumn("last", F.least(F.array_max("p_a"), F.array_max("p_b")))
    rest = lambda x: F.col(f"n_{x}") - F.size(F.filter(f"p_{x}", lambda v: v <= F.col("last")))
    most = F.size(F.array_intersect("p_a", "p_b")) + F.least(rest("a"), rest("b"))
    return both.select("a", "b", "n_a", "n_b", most.cast("long").alias("most"))


class Verifier:
    """Distances on whole sets, which are read for the nodes of hopeful pairs only, once for each node."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, size: int, percent: int):
        self.texts, self.nodes, self.size, self.percent = texts, nodes, size, percent
        self.sets: DataFrame | None = None

    def bounded(self, pairs: DataFrame) -> DataFrame:
        return stored(hopeful(pairs, self.nodes, self.percent), "bounded")

    def exact(self, close: DataFrame) -> DataFrame:
        """(a, b, n_a, n_b, common) of each pair."""
        nodes = close.select(F.col("a").alias("node")).union(close.select(F.col("b").alias("node"))).distinct()
        if self.sets is not None:
            nodes = nodes.join(self.sets.select("node"), "node", "left_anti")
        wanted = stored(self.nodes.select("node", "doc").join(nodes, "node", "left_semi"), "wanted")
        if not wanted.isEmpty():
            more = stored(sets_of(self.texts, self.size, wanted), "sets")
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        if self.sets is None:
            return self.texts.sparkSession.createDataFrame([], "a long, b long, n_a int, n_b int, common long")
        left, right = (self.sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
        both = close.select("a", "b").join(right, "b").join(left, "a")
        return both.select("a", "b", F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b"), F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("common"))

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """(a, b, n_a, n_b, most, common) of each pair; ``common`` is null where ``most`` rules a link out."""
        bounded = self.bounded(pairs)
        common = self.exact(bounded.where(linked(self.percent, "most"))).select("a", "b", "common")
        return stored(bounded.join(common, ["a", "b"], "left"), "star")


def linked(percent: int, common: str = "common") -> str:
    return f"100 * {common} >= {percent} * (n_a + n_b - {common})"


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of the links: the smallest node that links reach."""
    both = stored(links.select("a", "b").union(links.select("b", "a")), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        # Each node hears of its neighbours' labels, and of its own label's label, in one aggregation.
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").select(F.col("a").alias("node"), "comp")
        jump = labels.alias("l").join(labels.select(F.col("node").alias("at"), F.col("comp").alias("next")), F.col("l.comp") == F.col("at")).select("node", F.col("next").alias("comp"))
        heard = near.union(jump).withColumn("was", F.lit(None).cast("long")).union(labels.select("node", "comp", F.col("comp").alias("was")))
        after = stored(heard.groupBy("node").agg(F.min("comp").alias("comp"), F.max("was").alias("was")), "labels")
        labels = after.select("node", "comp")
        if after.where("comp <> was").isEmpty():
            return labels


def _incidence(lists: pa.ListArray, chunk: int = 4096):
    """0/1 matrices, some columns at a time, of which values a list has; only values of two lists or more."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    rows = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    values, at, counts = np.unique(np.asarray(lists.flatten()), return_inverse=True, return_counts=True)
    order = np.cumsum(counts > 1) - 1
    keep = counts[at] > 1
    rows, at, values = rows[keep], order[at[keep]], values[counts > 1]
    for begin in range(0, len(values), chunk):
        part = (at >= begin) & (at < begin + chunk)
        matrix = np.zeros((len(lists), min(chunk, len(values) - begin)), dtype=np.float32)
        matrix[rows[part], at[part] - begin] = 1
        yield values[begin : begin + chunk], matrix


def solved(rows: DataFrame, nodes: DataFrame, percent: int, best: int | None = None, seed: int = 0) -> DataFrame:
    """(a, b): pairs of large regions that can link, by windows and by the bound on common shingles.

    A region's members are dealt to blocks, and every two blocks are solved as matrices in a task of their own. A
    pair that several regions share is given by the first of them. With ``best`` blocks are solved by themselves
    alone and each member gives only so many pairs, those of the highest bounds; ``seed`` deals the blocks anew."""
    eps = 1 - percent / 100 + 1e-9
    own = rows.groupBy("node").agg(F.sort_array(F.collect_list("s")).alias("regions"))
    blocks = F.ceil(F.col("k") / BLOCK)
    members = rows.join(own, "node").join(nodes.select("node", "prefix"), "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(seed)), blocks))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)) if best is None else F.col("block")).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "k")

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        region, i, j = (int(k.as_py()) for k in key)
        node, n, comp, low, high, block = (table[c].to_numpy() for c in ("node", "n", "comp", "low", "high", "block"))
        prefix = table["prefix"].combine_chunks()
        ends = np.asarray(prefix.offsets)
        flat = np.asarray(prefix.flatten())
        base = int(ends[0])
        parts = [flat[a - base : b - base] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        last = np.array([p[-1] for p in parts])
        most = np.zeros((len(node), len(node)), dtype=np.float32)
        for _, matrix in _incidence(prefix):
            most += matrix @ matrix.T
        rest = np.stack([size - np.searchsorted(p, last, side="right") for p, size in zip(parts, n, strict=True)]).astype(np.float32)
        most += np.minimum(rest, rest.T)
        both = n[:, None] + n[None, :]
        good = (100 * most >= percent * (both - most)) & (100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n))
        good &= (comp[:, None] != comp[None, :]) & (node[:, None] < node[None, :])
        good &= (low[:, None] <= high[None, :] + eps) & (low[None, :] <= high[:, None] + eps)
        if i != j:
            good &= block[:, None] != block[None, :]
        if best is not None and best < len(node):
            bound = np.where(good | good.T, most / (both - most), 0)
            top = np.argpartition(-bound, best - 1, axis=1)[:, :best]
            chosen = np.zeros_like(good)
            chosen[np.arange(len(node))[:, None], top] = True
            good &= chosen | chosen.T
        a, b = np.nonzero(good)
        first = np.ones(len(a), dtype=bool)
        for values, matrix in _incidence(table["regions"], 512):
            if values[0] < region:
                matrix = matrix[:, values < region].astype(bool)
                for at in range(0, len(a), 20_000):
                    part = slice(at, at + 20_000)
                    first[part] &= ~(matrix[a[part]] & matrix[b[part]]).any(axis=1)
        return pa.table({"a": node[a[first]], "b": node[b[first]]})

    return members.groupBy("s", "i", "j").applyInArrow(solve, "a long, b long")


def with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows with their node's component, itself if it has no links."""
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def placed_in_regions(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, keyed: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The texts, their profiles, the nodes, and (s, node, n): each node in its regions. Linked nodes share one.

    With ``keyed`` texts and profiles also have ``text_key``, the text's SHA-256."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    texts = docs.select(quoted(doc_id).cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    if keyed:
        texts = texts.withColumn("text_key", F.sha2("text", 256))
    order = spark.sparkContext.broadcast(common_shingles(texts, size))
    profile = stored(profiles(texts, size, percent, order), "profiles")
    nodes = stored(profile.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "nodes")
    posts = nodes.select("node", F.explode("prefix").alias("s"))
    regions = posts.groupBy("s").agg(F.count("*").alias("k")).where("k > 1")
    rows = posts.join(regions, "s").join(nodes.select("node", "n"), "node")
    # Partners are at least ``percent`` of each other's size, so both together leave at most the smaller one's spare.
    leave = F.floor(F.floor(F.col("n") * SPARE / 100) * percent / 200)
    place = F.row_number().over(W.partitionBy("node").orderBy(F.desc("k"), "s"))
    rows = stored(rows.withColumn("place", place).where((F.col("place") > leave) | (F.col("k") <= CROWDED)).select("s", "node", "n"), "regions")
    return texts, profile, nodes, rows


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, keyed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``; ``percent`` is the similarity.

    With ``keyed`` also ``text_key``, the text's SHA-256, and ``first``: whether the row is its component's document
    with the smallest doc_id, null last, and then the smallest key."""
    texts, profile, nodes, rows = placed_in_regions(docs, doc_id, text, size, percent, keyed)
    verify = Verifier(texts, nodes, size, percent)
    eps = 1 - percent / 100 + 1e-9
    near = f"100 * least(n, p_n) >= {percent} * greatest(n, p_n)"

    # First one pivot for each region; it is compared with all members.
    pivot = rows.groupBy("s").agg(F.min("node").alias("pivot"))
    sizes = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("p_n"))
    placed = stored(rows.join(pivot, "s").where("node <> pivot").join(sizes, "pivot"), "placed")
    star = verify(placed.where(near).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    links = star.where(linked(percent)).select("a", "b")
    comps = components(links)
    # What is known of each member's distance to its pivot: exact, or a bound from below by common shingles or sizes.
    known = star.select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.expr("1 - common / (n_a + n_b - common)").alias("d"), F.expr("1 - most / (n_a + n_b - most)").alias("far"))
    placed = placed.join(known, ["pivot", "node"], "left").withColumn("low", F.coalesce("d", "far", F.expr("1 - least(n, p_n) / greatest(n, p_n)"))).withColumn("high", F.coalesce("d", F.lit(1.0)))
    placed = stored(with_components(placed.select("s", "node", "n", "low", "high"), comps), "placed")
    out = F.min(F.when(F.expr(f"high > {eps}"), F.col("low"))).alias("out")
    open_ = placed.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), out).where("x <> y").select("s", "out")
    rows = stored(placed.join(open_, "s").where(f"out IS NULL OR high + {eps} >= out").drop("out"), "regions")

    columns = ("node", "n", "comp", "low", "high")
    left = lambda df: df.select("s", *[F.col(c).alias(f"a_{c}") for c in columns])
    right = lambda df: df.select("s", *[F.col(c).alias(f"b_{c}") for c in columns])
    window = f"a_comp <> b_comp AND 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n) AND a_low <= b_high + {eps} AND b_low <= a_high + {eps}"
    pair = [F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")]
    # Then several, for what is still apart; the same ones in regions with the same members, so that pairs repeat.
    chosen = rows.groupBy("s").agg(*[F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)])
    chosen = chosen.select("s", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("node"))
    met = left(rows.join(chosen, ["s", "node"])).join(right(rows), "s").where(window)
    new = stored(verify(met.select(*pair).distinct()).where(linked(percent)).select("a", "b"), "links")
    if not new.isEmpty():
        links = links.union(new)
        comps = components(links)
        rows = with_components(rows.drop("comp"), comps)
        open_ = rows.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("s")
        rows = stored(rows.join(open_, "s"), "regions")
    # Then, in large regions, each member's likeliest partners, again and again until a round joins little: members of
    # a group of near copies come into one component before all that can still link is looked at.
    for seed in itertools.count():
        large = rows.join(rows.groupBy("s").agg(F.count("*").alias("k")).where(F.col("k") > LARGE), "s")
        likely = stored(solved(large, nodes, percent, BEST, seed).distinct(), "likely")
        tried = likely.count()
        new = stored(verify.exact(likely).where(linked(percent)).select("a", "b"), "links") if tried else likely
        joined = new.count()
        if joined:
            links = links.union(new)
            comps = components(links)
            rows = with_components(rows.drop("comp"), comps)
            open_ = rows.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("s")
            rows = stored(rows.join(open_, "s"), "regions")
        if 10 * joined <= tried:
            break
    sized = rows.join(rows.groupBy("s").agg(F.count("*").alias("k")), "s")  # and last, all that can still link
    small = sized.where(F.col("k") <= LARGE)
    met = left(small).join(right(small), "s").where(f"a_node < b_node AND {window}").select(*pair).distinct()
    close = verify.bounded(met).where(linked(percent, "most")).select("a", "b")
    close = stored(close.union(solved(sized.where(F.col("k") > LARGE), nodes, percent)).distinct(), "close")
    rest = verify.exact(close).where(linked(percent)).select("a", "b")
    if not rest.isEmpty():
        comps = components(links.union(rest))
    named = nodes.select("node", "doc").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    document = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    if keyed:
        named = named.join(profile.where("n > 0").groupBy("node").agg(F.min(document).alias("head")), "node")
    smallest = named.groupBy("comp").agg(F.min("doc").alias("component_id"), *[F.min("head").alias("head") for _ in range(keyed)])
    labelled = named.drop("head").join(smallest, "comp").drop("comp", "doc")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    extra = ["text_key", (F.col("head").isNull() | (F.col("head") == document)).alias("first")] if keyed else []
    return profile.join(labelled, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component, *extra)


def link_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, n_links), one row for each row of ``docs``: with how many other documents it links.

    The whole join: every pair of nodes that share a region and can link is verified, within components too. Copies
    count by how many documents they are; rows that share a doc_id and a text are one."""
    texts, profile, nodes, rows = placed_in_regions(docs, doc_id, text, size, percent, True)
    verify = Verifier(texts, nodes, size, percent)
    sized = rows.join(rows.groupBy("s").agg(F.count("*").alias("k")), "s")
    small = sized.where(F.col("k") <= LARGE)
    side = lambda x: small.select("s", F.col("node").alias(x), F.col("n").alias(f"{x}_n"))
    met = side("a").join(side("b"), "s").where(f"a < b AND 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)").select("a", "b").distinct()
    close = verify.bounded(met).where(linked(percent, "most")).select("a", "b")
    # Each node is a component of its own here and nothing is known of distances, so no pair is passed over.
    large = sized.where(F.col("k") > LARGE).withColumn("comp", F.col("node")).withColumn("low", F.lit(0.0)).withColumn("high", F.lit(1.0))
    close = stored(close.union(solved(large, nodes, percent)).distinct(), "close")
    pairs = stored(verify.exact(close).where(linked(percent)).select("a", "b"), "pairs")
    copies = profile.where("n > 0").select("node", "doc_id", "text_key").distinct().groupBy("node").agg(F.count("*").alias("m"))
    both = pairs.union(pairs.select("b", "a")).toDF("node", "other")
    others = both.join(copies.select(F.col("node").alias("other"), "m"), "other").groupBy("node").agg(F.sum("m").alias("others"))
    counted = copies.join(others, "node", "left").select("node", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return profile.join(counted, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
