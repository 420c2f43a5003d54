"""Language-model scores by context-tree weighting over bytes, each taken as eight binary decisions.

The decisions of a byte form a binary tree (255 partial bytes). Each partial byte has a context tree over the
``depth`` bytes before it (``DEPTH`` by default; 7 at most, as a gram is one 64-bit key). A node that has seen n0
zeros and n1 ones estimates them by Krichevsky-Trofimov; its weighted probability is half that, plus half the
product of its children's, so all depths are mixed by how well they have done on the training texts. A text's code
is that of its bytes, A-Z lower-cased, then of one end mark; contexts before the start hold end marks.

Counts depend on the set of training texts only, not their order, so they are gathered in parallel. Documents are
dealt by a hash to chunks of about ``chunk_bytes``, one task each, which gives its distinct grams (context and byte)
and words with their training counts. Grams are dealt to tasks by a hash of the ``local`` last context bytes, about
``part_bytes`` of text to a task; a task solves all trees below depth ``local``. The top, at most 255 * 257 **
(local - 1) nodes, is solved on the driver. Each chunk gets back the probabilities of its own grams and words only, so
no task and no broadcast holds the whole model. Grams travel sorted and packed, a few thousand to a row.

Keys have the last context byte first, so that in sorted order the nodes of any depth and any partial byte are runs.

Defined results: null texts count as empty (an end mark alone); rows with a null doc_id are scored like others;
repeated rows are learned from as often as they occur; with no training texts every bit costs one bit; an empty table
gives no rows; other columns of the input take no part. Words and chunks go by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewise import FOLDED, LOWER, bytes_of, hashes, mixed, words_of
from .common import byte_slices, partitions, quoted, ship, stored, text_of, trimmed

DEPTH = 6
END = 0xFF  # occurs in no UTF-8 text
END_WORD = np.array([1], np.uint64)  # stands for the end in the counts of words
CHUNK_BYTES = 32 << 20
PART_BYTES = 8 << 20
LOCAL = 3  # depth of the context that names a partition
PIECE = 1 << 15  # grams whose trees are solved at once, unless one context alone has more
WINDOW = 1 << 19  # grams that are made at once
BATCH_BYTES = 1 << 19  # of texts that are taken at once
SORTED = 1 << 21  # keys that are sorted at once
TABLE = 1 << 16  # counts whose log-gamma is looked up


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series after eight steps up."""
    y, shift = x + 8.0, np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


_tables: list[np.ndarray] = []


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a string with these counts, which are whole numbers."""
    if not _tables:
        n = np.arange(TABLE, dtype=np.float64)
        _tables[:] = log_gamma(n + 0.5) - np.log(np.pi) / 2, log_gamma(n + 1.0)
    half, one = _tables
    both = zeros + ones
    if len(both) and both.max() >= TABLE:
        return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(both + 1.0) - np.log(np.pi)
    return half[zeros] + half[ones] - one[both]


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted probability, posterior weight of the node's own estimate)."""
    own = log_kt(n0, n1)
    if below is None:
        return own, np.ones(len(own))
    both = np.logaddexp(own, below) - np.log(2.0)
    return both, np.exp(own - np.log(2.0) - both)


def grams_of(data: np.ndarray, offsets: np.ndarray, depth: int):
    """Arrays of the grams that end at each byte of each text and at its end mark, in order, a window at a time."""
    pad, end = bytes([END]) * depth, bytes([END])
    text = LOWER[data].data
    padded = np.frombuffer(b"".join([x for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for x in (pad, text[a:b], end)]), np.uint8)
    real = np.ones(len(padded), dtype=bool)
    real[((offsets[:-1] + np.arange(len(offsets) - 1) * (depth + 1))[:, None] + np.arange(depth)).ravel()] = False
    for begin in range(0, len(padded), WINDOW):
        until = min(begin + WINDOW, len(padded))
        # Backwards, eight bytes from each place on are the byte and those before it.
        back = np.concatenate([padded[max(0, begin - 7) : until][::-1], np.zeros(7, np.uint8)])
        gram = np.ndarray((until - begin,), ">u8", back.data, strides=(1,)).astype(np.uint64)
        context = (gram << np.uint64(8)) >> np.uint64(64 - 8 * depth)
        yield ((context << np.uint64(8)) | (gram >> np.uint64(56)))[::-1][real[begin:until]]


def sorted_with(keys: np.ndarray, numbers: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order with their numbers, which are below 256. ``narrow``: keys are below 2**56, so both are sorted as one."""
    if narrow:
        both = (keys << np.uint64(8)) | numbers.astype(np.uint64)
        both.sort()
        return both >> np.uint64(8), (both & np.uint64(255)).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    return keys[order], numbers[order].astype(np.int64)


class Counted:
    """Distinct keys with their counts, in sorted runs that are merged as they become many.

    A run holds a key several times if its count is over 255."""

    def __init__(self, narrow: bool):
        self.narrow = narrow
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.raw: list[np.ndarray] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: bool) -> None:
        """Each key once more; with ``counts`` false it is only noted."""
        if counts:
            self.raw.append(keys)
            self.waiting += len(keys)
            if self.waiting >= SORTED:
                self._settle()
        else:
            keys = np.unique(keys)
            self.add_run(keys, np.zeros(len(keys), np.int64))

    def _settle(self) -> None:
        if self.raw:
            keys = np.concatenate(self.raw)
            self.raw, self.waiting = [], 0
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.add_run(keys[first], np.diff(np.append(first, len(keys))))

    def add_run(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Sorted distinct keys."""
        if len(counts) and counts.max() > 255:
            times = np.maximum(1, -(-counts // 255))
            last = np.cumsum(times) - 1
            keys, rest = np.repeat(keys, times), counts - 255 * (times - 1)
            counts = np.full(len(keys), 255, np.uint8)
            counts[last] = rest
        self.runs.append((keys, counts.astype(np.uint8)))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) >= len(self.runs[-2][0]):
            some, self.runs[-2:] = self.runs[-2:], []
            self.add_run(*self._merged(some))

    def _merged(self, some) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = sorted_with(np.concatenate([k for k, _ in some]), np.concatenate([n for _, n in some]), self.narrow)
        if not len(keys):
            return keys, counts
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        some, self.runs = self.runs, []
        return self._merged(some) if some else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def packed(values: np.ndarray) -> bytes:
    """Compressed, all first bytes together, then all second ones and so on."""
    width = values.dtype.itemsize
    return values.dtype.char.encode() + len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    kind, n = np.dtype(data[:1].decode()), int.from_bytes(data[1:9], "little")
    flat = np.frombuffer(pa.decompress(data[9:], n * kind.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, n).T).view(kind).ravel()


def small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)


class Trees:
    """The nodes of depths ``low`` to ``depth`` over some sorted grams, for each of a byte's eight bits."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: int, depth: int):
        self.low, self.depth = low, depth
        self.keys, self.up, self.nodes = {depth: grams}, {}, {}
        n = {depth: counts}
        for d in range(depth - 1, low - 1, -1):  # without the context's oldest byte
            shorter = ((self.keys[d + 1] >> np.uint64(16)) << np.uint64(8)) | (self.keys[d + 1] & np.uint64(255))
            self.keys[d], self.up[d + 1] = np.unique(shorter, return_inverse=True)
            n[d] = np.bincount(self.up[d + 1], n[d + 1], len(self.keys[d])).astype(np.int64)
        self.log_pw = [None] * 8  # of the depth that was made last
        for d in range(depth, low - 1, -1):
            self.nodes[d] = [self._bit(d, i, n.pop(d) if i == 7 else n[d]) for i in range(8)]

    def _bit(self, d: int, i: int, counts: np.ndarray):
        """(first gram of each node, node of each gram, zeros, ones, weight of the node's own estimate)."""
        name = self.keys[d] >> np.uint64(8 - i)
        opens = np.concatenate([[True], name[1:] != name[:-1]])
        first, node = np.flatnonzero(opens), np.cumsum(opens) - 1
        ones = np.add.reduceat(counts * self.bit(d, i), first)
        zeros = np.add.reduceat(counts, first) - ones
        below = None
        if d < self.depth:
            below = np.bincount(node[self.up[d + 1][self.nodes[d + 1][i][0]]], self.log_pw[i], len(first))
        self.log_pw[i], stop = weigh(zeros, ones, below)
        kind = np.int32 if counts.sum() < 1 << 31 else np.int64
        return first.astype(np.int32), node.astype(np.int32), zeros.astype(kind), ones.astype(kind), stop

    def bit(self, d: int, i: int) -> np.ndarray:
        return (self.keys[d] >> np.uint64(7 - i)) & np.uint64(1) == 1

    def names(self, d: int, i: int, shorter: int = 0) -> np.ndarray:
        """Of each node, its context without the ``shorter`` oldest bytes, then its partial byte."""
        keys = self.keys[d][self.nodes[d][i][0]]
        part = np.uint64(1 << i) | ((keys & np.uint64(255)) >> np.uint64(8 - i))
        return ((keys >> np.uint64(8 + 8 * shorter)) << np.uint64(8)) | part

    def summary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(name, zeros, ones, log P of the children) of the nodes one level above ``low``."""
        names = np.concatenate([self.names(self.low, i, 1) for i in range(8)])
        zeros, ones = (np.concatenate([self.nodes[self.low][i][k] for i in range(8)]).astype(np.int64) for k in (2, 3))
        return summed(names, zeros, ones, np.concatenate(self.log_pw))

    def costs(self, top: Top) -> np.ndarray:
        """Natural logarithm of each gram's last byte given those before it."""
        cost = np.zeros(len(self.keys[self.depth]))
        for i in range(8):
            one, rest = top.mixture(self.names(self.low, i, 1))
            for d in range(self.low, self.depth + 1):
                first, node, zeros, ones, stop = self.nodes[d][i]
                if d > self.low:  # each node's parent
                    parent = self.nodes[d - 1][i][1][self.up[d][first]]
                    one, rest = one[parent], rest[parent]
                one = one + rest * stop * (ones + 0.5) / (zeros + ones + 1.0)
                rest = rest * (1 - stop)
            cost += np.log(np.where(self.bit(self.depth, i), one[node], 1 - one[node]))
        return cost


def summed(names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
    found, at = np.unique(names, return_inverse=True)
    return found, *(np.bincount(at, x, len(found)).astype(x.dtype) for x in (zeros, ones, below))


class Top:
    """The trees' top, from the nodes of depth ``depth`` with what lies below them."""

    def __init__(self, names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, depth: int):
        levels = []
        for _ in range(depth + 1):
            log_pw, stop = weigh(zeros, ones, below)
            own = (ones + 0.5) / (zeros + ones + 1.0)
            levels.append((names, own, stop))
            shorter, at = np.unique(((names >> np.uint64(16)) << np.uint64(8)) | (names & np.uint64(255)), return_inverse=True)
            levels[-1] += (at,)
            zeros, ones = (np.bincount(at, x, len(shorter)).astype(np.int64) for x in (zeros, ones))
            names, below = shorter, np.bincount(at, log_pw, len(shorter))
        one, rest = None, None
        for names, own, stop, at in reversed(levels):
            one, rest = (np.zeros(len(names)), np.ones(len(names))) if one is None else (one[at], rest[at])
            one, rest = one + rest * stop * own, rest * (1 - stop)
        self.names, self.one, self.rest = names, one, rest

    def mixture(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a one so far, weight that is left for deeper nodes)."""
        at = np.searchsorted(self.names, names)
        return self.one[at], self.rest[at]


def pieces(grams: np.ndarray, local: int, depth: int):
    """Ranges of sorted grams that hold whole contexts."""
    context = grams >> np.uint64(8 * (depth + 1 - local))
    ends = np.append(np.flatnonzero(context[1:] != context[:-1]) + 1, len(grams))
    begin = 0
    while begin < len(grams):
        end = int(ends[min(np.searchsorted(ends, begin + PIECE, side="right"), len(ends) - 1)])
        previous = ends[(ends > begin) & (ends <= begin + PIECE)] if end - begin > PIECE else ()
        end = int(previous[-1]) if len(previous) else end
        yield slice(begin, end)
        begin = end


def gathered(chunked: DataFrame, depth: int, local: int, parts: int) -> DataFrame:
    """(part, chunk, and packed: grams, gram_counts, words, word_counts) for each part of each chunk."""

    def dealt(keys: np.ndarray, part: np.ndarray):
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        return keys[order], np.searchsorted(part[order], np.arange(parts + 1)), order

    def run(batches):
        found: dict[int, tuple[Counted, Counted]] = {}
        for batch in byte_slices(batches, 2, BATCH_BYTES):
            for chunk in pc.unique(batch.column(0)).to_pylist():
                grams, words = found.setdefault(chunk, (Counted(depth <= 6), Counted(False)))
                for held in (False, True):
                    texts = batch.column(2).filter(pc.and_(pc.equal(batch.column(0), chunk), pc.equal(batch.column(1), held)))
                    if not len(texts):
                        continue
                    data, offsets = bytes_of(texts)
                    for keys in grams_of(data, offsets, depth):
                        grams.add(keys, not held)
                    starts, ends, _ = words_of(data, offsets)
                    words.add(hashes(data, starts, ends, FOLDED), not held)
                    words.add(np.repeat(END_WORD, len(texts)), not held)
        while found:
            chunk, (grams, words) = found.popitem()
            keys, n = grams.result()
            keys, cuts, order = dealt(keys, (mixed(keys >> np.uint64(8 * (depth + 1 - local))) % np.uint64(parts)).astype(np.int64))
            n = n[order]
            names, times = words.result()
            names, word_cuts, order = dealt(names, (names % np.uint64(parts)).astype(np.int64))
            times = times[order]
            for p in range(parts):
                g, w = slice(cuts[p], cuts[p + 1]), slice(word_cuts[p], word_cuts[p + 1])
                if g.stop > g.start or w.stop > w.start:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "chunk": pa.array([chunk], pa.int32()), **{k: pa.array([packed(v)], pa.binary()) for k, v in (("grams", keys[g]), ("gram_counts", small(n[g])), ("words", names[w]), ("word_counts", small(times[w])))}})

    return chunked.select("chunk", "held_out", "text").mapInArrow(trimmed(run), "part int, chunk int, grams binary, gram_counts binary, words binary, word_counts binary")


def _rows(batches):
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
            yield row


def merged(packs, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all (keys, counts), with their counts added up."""
    counted = Counted(narrow)
    for keys, counts in packs:
        counted.add_run(unpacked(keys), unpacked(counts).astype(np.int64))
    return counted.result()


BUCKETS = 64


def solved_top(keys: DataFrame, depth: int, local: int, parts: int) -> tuple[Top, int, int]:
    """(top of the trees, number of training tokens, number of distinct ones)."""
    spark = keys.sparkSession

    def up(batches):
        rows = list(_rows(batches))
        grams, n = merged([(r[0], r[1]) for r in rows], depth <= 6)
        _, times = merged([(r[2], r[3]) for r in rows], False)
        del rows
        found = [Trees(grams[s], n[s], local, depth).summary() for s in pieces(grams, local, depth)]
        out = summed(*[np.concatenate(x) for x in zip(*found, strict=True)]) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, np.zeros(0))
        bucket = (mixed(out[0] >> np.uint64(8)) % np.uint64(BUCKETS)).astype(np.int64)
        for b in range(BUCKETS):
            mine = bucket == b
            if mine.any() or b == 0 and len(times):
                totals = (int(times.sum()), int((times > 0).sum())) if b == 0 else (0, 0)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), **{k: pa.array([packed(v[mine])], pa.binary()) for k, v in zip(("names", "zeros", "ones", "below"), out, strict=True)}, "tokens": pa.array([totals[0]], pa.int64()), "distinct": pa.array([totals[1]], pa.int64())})

    nodes = "names binary, zeros binary, ones binary, below binary"
    summaries = stored(keys.select("part", "grams", "gram_counts", "words", "word_counts").repartitionById(parts, "part").drop("part").mapInArrow(trimmed(up), f"bucket int, {nodes}, tokens long, distinct long"), "summaries", "none")

    def join(batches):
        rows = [[unpacked(x) for x in row] for row in _rows(batches)]
        if rows:
            out = summed(*[np.concatenate(x) for x in zip(*rows, strict=True)])
            yield pa.RecordBatch.from_pydict({k: pa.array([packed(v)], pa.binary()) for k, v in zip(("names", "zeros", "ones", "below"), out, strict=True)})

    # BUCKETS rows, which together hold at most 255 * 257 ** (local - 1) nodes.
    rows = [[unpacked(bytes(x)) for x in r] for r in summaries.select("bucket", "names", "zeros", "ones", "below").repartitionById(BUCKETS, "bucket").drop("bucket").mapInArrow(join, nodes).collect()]
    whole = summed(*[np.concatenate(x) for x in zip(*rows, strict=True)]) if rows else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, np.zeros(0))
    totals = summaries.agg(F.sum("tokens"), F.sum("distinct")).first()
    return Top(*whole, local - 1), int(totals[0] or 0), int(totals[1] or 0)


def answered(keys: DataFrame, top: Top, depth: int, local: int, parts: int) -> DataFrame:
    """(chunk, and packed: grams, costs, words, totals): of each chunk's grams the cost, of its words the count."""
    shared = keys.sparkSession.sparkContext.broadcast(top)

    def down(batches):
        rows = list(_rows(batches))
        grams, n = merged([(r[1], r[2]) for r in rows], depth <= 6)
        cost = np.empty(len(grams), np.float32)
        for s in pieces(grams, local, depth):
            cost[s] = Trees(grams[s], n[s], local, depth).costs(shared.value)
        words, times = merged([(r[3], r[4]) for r in rows], False)
        while rows:
            chunk, own, _, named, _ = rows.pop()
            costs, totals = cost[np.searchsorted(grams, unpacked(own))], times[np.searchsorted(words, unpacked(named))]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in (("grams", own), ("costs", packed(costs)), ("words", named), ("totals", packed(small(totals))))}})

    return keys.select("part", "chunk", "grams", "gram_counts", "words", "word_counts").repartitionById(parts, "part").drop("part").mapInArrow(trimmed(down), "chunk int, grams binary, costs binary, words binary, totals binary")


class Lookup:
    """Values by well-mixed 64-bit keys that are all known to be there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(1, min(24, int(len(keys)).bit_length())))
        self.first = np.searchsorted(self.keys >> self.shift, np.arange(1 << int(64 - self.shift), dtype=np.uint64)).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.first[keys >> self.shift]
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != keys[left]]
        return self.values[at]


def score(docs: DataFrame, held_out: str, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, depth: int = DEPTH, local: int = LOCAL, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``;
    rows whose column ``held_out`` is true are not learned from. Scores are decimal logarithms."""
    if not 1 <= local < depth <= 7:
        raise ValueError("1 <= local < depth <= 7 must hold")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(held_out), F.lit(False)).alias("held_out"), text_of(docs, text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    parts = max(partitions(spark), -(-size // part_bytes)) if size >= part_bytes else 1
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    keys = stored(gathered(chunked.repartitionById(chunks, "chunk"), depth, local, parts), "grams", "none")
    top, tokens, distinct = solved_top(keys, depth, local, parts)
    values = answered(keys, top, depth, local, parts)
    columns = ["doc_id", "held_out", "text", "grams", "costs", "words", "totals"]
    null = lambda df, names: df.select("chunk", *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in names])
    types = list(zip(columns, [rows.schema["doc_id"].dataType, "boolean", "string", *["binary"] * 4], strict=True))
    met = null(values, types).union(null(chunked, types)).repartitionById(chunks, "chunk").sortWithinPartitions("chunk", F.col("text").isNotNull()).drop("chunk")
    # A chunk's own values come before its texts; "chunk" is told by them, as each has values for its end marks.

    def run(batches):
        held: list[tuple] = []
        costs = seen = None
        for batch in byte_slices(batches, 2, 2 * BATCH_BYTES, 255):
            valued = batch.column(2).null_count and batch.filter(pc.is_null(batch.column(2)))
            if valued:
                if costs is not None:
                    held, costs, seen = [], None, None
                held += [tuple(unpacked(x) for x in r) for r in zip(*[valued.column(i).to_pylist() for i in range(3, 7)], strict=True)]
            batch = batch.filter(pc.is_valid(batch.column(2)))
            if not batch.num_rows:
                continue
            if costs is None:
                keys, values = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                order = np.argsort(keys)
                costs = keys[order], values[order]
                seen = Lookup(np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]).astype(np.int64))
                held = []
                end_count = int(seen(END_WORD)[0])
            data, offsets = bytes_of(batch.column(2))
            sizes = np.diff(offsets)
            total, at, of = np.zeros(len(sizes)), 0, np.repeat(np.arange(len(sizes), dtype=np.uint8), sizes + 1)
            for grams in grams_of(data, offsets, depth):
                if len(grams):
                    keys, whose = sorted_with(grams, of[at : at + len(grams)], depth <= 6)
                    opens = np.concatenate([[True], keys[1:] != keys[:-1]])
                    found = costs[1][np.searchsorted(costs[0], keys[opens])]
                    total += np.bincount(whose, np.repeat(found, np.diff(np.append(np.flatnonzero(opens), len(keys)))), len(total))
                    at += len(grams)
            starts, stops, first = words_of(data, offsets)
            counts = seen(hashes(data, starts, stops, FOLDED)) if len(starts) else np.zeros(0, np.int64)
            upto = lambda x: np.concatenate([[0], np.cumsum(x)])
            known, base = upto(counts > 0), upto(np.log10((counts + 1) / (tokens + distinct + 1)))
            n_words = np.diff(first)
            base = np.diff(base[first]) + np.log10((end_count + 1) / (tokens + distinct + 1))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0), "held_out": batch.column(1), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(n_words + 1, pa.int64()),
                    "n_known": pa.array(np.diff(known[first]) + int(end_count > 0), pa.int64()), "train_tokens": pa.array(np.full(len(sizes), tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(total / np.log(10)),
                }
            )

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return met.mapInArrow(trimmed(run), schema)
