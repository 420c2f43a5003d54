"""Token-id files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over all ids and shared by every block, codes independent blocks. A block holds
whole documents in ascending doc_id order. Its ids are dealt to interleaved lanes (id i to lane i mod lanes),
each with a state of its own, that share one stream of 32-bit words. At each checkpoint the block notes the
states and the place in the stream, so that its segments decode side by side; a checksum guards the block.

A store is two Parquet folders, written by Spark's committer so that lost tasks leave nothing behind:
``table`` (id, frequency) and ``blocks`` (part, seq, start in part, ids, block). Parts follow doc_id order.

Defined results: null text counts as empty (only the end id); rows with a null doc_id come first; repeated
doc_ids stay separate rows, ordered by length and ids; an empty table gives an empty store that reads as no rows.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import BATCH, REMEMBERED, WordTable, binary_column, byte_symbols, may_end_word, read_spec
from .common import partitions, quoted, ship, slices, stored, text_of

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
LANES = 512
CHECKPOINT_STEPS = 256
BLOCK_IDS = 1 << 18
MAGIC = 0x534E4154


class FrequencyTable:
    """Frequencies that add up to 2**SCALE_BITS, at least one for each id that occurs."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        self.ids = ids.astype(np.uint32)
        self.freq = freqs.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(len(ids), dtype=np.uint32), freqs.astype(np.int64))
        self.place = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint32)
        self.place[ids] = np.arange(len(ids), dtype=np.uint32)
        self.common = int(np.argmax(freqs)) if len(freqs) else 0

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        whole = 1 << SCALE_BITS
        if len(counts) > whole:
            raise ValueError(f"more than {whole} distinct ids")
        total = int(counts.sum())
        freqs = np.maximum(1, (counts.astype(np.float64) * (whole / total)).astype(np.int64))
        order = np.argsort(-freqs, kind="stable")
        short = whole - int(freqs.sum())
        if short > 0:
            freqs[order[0]] += short
        while short < 0:  # take from the largest what the ones that were raised to 1 have got
            for i in order:
                give = min(-short, int(freqs[i]) // 2)
                freqs[i] -= give
                short += give
                if short == 0 or give == 0:
                    break
        return freqs


def encode_block(ids: np.ndarray, lengths: np.ndarray, keys: np.ndarray, nulls: np.ndarray, t: FrequencyTable) -> bytes:
    n = len(ids)
    lanes = LANES
    while lanes > 1 and lanes * 64 > n:
        lanes //= 2
    steps = -(-n // lanes)
    symbols = np.full(steps * lanes, t.common, dtype=np.uint32)
    symbols[:n] = t.place[ids]
    symbols = symbols.reshape(steps, lanes)
    freq, start = t.freq[symbols], t.start[symbols]
    bound = freq << np.uint64(31 - SCALE_BITS + 32)
    state = np.full(lanes, LOW, dtype=np.uint64)
    words, sizes, marks = [], np.zeros(steps, dtype=np.int64), []
    bits = np.uint64(SCALE_BITS)
    for step in range(steps - 1, -1, -1):
        full = state >= bound[step]
        if full.any():
            out = state[full].astype(np.uint32)
            state[full] >>= WORD
            words.append(out)
            sizes[step] = len(out)
        quotient, rest = np.divmod(state, freq[step])
        state = (quotient << bits) + rest + start[step]
        if step % CHECKPOINT_STEPS == 0:
            marks.append(state.copy())
    offsets = np.concatenate([[0], np.cumsum(sizes)])[:-1][::CHECKPOINT_STEPS]
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    states = np.stack(marks[::-1]) if marks else np.zeros((0, lanes), np.uint64)
    header = np.array([MAGIC, 1, len(lengths), n, lanes, CHECKPOINT_STEPS, len(states), len(stream)], dtype="<u8")
    body = b"".join(x.tobytes() for x in (header, keys.astype("<i8"), nulls.astype("u1"), lengths.astype("<u8"), offsets.astype("<u8"), states.astype("<u8"), stream.astype("<u4")))
    return body + np.uint32(zlib.crc32(body)).tobytes()


def decode_block(block: bytes, t: FrequencyTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, lengths, keys, nulls) of a block; all its segments are decoded side by side."""
    body = block[:-4]
    if zlib.crc32(body) != int(np.frombuffer(block[-4:], "<u4")[0]):
        raise ValueError("a token block's checksum doesn't hold")
    header = np.frombuffer(body[:64], "<u8").astype(np.int64)
    if header[0] != MAGIC or header[1] != 1:
        raise ValueError("not a token block")
    _, _, docs, n, lanes, every, segments, size = (int(x) for x in header)
    at = 64

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    keys, nulls, lengths, place = take(docs, "<i8"), take(docs, "u1"), take(docs, "<u8").astype(np.int64), take(segments, "<u8").astype(np.int64)
    state = take(segments * lanes, "<u8").reshape(segments, lanes).copy()
    stream = np.concatenate([take(size, "<u4"), np.zeros(1, np.uint32)]).astype(np.uint64)
    steps = -(-n // lanes)
    out = np.zeros((segments, every, lanes), dtype=np.uint32)
    mask, bits = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    for step in range(min(every, steps)):
        live = segments if step < steps - (segments - 1) * every else segments - 1  # the last segment may be shorter
        slot = state[:live] & mask
        symbol = t.slot[slot]
        out[:live, step] = symbol
        x = t.freq[symbol] * (state[:live] >> bits) + slot - t.start[symbol]
        low = x < LOW
        rank = np.cumsum(low, axis=1)
        words = stream[np.where(low, place[:live, None] + rank - 1, size)]
        state[:live] = np.where(low, (x << WORD) | words, x)
        place[:live] += rank[:, -1]
    return t.ids[out.reshape(-1)[:n]], lengths, keys, nulls


@functools.lru_cache(maxsize=2)
def library_table(spec: str) -> tuple[WordTable, int]:
    """The tokenizers library's model behind a memory of words, and the size of its vocabulary."""
    from tokenizers import Tokenizer, models

    tokenizer, data = Tokenizer.from_str(spec), json.loads(spec)["model"]
    options = {k: data[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if data.get(k)}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["merges"]]
    model = models.BPE(data["vocab"], pairs, cache_capacity=0, **options)  # the memory here does the cache's work
    symbols = dict(enumerate(byte_symbols()))
    space = symbols[0x20]

    def pre_token(part: str) -> list[int]:
        return [t.id for t in model.tokenize(part.encode().decode("latin-1").translate(symbols))]

    def run(words: bytes) -> list[int]:
        return [t.id for t in model.tokenize(words.decode("latin-1").translate(symbols))]

    to_byte = {c: b for b, c in symbols.items()}
    together = not any(right.startswith(space) and may_end_word(bytes(to_byte[c] for c in left)) for left, right in pairs)
    opens = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    opens[[i for t, i in data["vocab"].items() if t.startswith(space)]] = True
    return WordTable(pre_token, {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}, run if together else None, opens, 2 * REMEMBERED), tokenizer.get_vocab_size()


def id_type(spec: str, end_id: int) -> str:
    """The narrowest unsigned type that holds all ids."""
    return "<u2" if max(library_table(spec)[1], end_id + 1) <= 1 << 16 else "<u4"


def tokens(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, counts): the ids of each document with its end id, as narrow little-endian numbers.

    Each task adds a row of its own, in which ``counts`` has how often it saw each id, and the rest is null."""
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))

    def run(batches):
        (table, _), kind = library_table(spec.value), id_type(spec.value, end_id)
        counts = np.zeros(1 << 16, dtype=np.int64)
        for batch in slices(batches, 4 * BATCH):
            ids, lengths = table.encode(batch.column(1), end_id)
            got = np.bincount(ids)
            if len(got) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(got) - len(counts), np.int64)])
            counts[: len(got)] += got
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_column(ids.astype(kind), lengths), pa.nulls(len(lengths), pa.binary())], names=["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["doc_id", "ids", "counts"])

    return docs.select(quoted(doc_id).cast("long").alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(run, "doc_id long, ids binary, counts binary")


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the store of all documents at ``path``."""
    spark = docs.sparkSession
    wide = id_type(read_spec(tokenizer_path), end_id)
    staged = stored(tokens(docs, tokenizer_path, end_id, doc_id, text), "token-ids")

    def histogram(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                counts = np.frombuffer(data, np.int64)
                if len(counts) > len(total):
                    total = np.concatenate([total, np.zeros(len(counts) - len(total), np.int64)])
                total[: len(counts)] += counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    # As many rows as the vocabulary has ids, whatever the input.
    counted = staged.where("counts IS NOT NULL").select("counts").mapInArrow(histogram, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    ids = counted["id"].to_numpy(dtype=np.int64)
    freqs = FrequencyTable.scaled(counted["n"].to_numpy(dtype=np.int64)) if len(ids) else np.zeros(0, np.int64)
    spark.createDataFrame(list(zip(ids.tolist(), freqs.tolist(), strict=True)), "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((ids, freqs))

    def blocks(batches):
        from pyspark import TaskContext

        t, part, seq, begin = FrequencyTable(*shared.value), TaskContext.get().partitionId(), 0, 0
        held, keys, size = [], [], 0

        def cut():
            nonlocal held, keys, size, seq, begin
            data = encode_block(np.concatenate(held), np.array([len(h) for h in held]), np.array([k or 0 for k in keys], np.int64), np.array([k is None for k in keys]), t)
            row = [pa.array([x], kind) for x, kind in ((part, pa.int32()), (seq, pa.int32()), (begin, pa.int64()), (size, pa.int64()), (data, pa.binary()))]
            held, keys, seq, begin, size = [], [], seq + 1, begin + size, 0
            return pa.RecordBatch.from_arrays(row, names=["part", "seq", "part_start", "n_ids", "block"])

        for batch in slices(batches):
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(np.frombuffer(data, wide))
                keys.append(key)
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield cut()
        if held:
            yield cut()

    order = [F.col("doc_id").asc_nulls_first(), F.length("ids").asc(), F.col("ids").asc()]
    ranged = staged.where("ids IS NOT NULL").select("doc_id", "ids").repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order)
    ranged.mapInArrow(blocks, "part int, seq int, part_start long, n_ids long, block binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document of a store with its ids as little-endian 32-bit numbers."""
    ship(spark)
    rows = spark.read.schema("id long, freq long").parquet(f"{path}/table").toPandas().sort_values("id")
    shared = spark.sparkContext.broadcast((rows["id"].to_numpy(np.int64), rows["freq"].to_numpy(np.int64)))
    stored_blocks = spark.read.schema("part int, seq int, part_start long, n_ids long, block binary").parquet(f"{path}/blocks")
    # One total for each part: as many rows as the writer had partitions.
    totals = sorted((r.part, r.n) for r in stored_blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts = np.cumsum([0, *[n for _, n in totals]])
    base = spark.sparkContext.broadcast({part: int(s) for (part, _), s in zip(totals, starts, strict=False)})

    def run(batches):
        t = FrequencyTable(*shared.value)
        for batch in slices(batches, 1):
            for part, begin, block in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                ids, lengths, keys, nulls = decode_block(block, t)
                ends = np.cumsum(lengths)
                data = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64(), mask=nulls.astype(bool)),
                        pa.array(ends - lengths + begin + base.value[part]),
                        pa.array(lengths),
                        binary_column(data, lengths),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return stored_blocks.select("part", "part_start", "block").mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]))
