"""Byte-level BPE by backtracking: exact merges in linear time, and decoding by an offset table.

A text is cut into pre-tokens. Inside one, an Aho-Corasick automaton over the *reversed* vocabulary, run over
the reversed pre-token, tells for each position the longest token that starts there. The encoder takes that
token if it may stand beside the one before (the pair-compatibility table: two tokens are compatible if merging
the bytes of both, by rank, would never join across their border); else it tries the token's next shorter
prefix, and steps back when none fits. Each position is left for good at most once, so time is linear.

Pre-tokens repeat, so a batch of texts is cut at its spaces, its distinct words are looked up (or encoded, when a
worker meets them first), and the ids of all words are gathered at once (``WordTable``).

Defined results: a null text counts as empty and has no ids; text that spells a special token becomes that
token's id, as the tokenizers library does by default; input columns named like an output are replaced. A vocabulary
in which two merges make the same token is refused.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from .bytewise import HashTable, bytes_of, hashes
from .common import free_names, quoted, ship, slices, text_of, trimmed, without

#: Fixed value: how the byte-level pre-tokenizer of the public vocabulary cuts a text.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words, pre-tokens, and pairs of tokens, remembered by a worker; a memory is emptied beyond it, which costs time only.
REMEMBERED, REMEMBERED_PARTS = 1_200_000, 50_000
#: Rows that are looked up together, and new words that are encoded together.
BATCH, RUN = 256, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b not in rest else chr(256 + rest.index(b)) for b in range(256)]


OTHER, LETTER, NUMBER, SPACE, APOSTROPHE = range(5)


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """What each code point is to PRE_TOKEN, by the tokenizers library's version of Unicode.

    Only code points on which two other versions disagree can differ, so the library is asked about those alone."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.findall(pattern, every):
            out[np.frombuffer(run.encode("utf-32-le"), "<u4")] = kind
    older = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in every), np.uint8, len(every))
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    disputed = points[(older != out[points]) & (out[points] != SPACE)].tolist()
    pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    out[disputed] = OTHER
    for kind, like in ((LETTER, "a"), (NUMBER, "1")):
        ends = {b for _, (_, b) in pre_tokenizer.pre_tokenize_str("\n".join(like + chr(c) for c in disputed))}
        out[[c for i, c in enumerate(disputed) if 3 * i + 1 not in ends]] = kind  # one piece with its like
    out[ord("'")] = APOSTROPHE
    return out


@functools.lru_cache(maxsize=1)
def pre_token_pattern() -> re.Pattern:
    """PRE_TOKEN for the standard library's faster matcher: its letter, number and space classes spelled as ranges."""

    def ranges(kind: int) -> str:
        turns = np.flatnonzero(np.diff(np.concatenate([[0], classes() == kind, [0]])))
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in turns.reshape(-1, 2).tolist())

    letter, number, space = (ranges(k) for k in (LETTER, NUMBER, SPACE))
    return re.compile(PRE_TOKEN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))


def classes_of_bytes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of this UTF-8 text belongs to."""
    if not (data >= 0x80).any():
        return classes()[data]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    return np.repeat(classes()[points], 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))


def may_end_word(token: bytes) -> bool:
    """Whether a word of letters, with a space before it, can end in these bytes."""
    try:
        text = token.decode().removeprefix(" ")
    except UnicodeDecodeError:
        return True
    return bool(text) and all(classes()[ord(c)] == LETTER for c in text)


class Vocabulary:
    """Tables of one tokenizer file; tokens are numbered by merge rank (bytes first) within."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, self.special = data["model"], {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        symbols = byte_symbols()
        to_byte = {c: b for b, c in enumerate(symbols)}
        raw = lambda token: bytes(to_byte[c] for c in token)
        self.tokens = [bytes([b]) for b in range(256)]
        self.halves = [(b, b) for b in range(256)]
        self.ids = [model["vocab"][symbols[b]] for b in range(256)]
        self.rank_of = {t: r for r, t in enumerate(self.tokens)}
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            whole, pair = raw(left + right), (self.rank_of[raw(left)], self.rank_of[raw(right)])
            if whole in self.rank_of:
                raise ValueError(f"two merges of the vocabulary make {whole!r}")
            self.rank_of[whole] = len(self.tokens)
            self.tokens.append(whole)
            self.halves.append(pair)
            self.ids.append(model["vocab"][left + right])
            self.merged[pair] = self.rank_of[whole]
        self.shorter = [next((self.rank_of[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank_of), -1) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for rank, token in enumerate(self.tokens):
            self.automaton.add_word(token[::-1].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether both tokens stay apart when their bytes are merged by rank."""
        key = (left, right)
        if (known := self.compatible.get(key)) is not None:
            return known
        limit, a, b, result = len(self.tokens), left, right, True
        while True:
            if (joined := self.merged.get((a, b))) is not None and joined < limit:
                result = False
                break
            if a > b:  # undo the later of the two merges
                limit, a = a, self.halves[a][1]
                if a == limit:  # a byte has no merge to undo
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        break
        if len(self.compatible) >= REMEMBERED_PARTS:
            self.compatible.clear()
        self.compatible[key] = result
        return result

    def encode_word(self, word: bytes) -> list[int]:
        if (rank := self.rank_of.get(word)) is not None:
            return [rank]
        n, tokens, fits, shorter = len(word), self.tokens, self.fits, self.shorter
        longest = [-1] * n
        for end, rank in self.automaton.iter(word[::-1].decode("latin-1")):
            start = n - 1 - end
            if longest[start] < 0 or len(tokens[rank]) > len(tokens[longest[start]]):
                longest[start] = rank
        reachable, out, at = bytearray(b"\x01" * (n + 1)), [], 0
        token = longest[0]
        while True:
            end = at + len(tokens[token])
            if reachable[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                reachable[at] = 0
                token = out.pop()
                at -= len(tokens[token])

    def pre_token(self, part: str) -> list[int]:
        ids = self.ids
        return [ids[r] for r in self.encode_word(part.encode())]

    def spaces_open(self) -> np.ndarray | None:
        """Whether each id begins with a space; None if some merge joins a space to the end of a word before it."""
        if any(self.tokens[r][:1] == b" " and may_end_word(self.tokens[left]) for left, r in self.merged):
            return None
        opens = np.zeros(max(self.ids) + 1, dtype=bool)
        opens[[i for i, t in zip(self.ids, self.tokens, strict=True) if t[:1] == b" "]] = True
        return opens


class WordTable:
    """Ids of whole texts, by an encoder of single pre-tokens.

    A text may be cut before each space that no white space follows: such a space begins a pre-token. So words
    between spaces are encoded one by one, with their space, and remembered by a 64-bit hash; the first word of a
    text, and texts with other runs of white space or with special tokens, are cut as a whole. ``run`` encodes
    the bytes of many words of letters at once, which gives the same if no merge joins a space to a word."""

    def __init__(self, pre_token, special: dict[str, int], run=None, opens: np.ndarray | None = None, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.pre_token, self.special, self.cut, self.run, self.opens = pre_token, special, pre_token_pattern(), run, opens
        self.cut_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.parts: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.known = HashTable(2)  # of each word: where its ids are in the pool, and how many; -1 if white space follows its space
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def part(self, p: str) -> list[int]:
        found = self.parts.get(p)
        if found is None:
            if len(self.parts) >= REMEMBERED_PARTS:
                self.parts.clear()
            found = self.parts[p] = self.pre_token(p)
        return found

    def whole(self, text: str) -> list[int]:
        """Ids of a text by its pre-tokens, one by one."""
        out: list[int] = []
        for piece in self.cut_special.split(text) if self.cut_special and any(s in text for s in self.special) else (text,):
            if piece in self.special:
                out.append(self.special[piece])
            else:
                for p in self.cut.findall(piece):
                    out += self.part(p)
        return out

    def _put(self, at: int, ids) -> int:
        """Ids into the pool from ``at``; where they end."""
        end = at + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(end, len(self.pool)), np.uint32)])
        self.pool[at:end] = ids
        return end

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """New words: letters, and what may follow them, many at a time; others one by one."""
        sizes = ends - starts
        own = data[gathered(starts, sizes)]
        begins = np.cumsum(sizes) - sizes
        kind = classes_of_bytes(own)
        if len(kind) != len(own):  # not UTF-8
            kind = np.full(len(own), APOSTROPHE, np.uint8)
        stops = np.append(np.flatnonzero(kind != LETTER), len(own))
        letters = np.minimum(stops[np.searchsorted(stops, begins)] - begins, sizes)
        odd = np.concatenate([[0], np.cumsum((kind != LETTER) & (kind != OTHER))])
        seen = np.concatenate([[0], np.cumsum(kind == LETTER)])
        simple = (letters > 0) & (odd[begins + sizes] == odd[begins]) & (seen[begins + sizes] - seen[begins] == letters) & (self.run is not None)
        at, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)

        bare = np.flatnonzero(simple & (letters == sizes))
        tailed = np.flatnonzero(simple & (letters < sizes))
        heads, where = np.unique(hashes(data, starts[tailed], starts[tailed] + letters[tailed]) | np.uint64(1), return_index=True)
        missing = (self.known.find(heads) < 0) & ~np.isin(heads, keys[bare])
        heads, where = np.concatenate([keys[bare], heads[missing]]), np.concatenate([bare, tailed[where[missing]]])
        head_at, head_size = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        for begin in range(0, len(where), RUN):
            some = where[begin : begin + RUN]
            found = np.array(self.run(data[gathered(starts[some] - 1, letters[some] + 1)].tobytes()), np.uint32)  # each with its space
            first = np.flatnonzero(self.opens[found])
            head_at[begin : begin + RUN] = self.used + first
            head_size[begin : begin + RUN] = np.diff(np.append(first, len(found)))
            self.used = self._put(self.used, found)
        self.known.add(heads, head_at, head_size)

        if len(tailed):
            slot = self.known.find(hashes(data, starts[tailed], starts[tailed] + letters[tailed]) | np.uint64(1))
            tails, which = np.unique(hashes(data, starts[tailed] + letters[tailed], ends[tailed]), return_index=True)
            ids = [self.part(data[starts[i] + letters[i] : ends[i]].tobytes().decode()) for i in tailed[which].tolist()]
            tail_size = np.array([len(x) for x in ids])
            tail_at = self.used + np.cumsum(tail_size) - tail_size
            self.used = self._put(self.used, [x for part in ids for x in part])
            of = np.searchsorted(tails, hashes(data, starts[tailed] + letters[tailed], ends[tailed]))
            pieces_at = np.stack([self.known.values[0][slot].astype(np.int64), tail_at[of]], axis=1).ravel()
            pieces = np.stack([self.known.values[1][slot].astype(np.int64), tail_size[of]], axis=1)
            found = self.pool[gathered(pieces_at, pieces.ravel())]
            size[tailed] = pieces.sum(axis=1)
            at[tailed] = self.used + np.cumsum(size[tailed]) - size[tailed]
            self.used = self._put(self.used, found)

        others, ids = np.flatnonzero(~simple), []
        for i in others.tolist():
            pieces = self.cut.findall(" " + data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"))
            at[i], size[i] = self.used + len(ids), -1
            if not pieces[0].isspace():
                begin = len(ids)
                for p in pieces:
                    ids += self.part(p)
                size[i] = len(ids) - begin
        self.used = self._put(self.used, ids)
        rest = np.concatenate([tailed, others])
        self.known.add(keys[rest], at[rest], size[rest])

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text), with the id ``end`` after each text if it is given."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data, offsets = bytes_of(texts)
        space = np.flatnonzero(data == 0x20)
        before = np.searchsorted(space, offsets)
        first = before[:-1] + np.arange(n)  # the number of each text's first word
        starts, ends = np.empty(len(space) + n, np.int64), np.empty(len(space) + n, np.int64)
        later = np.ones(len(starts), dtype=bool)
        later[first] = False
        starts[first], starts[later] = offsets[:-1], space + 1
        last = before[1:] + np.arange(n)
        inner = np.ones(len(starts), dtype=bool)
        inner[last] = False
        ends[last], ends[inner] = offsets[1:], space
        at, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        later = np.flatnonzero(later)
        keys = hashes(data, starts[later], ends[later]) | np.uint64(1)
        if self.known.count + len(later) > self.remembered and self.known.count + len(np.unique(keys)) > self.remembered:
            self.clear()
        slot = self.known.find(keys)
        if len(new := np.flatnonzero(slot < 0)):
            fresh, where = np.unique(keys[new], return_index=True)
            order = np.argsort(where)
            where = later[new[where[order]]]
            self._learn(data, starts[where], ends[where], fresh[order])
            slot = self.known.find(keys)
        at[later], size[later] = self.known.values[0][slot], self.known.values[1][slot]
        slow = np.logical_or.reduceat(size < 0, first)
        for s in self.special:
            slow |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        size[np.repeat(slow, np.diff(np.append(first, len(starts))))] = 0
        local: list[int] = []  # what follows belongs to this batch only
        for i, whole in zip(first.tolist(), slow.tolist(), strict=True):
            text = data[starts[i] : ends[i]].tobytes() if not whole else texts[int(np.searchsorted(first, i))].as_py().encode()
            if text:
                begin = len(local)
                local += self.whole(text.decode("utf-8", "replace"))
                at[i], size[i] = self.used + begin, len(local) - begin
        self._put(self.used, local)
        lengths = np.add.reduceat(size, first)
        ids = self.pool[gathered(at, size)]
        if end is None:
            return ids, lengths
        out = np.empty(len(ids) + n, np.uint32)
        closing = np.cumsum(lengths + 1) - 1
        inside = np.ones(len(out), dtype=bool)
        inside[closing] = False
        out[inside], out[closing] = ids, end
        return out, lengths + 1


def gathered(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``at``, ``at + 1`` and so on, ``size`` of them, for each pair one after another."""
    return np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)


def binary_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary value for each length, of so many of the values one after another."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * values.itemsize
    if ends[-1] >= 1 << 31:
        data = values.tobytes()
        return pa.array([data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


class OffsetTable:
    """Where the bytes of each token id begin in one string of all tokens, and how many there are."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        spelled = {i: bytes(to_byte[c] for c in t) for t, i in data["model"]["vocab"].items()}
        spelled |= {t["id"]: t["content"].encode() for t in data.get("added_tokens", [])}
        ordered = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.lengths = np.array([len(t) for t in ordered], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(ordered), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.blob[at]


@functools.lru_cache(maxsize=2)
def word_table(spec: str) -> WordTable:
    v = Vocabulary(spec)
    opens = v.spaces_open()
    return WordTable(v.pre_token, v.special, (lambda words: [v.ids[r] for r in v.encode_word(words)]) if opens is not None else None, opens)


@functools.lru_cache(maxsize=2)
def offset_table(spec: str) -> OffsetTable:
    return OffsetTable(spec)


def read_spec(tokenizer_path: str) -> str:
    with open(tokenizer_path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids``: the text's token ids, binary, little-endian 32-bit numbers."""
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))  # as large as the tokenizer, whatever the input
    kept = without(docs, ids)
    (whole,) = free_names(docs, "whole_text")
    base = docs.select(*[quoted(c) for c in kept.columns], text_of(docs, text).alias(whole))
    schema = T.StructType([*base.schema.fields[:-1], T.StructField(ids, T.BinaryType(), False)])

    def run(batches):
        table = word_table(spec.value)
        for batch in slices(batches, BATCH):
            found, lengths = table.encode(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], binary_column(found.astype("<u4", copy=False), lengths)], names=[*batch.schema.names[:-1], ids])

    return base.mapInArrow(trimmed(run), schema)


def decode(rows: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and ``text``: the text of the ids (null ids count as none), malformed UTF-8 replaced."""
    spark = rows.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))
    base = without(rows, text)
    schema = T.StructType([*base.schema.fields, T.StructField(text, T.StringType(), False)])
    place = base.columns.index(ids)

    def run(batches):
        v = offset_table(spec.value)
        for batch in slices(batches):
            parts = [np.frombuffer(x, dtype="<u4") for x in (b or b"" for b in batch.column(place).to_pylist())]
            flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
            data = v.decode(flat)
            ends = np.cumsum([0, *[int(v.lengths[p].sum()) for p in parts]])
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return base.mapInArrow(trimmed(run), schema)
