"""Language identification: script ranges narrow the candidates, Viterbi over word scores labels the spans.

A word's script is that of its first letter. The languages that the training texts write in that script are its
candidates; each scores the word by hashed letter n-grams (naive Bayes). Viterbi finds the best labelling of all
words when each switch of language costs ``penalty``. Most texts are in one language, which is proved at once:
if no run of words gains more than half the penalty in another language, no labelling with switches is better.
A prediction sees nothing but the text.

Spans count the characters of the text as it is. The model is fitted on at most about ``sample`` labelled texts, chosen by a hash of the doc_id, and has a fixed
size for each language. Defined results: ``und`` with score 0 for texts that are null or have no letter; words in
a script that no language was learned in are neutral and count as unexplained in the score; rows with a null
doc_id, or with a null language, are never learned from; without anything learned, every text is ``und``. Letters are
Unicode's, with the marks that follow them; digits and numerals are not. Repeated rows get equal predictions, an empty
table gives no rows, and input columns named like an output are replaced.
"""

from __future__ import annotations

import dataclasses
import functools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, quoted, ship, slices, text_of, without

#: First code points of script ranges, in order. A range runs to the next one.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"),
    (0x20000, "han"), (0x32000, "other"),
)
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT_AT = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])
BUCKETS = 1 << 16
REMEMBERED = 200_000
UNKNOWN = "und"


#: What the standard library's matcher takes for letters, which is quick to find and right for most texts.
PLAIN = re.compile(r"[^\W\d_]+")


@functools.lru_cache(maxsize=1)
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """(a letter and the letters and marks after it; a character for which PLAIN would give other words)."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)

    def members(pattern) -> np.ndarray:
        inside = np.zeros(0x110001, bool)
        for run in pattern.findall(every):
            inside[np.frombuffer(run.encode("utf-32-le"), "<u4")] = True
        return inside

    def ranges(inside: np.ndarray) -> str:
        turns = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in turns.reshape(-1, 2).tolist())

    letters, marks = members(regex.compile(r"\p{L}+")), members(regex.compile(r"\p{M}+"))
    return re.compile(f"[{ranges(letters)}][{ranges(letters | marks)}]*"), re.compile(f"[{ranges((members(PLAIN) != letters) | marks)}]")


def pattern_for(text: str) -> re.Pattern:
    """A pattern that finds this text's words."""
    if text.isascii():
        return PLAIN
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return patterns()[0] if patterns()[1].search(text) else PLAIN
    return patterns()[0] if any(c in text for c in "²³¹¼½¾") else PLAIN  # the only numerals there that are no digits


def words_in(text: str) -> list[str]:
    return pattern_for(text).findall(text)


def lowered(text: str) -> str:
    """Lower case, with as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(d := c.lower()) != 1 else d for c in text)


def script_of(code_points: np.ndarray) -> np.ndarray:
    return _SCRIPT_AT[np.searchsorted(_STARTS, code_points, side="right") - 1]


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of each n-gram of 1 to 4 letters, a word's borders included, and the words' scripts."""
    lengths = np.array([len(w) for w in words])
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n\n\n\n").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    first = 1 + np.cumsum(lengths + 1) - (lengths + 1)
    owner = np.repeat(np.arange(len(words)), lengths + 1)  # of each place from a word's left border to its last letter
    place = np.arange(len(owner))
    left = lengths[owner] - (place - first[owner] + 1)  # letters after this place
    h, out, whose = np.zeros(len(owner), np.uint64), [], []
    for n in range(4):
        h = (h * np.uint64(0x9E3779B1) + codes[place + n] + np.uint64(n + 1)) & np.uint64(0xFFFFFFFFFFFF)
        if n:
            whole = left + 1 >= n  # up to the right border
            mixed = h[whole] ^ (h[whole] >> np.uint64(17))
            out.append(((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(BUCKETS))
            whose.append(owner[whole])
    return np.concatenate(out).astype(np.int64), np.concatenate(whose), script_of(codes[first].astype(np.int64))


@dataclasses.dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, logarithms
    candidates: np.ndarray  # scripts x languages
    penalty: float

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores for each word, 0 for its best language; whether its script is known."""
        bucket, owner, script = gram_buckets(words)
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(words)))
        rows = np.add.reduceat(self.weights[bucket[order]], bounds, axis=0)
        allowed = self.candidates[script]
        known = allowed.any(axis=1)
        best = np.where(allowed, rows, -np.inf).max(axis=1, initial=-np.inf)
        rows = np.where(allowed, np.maximum(rows - np.where(known, best, 0)[:, None], -12.0), -12.0)
        rows[~known] = 0.0
        return rows.astype(np.float32), known

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language of each word."""
        best = int(s.sum(axis=0, dtype=np.float64).argmax())
        gain = np.cumsum(s - s[:, best : best + 1], axis=0, dtype=np.float64)
        floor = np.minimum(np.minimum.accumulate(np.vstack([np.zeros((1, s.shape[1])), gain[:-1]]), axis=0), 0)
        if (gain - floor).max() <= self.penalty / 2:
            return np.full(len(s), best)
        languages, came = range(s.shape[1]), []
        now = s[0].tolist()
        for row in s[1:].tolist():
            top = max(now)
            at, floor_ = now.index(top), top - self.penalty
            came.append([i if now[i] >= floor_ else at for i in languages])
            now = [max(now[i], floor_) + row[i] for i in languages]
        at = now.index(max(now))
        out = [at]
        for back in reversed(came):
            at = back[at]
            out.append(at)
        return np.array(out[::-1])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 40_000, penalty: float = 14.0) -> Model:
    """Learn from the rows of ``docs`` with a language; about ``sample`` of them at most."""
    ship(docs.sparkSession)
    rows = docs.where(quoted(lang).isNotNull() & quoted(doc_id).isNotNull() & quoted(text).isNotNull())
    share = max(1, -(-rows.count() // sample))
    chosen = rows.where(F.pmod(F.xxhash64(quoted(doc_id).cast("string"), F.lit("language")), F.lit(share)) == 0).select(text_of(docs, text).alias("text"), quoted(lang).cast("string").alias("lang"))

    def count(batches):
        grams, scripts = defaultdict(lambda: np.zeros(BUCKETS, np.int64)), defaultdict(lambda: np.zeros(len(SCRIPT_NAMES), np.int64))
        for batch in slices(batches):
            words: dict[str, Counter] = defaultdict(Counter)
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[name].update(words_in(lowered(t)))
            for name, counted in words.items():
                if counted:
                    times = np.array(list(counted.values()))
                    bucket, owner, script = gram_buckets(list(counted))
                    grams[name] += np.bincount(bucket, times[owner], BUCKETS).astype(np.int64)
                    scripts[name] += np.bincount(script, times, len(SCRIPT_NAMES)).astype(np.int64)
        for name, counts in grams.items():
            for kind, values in (("gram", counts), ("script", scripts[name])):
                used = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array([kind] * len(used)), pa.array(used), pa.array(values[used])], names=["lang", "kind", "at", "n"])

    counted = chosen.mapInArrow(count, "lang string, kind string, at long, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most BUCKETS and the scripts, for each language
    languages = sorted(found["lang"].unique())
    weights = np.full((BUCKETS, len(languages)), 0.5)
    candidates = np.zeros((len(SCRIPT_NAMES), len(languages)))
    for i, name in enumerate(languages):
        own = found[found["lang"] == name]
        g, s = own[own["kind"] == "gram"], own[own["kind"] == "script"]
        weights[g["at"], i] += g["n"]
        candidates[s["at"], i] = s["n"] / max(1, s["n"].sum())
    return Model(languages, np.log(weights / weights.sum(axis=0)) if languages else weights, candidates >= 0.01, penalty)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, ``lang_pred``, ``score`` (share of the letters that are in that language) and
    ``spans`` (characters from start to end, exclusive, with the language)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = without(docs, "lang_pred", "score", "spans").columns
    (whole,) = free_names(docs, "whole_text")
    rows = docs.select(*[quoted(c) for c in kept], text_of(docs, text).alias(whole))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("spans", SPANS, False)])

    def run(batches):
        m = shared.value
        known: dict[str, int] = {}
        scores, lengths, scripted = (np.zeros((0, len(m.languages)), np.float32), np.zeros(0, np.int64), np.zeros(0, bool))
        for batch in slices(batches):
            texts = [lowered(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            words = [words_in(t) for t in texts]
            new = list(dict.fromkeys(w for ws in words for w in ws if w not in known))
            if len(known) + len(new) > REMEMBERED and known:
                known, scores, lengths, scripted = {}, scores[:0], lengths[:0], scripted[:0]
                new = list(dict.fromkeys(w for ws in words for w in ws))
            if new and m.languages:
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                got, ok = m.score(new)
                scores, lengths, scripted = np.concatenate([scores, got]), np.concatenate([lengths, [len(w) for w in new]]), np.concatenate([scripted, ok])
            names, shares, spans = [], [], []
            for t, ws in zip(texts, words, strict=True):
                if not ws or not m.languages:
                    names.append(UNKNOWN)
                    shares.append(0.0)
                    spans.append([])
                    continue
                at = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
                path, size = m.path(scores[at]), lengths[at]
                held = np.bincount(path, size * scripted[at], len(m.languages))
                best = int(held.argmax()) if held.any() else int(np.bincount(path, size).argmax())
                names.append(m.languages[best])
                shares.append(float(held[best] / size.sum()))
                turns = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist()]
                if len(turns) == 1:
                    spans.append([{"start": 0, "end": len(t), "lang": m.languages[int(path[0])]}])
                else:
                    starts = [x.start() for x in pattern_for(t).finditer(t)]
                    cuts = [0, *[starts[k] for k in turns[1:]], len(t)]
                    spans.append([{"start": a, "end": b, "lang": m.languages[int(path[k])]} for a, b, k in zip(cuts[:-1], cuts[1:], turns, strict=True)])
            added = [pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "lang_pred", "score", "spans"])

    return rows.mapInArrow(run, schema)
