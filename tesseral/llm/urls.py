"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

The trees learn from the urls that a rule decides: about ``sample`` distinct ones at most, chosen by a hash. They are regression trees on histograms, fitted to the gradient of the logistic loss. Features: lengths,
depth, digit and hyphen ratios, entropy, counts of parameters and labels, and statistics of the host's suffixes
and the path's first segment among the training urls.

Defined results: a null url, or one without ``://``, has an empty host and path, and no rule; its verdict is the
trees', on its features as they are. Without anything to learn from, or with one kind of label only, the trees
give the prior's side, ``allow`` if there is none. Repeated urls get equal rows, an empty table gives none, and input
columns named like an output are replaced.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, free_names, quoted, ship, slices, without


@dataclasses.dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.rule).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


FEATURES = ("url_length", "host_length", "path_length", "query_length", "labels", "depth", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "fragment", "secure", "longest_label", "suffix1", "suffix2", "suffix3", "first_segment")


def entropy(text: str) -> float:
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values()) if text else 0.0


def parts(url: str) -> tuple[str, str, str, str]:
    _, mark, rest = url.partition("://")
    host, path, query, fragment = re.match(r"(?s)([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?", rest if mark else "").groups()
    return host.lower(), path, query or "", fragment or ""


class Statistics:
    """Smoothed log-odds of ``block`` for each key seen in training, 0 for others."""

    def __init__(self, urls: list[str], labels: np.ndarray):
        self.prior = math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
        self.odds: dict[tuple[int, str], float] = {}
        seen: dict[tuple[int, str], list[int]] = {}
        for url, label in zip(urls, labels.tolist(), strict=True):
            for key in self.keys(url):
                seen.setdefault(key, [0, 0])[label] += 1
        for key, (no, yes) in seen.items():
            if no + yes >= 5:
                self.odds[key] = math.log((yes + 1) / (no + 1)) - self.prior

    @staticmethod
    def keys(url: str) -> list[tuple[int, str]]:
        host, path, _, _ = parts(url)
        labels = host.split(".")
        return [(n, ".".join(labels[-n:])) for n in (1, 2, 3)] + [(0, path.split("/")[1] if path.count("/") else "")]

    def of(self, url: str) -> list[float]:
        return [self.odds.get(key, 0.0) for key in self.keys(url)]


def features(url: str, statistics: Statistics) -> list[float]:
    host, path, query, fragment = parts(url)
    labels = host.split(".") if host else []
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), len(query), len(labels), sum(bool(s) for s in path.split("/")), digits / max(1, len(url)),
        sum(c.isdigit() for c in host) / max(1, len(host)), host.count("-"), entropy(url), entropy(host), sum(bool(p) for p in query.split("&")),
        float(bool(fragment)), float(url[:8].lower() == "https://"), max(map(len, labels), default=0), *statistics.of(url),
    ]


class BoostedTrees:
    """Trees of fixed depth on binned features, for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, damping: float = 1.0, least: int = 8):
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T] if len(x) else []
        share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.0
        self.start = math.log(share / (1 - share)) if 0 < share < 1 else -1.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.depth = depth
        if not len(x) or y.min() == y.max():
            return
        binned = self.binned(x)
        margin = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            tree, at = self._grow(binned, y - p, p * (1 - p), depth, damping, least, bins)
            self.trees.append((tree[0], tree[1], tree[2] * rate))
            margin += self.trees[-1][2][at]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, x, gradient, curvature, depth, damping, least, bins):
        feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, bins + 1)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            best = np.zeros(nodes)
            for f in range(x.shape[1]):
                slot = at * (bins + 1) + x[:, f]
                g, h, n = (np.bincount(slot, w, nodes * (bins + 1)).reshape(nodes, -1).cumsum(axis=1) for w in (gradient, curvature, np.ones(len(x))))
                whole = lambda a, b: a**2 / (b + damping)
                gain = whole(g, h) + whole(g[:, -1:] - g, h[:, -1:] - h) - whole(g[:, -1:], h[:, -1:])
                gain = np.where((n >= least) & (n[:, -1:] - n >= least), gain, 0)
                c = gain.argmax(axis=1)
                better = gain[np.arange(nodes), c] > best + 1e-9
                best[better] = gain[np.arange(nodes), c][better]
                feature[first : first + nodes][better], cut[first : first + nodes][better] = f, c[better]
            at = 2 * at + (x[np.arange(len(x)), feature[first + at]] > cut[first + at])
        g, h = np.bincount(at, gradient, 1 << depth), np.bincount(at, curvature, 1 << depth)
        return (feature, cut, g / (h + damping)), at

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if self.trees and len(x):
            binned, rows = self.binned(x), np.arange(len(x))
            for feature, cut, leaf in self.trees:
                at = np.zeros(len(x), np.int64)
                for level in range(self.depth):
                    node = (1 << level) - 1 + at
                    at = 2 * at + (binned[rows, feature[node]] > cut[node])
                out += leaf[at]
        return out


def fit(urls: list[str], labels: list[int]) -> tuple[Statistics, BoostedTrees]:
    y = np.array(labels, dtype=np.int64)
    statistics = Statistics(urls, y)
    x = np.array([features(u, statistics) for u in urls], dtype=np.float64).reshape(len(urls), len(FEATURES))
    return statistics, BoostedTrees(x, y)


def judge(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url", sample: int = 20_000, labelled: DataFrame | None = None) -> DataFrame:
    """All columns of ``pages``, ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and ``block_score``
    (the trees' probability of ``block``). ``labelled`` (url, blocked) replaces the urls that rules decide."""
    spark = pages.sparkSession
    ship(spark)
    kept = without(pages, "host", "path", "rule", "verdict", "block_score").columns
    whole, ruled = free_names(pages, "whole_url", "ruled_verdict")
    rows = pages.select(*[quoted(c) for c in kept], F.coalesce(quoted(url).cast("string"), F.lit("")).alias(whole))
    address = F.col(whole)
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("host", host_of(address)).withColumn("path", path_of(address)).withColumn("rule", rule).withColumn(ruled, verdict)
    known = rows.where("rule IS NOT NULL").select(address.alias("u"), (F.col(ruled) == "block").cast("int").alias("y")) if labelled is None else labelled.select(F.col("url").alias("u"), F.col("blocked").cast("int").alias("y")).dropna()
    share = max(1, -(-known.distinct().count() // sample))
    chosen = known.where(F.pmod(F.xxhash64("u"), F.lit(share)) == 0).distinct().collect()  # a documented bound
    chosen.sort(key=lambda r: (r.u, r.y))
    model = spark.sparkContext.broadcast(fit([r.u for r in chosen], [r.y for r in chosen]))
    names = [*kept, "host", "path", "rule", ruled]
    scored = rows.select(*[quoted(c) for c in names], address)
    schema = T.StructType([*scored.schema.fields, T.StructField("block_score", T.DoubleType(), False)])

    def run(batches):
        statistics, trees = model.value
        for batch in slices(batches, 4096):
            found = batch.column(batch.num_columns - 1).to_pylist()
            x = np.array([features(u, statistics) for u in found], dtype=np.float64).reshape(len(found), len(FEATURES))
            p = 1 / (1 + np.exp(-trees.margin(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "block_score"])

    judged = scored.mapInArrow(run, schema)
    verdict = F.coalesce(F.col(ruled), F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return judged.select(*[quoted(c) for c in names[:-1]], verdict.alias("verdict"), "block_score")
