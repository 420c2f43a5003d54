"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of a text is a blob named by the SHA-256 of its content. The ledger, a Parquet folder that only
grows, notes for each blob which rules in which versions it was scanned with, and the spans found. A scan takes
the distinct blobs of its input, drops the pairs of blob and rule version that the ledger has, runs the rest,
appends the outcome, and joins the spans back to all paths that hold the blob. The ledger names each span's rule and
version, so it can be read with other rules, in any order.

Spans count code points, end exclusive. Matches of a rule are leftmost and don't overlap; those that fail the
rule's length test are dropped afterwards. Positions come from the lengths of the matches and of the pieces
between them. Defined results: a null text is the empty blob; repeated rows each get their spans; an empty
input gives no rows and leaves the ledger as it is; an input column named like the output is replaced, others stay.
"""

from __future__ import annotations

import dataclasses
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import free_names, quoted, text_of, without


@dataclasses.dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters or more. A changed rule needs a new version.

    ``words``: of these one at least is in every text with a match; without any, ``screen`` is a pattern that is
    quick to look for and found in each. They only spare the search where nothing can be found."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    words: tuple[str, ...] = ()
    screen: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which equal starts are listed. The least lengths of ``access`` and
#: ``hex`` are part of the patterns: a run that is too short would be matched whole and dropped, so nothing differs.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, screen=r"""[pPsStTaA](?i:assword|asswd|ecret|oken|pi_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, words=("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, screen=r"[0-9a-f]{24}"),
)
#: What the method adds, by the public forms of the tokens.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", words=("PRIVATE KEY-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, words=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, words=("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39, words=("AIza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, words=("eyJ",)),
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{1,100}@", words=("://",)),
)
RULES = BASE + MORE
SPANS, NOTED = "array<struct<start:int,kind:int,end:int>>", "array<struct<start:int,rule:string,end:int>>"


def may_match(rule: Rule, text: Column) -> Column:
    """False only where the rule can't match."""
    if rule.words:
        return reduce(or_, [text.contains(word) for word in rule.words])
    return text.rlike(rule.screen or rule.pattern)


def spans_of(rule: Rule, text: Column) -> Column:
    """The rule's spans in a text."""
    pattern = F.lit(rule.pattern)
    parts = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("g"), F.split(text, rule.pattern, -1).alias("p"))

    def step(state: Column, i: Column) -> Column:
        part = state["part"]
        start = state["at"] + F.length(part["p"][i])
        end = start + F.length(part["m"][i])
        span = F.struct(start.alias("start"), F.lit(rule.key).alias("rule"), end.alias("end"))
        out = F.when(F.length(part["g"][i]) >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(part.alias("part"), end.alias("at"), out.alias("out"))

    empty = F.array().cast(NOTED)

    def positions(p: Column) -> Column:
        start = F.struct(p.alias("part"), F.lit(0).alias("at"), empty.alias("out"))
        return F.when(F.size(p["m"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(p["m"]) - 1), start, step, lambda s: s["out"])).otherwise(empty)

    return F.when(may_match(rule, text), F.transform(F.array(parts), positions)[0]).otherwise(empty)


class Ledger:
    """A ledger at ``path``, which may not exist yet."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def entries(self) -> DataFrame | None:
        schema = f"blob string, rules array<string>, spans {NOTED}"
        try:
            return self.spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(self.path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def record(self, versions: DataFrame, text: str = "text") -> None:
        """Scan what the ledger has not seen of the texts, and append it."""
        blobs = versions.select(F.sha2(text_of(versions, text), 256).alias("blob"), text_of(versions, text).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        keys = F.array(*[F.lit(r.key) for r in self.rules])
        past = self.entries()
        if past is not None:
            done = past.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
            blobs = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))))
            blobs = blobs.where(F.size("todo") > 0)
        else:
            blobs = blobs.withColumn("todo", keys)
        found = [F.when(F.array_contains("todo", r.key), spans_of(r, F.col("text"))).otherwise(F.array().cast(NOTED)) if past is not None else spans_of(r, F.col("text")) for r in self.rules]
        blobs.select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("spans")).write.parquet(f"{self.path}/scan-{uuid.uuid4().hex}")

    def scan(self, versions: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
        """All columns of ``versions`` and ``out``: spans sorted by start, then by the rules' order."""
        self.record(versions, text)
        current = F.array(*[F.lit(r.key) for r in self.rules])
        noted = self.entries().where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).where(F.array_contains(current, F.col("s.rule")))
        place = (F.array_position(current, F.col("s.rule")) - 1).cast("int")
        blob, key, spans = free_names(versions, "blob", "blob_key", "blob_spans")
        found = noted.groupBy(F.col("blob").alias(key)).agg(F.array_sort(F.collect_set(F.struct(F.col("s.start").alias("start"), place.alias("kind"), F.col("s.end").alias("end")))).alias(spans))
        # Paths whose text no rule can match have no findings, and needn't be moved to be joined with any.
        kept = [quoted(c) for c in without(versions, out).columns]
        suspect = reduce(or_, [may_match(r, text_of(versions, text)) for r in self.rules])
        joined = versions.where(suspect).select(*kept, F.sha2(text_of(versions, text), 256).alias(blob)).join(found, F.col(blob) == F.col(key), "left")
        joined = joined.select(*kept, F.coalesce(spans, F.array().cast(SPANS)).alias(out))
        return joined.unionByName(versions.where(~suspect).select(*kept, F.array().cast(SPANS).alias(out)))


def listed(spans: str, rules: tuple[Rule, ...] = RULES, most: int | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined; with ``most``, of the first so many rules only."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    chosen = F.filter(spans, lambda s: s["kind"] < most) if most is not None else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: str, mark: str = "[secret]") -> Column:
    """The text with each stretch of spans replaced by ``mark``."""

    def step(state: Column, s: Column) -> Column:
        new = s["start"] >= state["at"]
        out = F.when(new, F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    joined = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
