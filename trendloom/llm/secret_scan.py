"""Secret scan with an incremental ledger of blobs; built-in functions only.

Every historical version of every path is addressed by the SHA-256 of its text.
A blob is scanned once for each rule version that the ledger does not list for
it; findings are joined back to all paths and versions that hold the blob.  Only
texts that pass a rule's hint are moved, and copies of them, a third of all rows
even, meet before the shuffle (map-side) and cost one scan; of all others the
hash alone is made.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.shared import stored


@dataclass(frozen=True)
class Rule:
    """A Java pattern; of group ``part`` at least ``least`` characters, or the match is dropped.

    ``hint`` is a necessary condition in SQL on ``text``, cheap to test.
    """

    kind: str
    pattern: str
    hint: str
    part: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules of the contract, then the formats of well-known tokens.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, r"(contains(text, '=') OR contains(text, ':')) AND text RLIKE r'(?i)(?:pass|secret|token|api_?key)'", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", r"contains(text, 'AKIA')", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", r"text RLIKE '[0-9a-f]{24}'", 0, 24),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"contains(text, 'PRIVATE KEY-----')"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"contains(text, 'eyJ')"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", r"text RLIKE 'gh[pousr]_'"),
    Rule("slack", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}", r"contains(text, 'xox')"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35,}", r"contains(text, 'AIza')"),
)
RULES = BASE + MORE
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _steps(rule: Rule, rank: int) -> Column:
    """For each match of one rule, in order: lengths of the text before it (from the match before), of itself and of its part, in code points."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.part))
    pieces = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    one = lambda x: F.struct(F.lit(rank).alias("rank"), F.length(x["b"]).alias("b"), F.length(x["m"]).alias("m"), F.length(x["p"]).alias("p"))
    return F.transform(F.arrays_zip(pieces.alias("b"), whole.alias("m"), part.alias("p")), one)


def _spans(hinted: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, spans of each blob of hinted (blob, text, todo) that has any; sums run along each blob's matches, linear in their number."""
    none = F.expr("CAST(array() AS array<struct<rank:int,b:int,m:int,p:int>>)")
    steps = F.concat(*[F.when(F.array_contains("todo", r.key) & F.expr(r.hint), _steps(r, i)).otherwise(none) for i, r in enumerate(rules)])
    rows = hinted.select("blob", F.posexplode(steps).alias("at", "s")).select("blob", "at", "s.*")
    so_far = Window.partitionBy("blob", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("b") + F.col("m")).over(so_far).cast("int"))
    named = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rank") + 1)
    kept = rows.where(F.col("p") >= named([r.least for r in rules]))
    span = F.struct((F.col("end") - F.col("m")).alias("start"), "rank", named([r.kind for r in rules]).alias("kind"), "end")
    return kept.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


@dataclass(frozen=True)
class Scan:
    """findings: a row for each version; blobs: spans of each blob that has any; ledger: what is scanned now."""

    findings: DataFrame
    blobs: DataFrame
    ledger: DataFrame


def scan_versions(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, known: DataFrame | None = None) -> Scan:
    """Scans what is new; ``ledger`` (blob, rules) and ``known`` (blob, spans) are those of the run before.

    findings has doc_id, blob and spans, array<struct<start, rank, kind, end>>
    in order of start, then of the rules; every row of versions has one, repeated
    ids and null ids too.  Null text is the empty text and has no spans.  Only
    the two named columns are read.  Spans of a changed rule's former version go.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = versions.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    new = lambda r: F.array_contains("todo", r.key)
    any_of = lambda tests: functools.reduce(lambda a, b: a | b, tests, F.lit(False))
    hinted = rows.where(any_of(F.expr(r.hint) for r in rules)).groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", keys)
    if ledger is not None:
        done = ledger.select(F.col("blob").alias("b"), F.col("rules").alias("done"))
        todo = F.array_except(keys, F.coalesce("done", F.expr("CAST(array() AS array<string>)")))
        hinted = hinted.join(done, hinted["blob"] == done["b"], "left").withColumn("todo", todo).drop("b", "done").where(any_of(new(r) & F.expr(r.hint) for r in rules))
    found = _spans(stored(hinted, "hinted"), rules)
    if known is not None:
        current = F.array(*[F.lit(r.kind) for r in rules])
        changed = known if ledger is None else known.join(ledger.select("blob", "rules"), "blob", "left")
        still = F.col("spans") if ledger is None else F.filter("spans", lambda s: F.exists("rules", lambda k: F.array_contains(keys, k) & (F.substring_index(k, "@", 1) == s["kind"])))
        found = found.union(changed.select("blob", F.filter(still, lambda s: F.array_contains(current, s["kind"])).alias("spans"))).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).where("size(spans) > 0")
    found = stored(found, "found")
    seen = rows.select("blob").distinct().withColumn("rules", keys)
    if ledger is not None:
        seen = seen.union(ledger.select("blob", "rules").join(seen.select("blob"), "blob", "left_anti"))
    back = rows.select("doc_id", "blob").join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.expr(f"CAST(array() AS {SPANS})")).alias("spans"))
    return Scan(back, found, seen)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
