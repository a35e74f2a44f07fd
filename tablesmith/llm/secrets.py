"""Secret scans over a trigram inverted index (operator 4), in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: what every match
must contain, as an AND of ORs of literal strings, turned into branches (OR) of trigram
sets (AND).  The inverted index holds postings (trigram, document) for the trigrams that some
query names, over the lower-cased text.  Intersecting a branch's postings gives candidate documents;
only these are verified by the regular expression.  A rule without mandatory trigrams scans every text.

Spans are half-open, in code points.  They follow from the pieces between matches and the matches
themselves, so no position is searched twice.

Rules: a null text is empty; documents are known by (doc_id, text hash), nulls equal, so rows that agree
in both share their spans and every row is returned; whole texts are scanned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.base import shielded, text_of
from tablesmith.session import cut_lineage

_parser = re._parser  # the standard library's own parse tree of a pattern


@dataclass(frozen=True)
class Rule:
    """``min_length`` holds for capture ``group`` (0: the whole match); matches that fail it are dropped."""
    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0


# The base kinds.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a run is taken whole, so runs of 24 and more are the matches that pass
]
#: Further kinds, with unmistakable beginnings.
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]
RULES = BASE + MORE


# --- trigram queries ---------------------------------------------------------

def _strings(items, limit: int = 64) -> set[str] | None:
    """All strings that a part of a pattern matches, lower-cased; None if they are many or unbounded."""
    out = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            more = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            more = {chr(a).lower() for _, a in arg}
        elif name == "SUBPATTERN":
            more = _strings(arg[-1])
        elif name == "BRANCH":
            parts = [_strings(x) for x in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] in (0, 1):
            inner = _strings(arg[2])
            more = None if inner is None else inner | ({""} if arg[0] == 0 else set())
        else:
            more = None
        if more is None or len(out) * len(more) > limit:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Branches of trigram sets: a text with a match holds all trigrams of some branch.  Empty: no such query."""
    segments, run = [], {""}
    for item in [*_parser.parse(pattern), None]:
        found = None if item is None else _strings([item])
        if found is not None and len(run) * len(found) <= 64:
            run = {a + b for a, b in product(run, found)}
            continue
        if min(map(len, run)) >= 3:
            segments.append([frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run])
        run = found or {""}
    if not segments:
        return []
    branches = {frozenset().union(*choice) for choice in product(*segments)}
    return sorted((b for b in branches if not any(c < b for c in branches)), key=sorted)


# --- index -------------------------------------------------------------------

def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id, text_hash) for the given trigrams in the lower-cased texts; one pass, no shuffle."""
    text = text_of()
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("_low"), t))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                        F.lower(text).alias("_low"))
            .select("doc_id", "text_hash", F.explode(held).alias("trigram")))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, text_hash, rules): documents in some rule's intersected postings, rules as a bit mask.

    A branch's trigrams are bits of a word; the OR over a document's postings is complete when all are
    there.  Both groupings combine map-side, and a document's postings come from one partition.
    """
    spark = docs.sparkSession
    terms = [(1 << n, b, t, 1 << i, (1 << len(branch)) - 1)
             for n, rule in enumerate(rules) for b, branch in enumerate(trigram_query(rule.pattern))
             for i, t in enumerate(sorted(branch))]
    wanted = spark.createDataFrame(terms, "rule long, branch int, trigram string, bit long, full long")
    found = cut_lineage(postings(docs, sorted({t for _, _, t, _, _ in terms})))
    hits = (found.join(F.broadcast(wanted), "trigram")  # one row per trigram of the rules
            .groupBy("doc_id", "text_hash", "rule", "branch", "full").agg(F.bit_or("bit").alias("bits"))
            .where(F.col("bits") == F.col("full")))
    return hits.groupBy("doc_id", "text_hash").agg(F.bit_or("rule").alias("rules"))


# --- verification ------------------------------------------------------------

def match_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, finish, kind_no...>> of the rule's matches in one text, leftmost and non-overlapping."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    parts = F.zip_with(F.zip_with(found, gaps, lambda m, g: F.struct(F.length(m).alias("size"), F.length(g).alias("gap"))),
                       checked, lambda x, c: F.struct(x["size"].alias("size"), x["gap"].alias("gap"), F.length(c).alias("checked")))
    parts = F.filter(parts, lambda x: x["size"].isNotNull())  # the last gap has no match
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,finish:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), end.alias("finish"))
        return F.struct(end.alias("at"), F.when(x["checked"] >= rule.min_length, F.array_append(acc["spans"], span))
                        .otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, zero, step, lambda acc: acc["spans"])


def _numbered(spans: Column, n: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind_no"),
                                                 s["finish"].alias("finish"), F.lit(kind).alias("kind")))


def _of_kind(n: int) -> Column:
    return F.filter("_spans", lambda s: s["kind_no"] == n)


def _rule_spans(rules: list[Rule], text: Column, mask: Column) -> Column:
    """All rules' spans of one text, by start, then rule."""
    kinds = "array<struct<start:int,kind_no:int,finish:int,kind:string>>"
    every = []
    for n, rule in enumerate(rules):
        due = text.rlike(rule.pattern)
        if trigram_query(rule.pattern):
            due = mask.bitwiseAND(F.lit(1 << n)).isNotNull() & (mask.bitwiseAND(F.lit(1 << n)) != 0) & due
        every.append(F.when(due, _numbered(match_spans(text, rule), n, rule.kind)).otherwise(F.array().cast(kinds)))
    return F.array_sort(F.concat(*every))


def with_spans(docs: DataFrame, rules: list[Rule] | None = None, keep_columns: bool = True) -> DataFrame:
    """``docs`` (or just doc_id and text) with ``_spans``: every row, whether it holds secrets or not."""
    rules = rules or RULES
    found = candidates(docs, rules).select(F.col("doc_id").alias("_found_id"), F.col("text_hash").alias("_found_hash"), F.col("rules").alias("_rules"))
    cols = docs.columns if keep_columns else ["doc_id", "text"]
    keyed = docs.select(*cols, F.col("doc_id").cast("long").alias("_own_id"), F.xxhash64(text_of()).alias("_own_hash"))
    on = keyed["_own_id"].eqNullSafe(found["_found_id"]) & (keyed["_own_hash"] == found["_found_hash"])
    joined = keyed.join(found, on, "left")
    spans = _rule_spans(rules, text_of(), F.coalesce("_rules", F.lit(0)))
    return joined.select(*cols, spans.alias("_spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["finish"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, matches of each base kind, the base spans' SHA-256 and all spans of every document."""
    rows = with_spans(docs, RULES, keep_columns=False).select("doc_id", "_spans")
    base = F.filter("_spans", lambda s: s["kind_no"] < len(BASE))
    counts = [F.size(_of_kind(n)).cast("long").alias(f"n_{rule.kind}")
              for n, rule in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, rules: list[Rule] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one) and n_chars, if present, following."""
    docs, back = shielded(docs)
    rows = with_spans(docs, rules)
    text = text_of()
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        added = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["finish"]).alias("at"), F.when(apart, added).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("_spans", zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    new = F.when(F.size("_spans") > 0, clean).otherwise(F.col("text"))
    out = rows.withColumn("text", new)
    if "n_chars" in docs.columns:
        length = F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", length.otherwise(F.col("n_chars")))
    return back(out)
