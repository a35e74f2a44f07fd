"""Quality rules as a short-circuit cascade (operator 3), in DataFrame functions only.

Each rule is one Boolean expression that is true when the document should go: over the text, or
over the statistics that a judgement reports of every document.  ``order_rules`` runs every rule, in the
form that will be used, over a small sample, takes its time (cost) and the share it
rejects (selectivity), and orders the rules by rejections per cost.  ``verdict`` is a CASE over
the rules in that order: a document leaves at its first failing rule and the dearer ones are never evaluated.
The order changes the time only, never the verdict, so the sample may be small.

Rules for odd input: a null text is empty (and fails ``too_short``); repeated rows and null ids
are judged row by row; no shuffle, nothing is collected but the sample's timings.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.base import SPACE_CLASS, WORD, text_of

#: Documents of the sample that orders the rules, and the longest text it takes (bounds the driver's memory).
SAMPLE_DOCS = 200
SAMPLE_CHARS = 20_000
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, as one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- statistics --------------------------------------------------------------

def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def characters(text: Column, kind: str) -> Column:
    """Characters of a class: what the text loses without their runs (no match is ever built)."""
    return F.length(text) - F.length(F.regexp_replace(text, kind + "+", ""))


def symbols(text: Column) -> Column:
    return characters(text, "[#*$%&|<>]")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def equal_lines(lines: Column) -> Column:
    return F.size(lines) - F.size(F.array_distinct(lines))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_of(text), equal_lines)


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of five words, in order (none if there are fewer words)."""
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= WINDOW, let(hashed, windows)).otherwise(F.array().cast("array<bigint>"))


def covered_words(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more, each word once.

    Windows are sorted by hash, so equal ones are neighbours; their positions, sorted again, are swept once.
    """
    def repeated(pairs: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before, after = F.get(pairs, i - 1)["h"], F.get(pairs, i + 1)["h"]
            return before.eqNullSafe(x["h"]) | after.eqNullSafe(x["h"])
        return F.sort_array(F.transform(F.filter(pairs, twin), lambda x: x["p"]))

    def sweep(places: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

        def step(acc: Column, p: Column) -> Column:
            return F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"))
        return F.aggregate(places, zero, step, lambda acc: acc["n"])

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    found = let(let(pairs, repeated), sweep)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(found)


def repeated_words(text: Column) -> Column:
    return let(let(words_of(text), window_hashes), covered_words)


# --- rules -------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """``rejects`` takes the text; ``judged`` says the same over the columns of ``with_statistics``."""
    name: str
    rejects: Callable[[Column], Column]
    judged: Column


def _default_rules() -> list[Rule]:
    def count(text: Column) -> Column:
        return F.regexp_count(text, F.lit(WORD))

    def chars(text: Column) -> Column:
        return F.length(text) - characters(text, SPACE_CLASS)

    def many_repeats(text: Column) -> Column:
        return let(words_of(text), lambda w: 100 * let(window_hashes(w), covered_words) > 20 * F.size(w))

    def odd_length(n_chars: Column, n_words: Column) -> Column:
        return (n_chars < 2 * n_words) | (n_chars > 20 * n_words)

    def shouting(text: Column) -> Column:
        return 2 * characters(text, r"\p{Lu}") > characters(text, r"\p{L}")

    def lines(text: Column) -> Column:
        return F.size(lines_of(text))

    return [
        Rule("too_short", lambda t: count(t) < 10, F.col("n_words") < 10),
        Rule("repeats", many_repeats, 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        Rule("symbols", lambda t: 10 * symbols(t) > count(t), 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("shouting", shouting, 2 * F.col("n_upper") > F.col("n_letters")),
        Rule("duplicate_lines", lambda t: lines(t) < 2 * duplicate_lines(t), F.col("n_lines") < 2 * F.col("n_dup_lines")),
        Rule("word_length", lambda t: odd_length(chars(t), count(t)), odd_length(F.col("word_chars"), F.col("n_words"))),
    ]


# --- the cascade -------------------------------------------------------------

@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        """Share rejected per second over the sample; a rule that rejects nothing there comes last."""
        return self.rejected / max(self.seconds, 1e-6)


def sample_texts(docs: DataFrame, size: int = SAMPLE_DOCS) -> DataFrame:
    """Some texts, spread by hash; read from as few partitions as give enough."""
    texts = docs.select(text_of().alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).take(size) or texts.take(size)
    found = docs.sparkSession.createDataFrame([(r["text"],) for r in rows], "text string")
    return found


def order_rules(docs: DataFrame, rules: list[Rule] | None = None, size: int = SAMPLE_DOCS, judged: bool = False) -> list[Measured]:
    """The rules by rejections per cost on a sample, best first; ``judged``: in the form that has the statistics."""
    rules = rules or _default_rules()
    sample = sample_texts(docs, size).coalesce(1)
    if judged:
        rows = with_statistics(sample.select(F.lit(0).alias("doc_id"), "text"))
        sample = docs.sparkSession.createDataFrame(rows.collect(), rows.schema).coalesce(1)
    found = []

    def seconds(condition: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            share = sample.agg(F.avg(condition.cast("double"))).first()[0] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, share

    idle, _ = seconds((F.col("n_words") if judged else F.length("text")) < 0)
    for rule in rules:
        took, share = seconds(rule.judged if judged else rule.rejects(F.col("text")))
        found.append(Measured(rule, max(took - idle, 1e-4), share))
    return sorted(found, key=lambda m: (-m.gain, m.seconds))


def verdict(rules: list[Rule], text: Column | None = None) -> Column:
    """False at the first rule that rejects; over the text, or over the statistics if none is given."""
    case = None
    for rule in rules:
        condition = rule.judged if text is None else rule.rejects(text)
        case = F.when(condition, False) if case is None else case.when(condition, False)
    return case.otherwise(True)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and all statistics of each document; words and lines are split once."""
    text = F.col("_text")
    rows = docs.select("doc_id", text_of().alias("_text")).select(
        "doc_id", words_of(text).alias("_words"), lines_of(text).alias("_lines"), symbols(text).cast("long").alias("n_symbols"),
        characters(text, r"\p{Lu}").cast("long").alias("n_upper"), characters(text, r"\p{L}").cast("long").alias("n_letters"))
    return rows.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), "n_symbols",
        equal_lines(F.col("_lines")).cast("long").alias("n_dup_lines"),
        let(window_hashes(F.col("_words")), covered_words).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"), "n_upper", "n_letters")


def judge(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """All statistics, base_failed and kept of every document.

    A document that fails the base is done; the others meet the rules in their measured order.  Every statistic
    is a result, so none is left out for a document that goes early (``passing`` does that).
    """
    ordered = [m.rule for m in order_rules(docs, rules, judged=True)]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return with_statistics(docs).withColumn("base_failed", base).withColumn(
        "kept", F.when(F.col("base_failed"), False).otherwise(verdict(ordered)))


def passing(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The documents that pass every rule, with all their columns; short-circuit over the text."""
    ordered = [m.rule for m in order_rules(docs, rules)]
    return docs.where(verdict(ordered, text_of()))
