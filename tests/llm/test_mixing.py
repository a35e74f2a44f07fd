"""Operator 1: targets, the schedule's closed counts, and the mix itself."""

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_fixtures import ODD_TEXTS, SMALL, make_docs  # noqa: F401

from tablesmith.llm import mixing


# --- the plan of the sources, one after the other, in plain Python -----------------

@dataclass
class SourcePlan:
    """Per source, in order: name, size in words, target, words to take, slots needed; and the schedule."""
    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    words: list[int]
    slots: list[int]
    bounds: list[int]
    length: int
    block: int


def water_fill(sizes: list[int], weights: list[int], cap: int, total: int) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; exact until the last division."""
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    money, weight = total, sum(weights)
    for i in order:  # the tightest caps first
        if cap * sizes[i] * weight > weights[i] * money:
            break
        money -= cap * sizes[i]
        weight -= weights[i]
    return [float(cap * s) if not weight or cap * s * weight <= w * money else w * money / weight
            for s, w in zip(sizes, weights)]


def source_plan(rows: list[tuple[str | None, int]], weights=mixing.WEIGHTS, max_repeat=mixing.MAX_REPEAT,
                block=mixing.BLOCK_WORDS) -> SourcePlan:
    """Targets and schedule of sources given as (name, size)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(n or 0) for _, n in rows]
    own = [weights[i % len(weights)] for i in range(len(rows))]
    targets = water_fill(sizes, own, max_repeat, sum(sizes))
    words = [int(t + 0.5) for t in targets]
    slots = [n // s * -(-s // block) + -(-(n % s) // block) if s else 0 for n, s in zip(words, sizes)]
    length = sum(slots)
    assert length < 1 << mixing.BITS
    bounds = [0]
    for n in np.cumsum(slots, dtype=object).tolist() if slots else []:
        bounds.append((n << mixing.BITS) // length if length else 0)
    return SourcePlan([n for n, _ in rows], sizes, targets, words, slots, bounds, length, block)


def brute_fill(sizes, weights, cap, total):
    share, left = [0.0] * len(sizes), set(range(len(sizes)))
    money = float(total)
    while left:
        w = sum(weights[i] for i in left)
        over = [i for i in left if weights[i] * money / w > cap * sizes[i]]
        if not over:
            for i in left:
                share[i] = weights[i] * money / w
            break
        for i in over:
            share[i] = cap * sizes[i]
            money -= share[i]
            left.discard(i)
    return share


@pytest.mark.parametrize("sizes", [[100], [10, 1000, 10], [0, 5, 5, 5], [1, 1, 1, 10_000], [0, 0], [7] * 9, []])
def test_targets_share_everything_under_the_cap(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    got = water_fill(sizes, weights, 3, sum(sizes))
    assert got == pytest.approx(brute_fill(sizes, weights, 3, sum(sizes)))
    assert sum(got) == pytest.approx(sum(sizes))
    assert all(g <= 3 * s + 1e-9 for g, s in zip(got, sizes))


def test_points_below_is_a_count():
    rng = np.random.default_rng(2)
    points = mixing.reverse_bits(np.arange(300, dtype=np.int64))
    for x in rng.integers(0, 1 << mixing.BITS, 40):
        for n in rng.integers(0, 300, 5):
            assert mixing.points_below(np.array([n]), np.array([x]))[0] == (points[:n] < x).sum()


def source_rows(spark, sources):
    return spark.createDataFrame(sources, "_source string, _size long")


@pytest.mark.parametrize("sizes", [[100], [10, 1000, 10], [0, 5, 5, 5], [1, 1, 1, 10_000], [0, 0], [7] * 9, [], [3, 10 ** 15, 10 ** 9, 1, 8],
                                   list(range(200)), [10 ** (i % 7) for i in range(150)]])
def test_plan_on_spark_equals_plain_python(spark, sizes):
    names = [None if i == 3 else f"s{i * 7919 % 1000}é" if i % 2 else f"S{i}😀" for i in range(len(sizes))]
    want = source_plan(list(zip(names, sizes)), block=16 + 10 ** 9 * (max(sizes, default=0) > 10 ** 14))
    halves = [(n, s - s // 2) for n, s in zip(names, sizes)] + [(n, s // 2) for n, s in zip(names, sizes)]
    plan = mixing.plan_sources(source_rows(spark, halves), block=want.block)
    rows = plan.table.orderBy("source_no").collect()
    assert [r.source_no for r in rows] == list(range(len(sizes))) and plan.length == want.length
    assert [(r._name, r.source_size, r.target, r.words, r.need) for r in rows] == list(
        zip(want.names, want.sizes, want.targets, want.words, want.slots))
    if plan.length:
        assert [r.lo for r in rows] + [rows[-1].hi] == want.bounds


def test_two_hundred_thousand_sources(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("host"), F.col("id")).alias("_source"), (F.col("id") % 50 + 1).alias("_size"))
    plan = mixing.plan_sources(rows)
    assert plan.table.count() == 200_000
    got = mixing.schedule(plan).groupBy("source_no").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
    off = plan.table.where("words > 0").join(got, "source_no", "left").where(F.coalesce("n", F.lit(0)) != F.col("words")).count()
    assert off == 0 and plan.table.agg(F.sum("words")).first()[0] == pytest.approx(200_000 * 25.5, rel=0.02)


def test_schedule_gives_each_source_its_words_evenly(spark):
    sources = [("a", 5000), ("b", 40), (None, 3000), ("z", 0), ("c", 900)]
    plan = source_plan(sources, block=16)
    rows = mixing.schedule(mixing.plan_sources(source_rows(spark, sources), block=16)).orderBy("slot").collect()
    words = defaultdict(int)
    for r in rows:
        words[r.source_no] += r.hi - r.lo
    assert [words[i] for i in range(5)] == plan.words
    assert plan.names == ["a", "b", "c", "z", None]
    for i, need in enumerate(plan.slots):  # any stretch of the schedule holds a source's share, nearly
        at = np.array([k for k, r in enumerate(rows) if r.source_no == i])
        for cut in range(0, len(rows), 37):
            assert abs((at < cut).sum() - need * cut / len(rows)) < 8


def test_taken_words_equal_the_segments(spark, make_docs):  # noqa: F811
    rows = [(i, f"w{i} " * (1 + i % 7), "abc"[i % 3]) for i in range(60)] + ODD_TEXTS
    docs = make_docs(rows)
    got = mixing.mix_counts(docs, block=4).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted(
        (i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows if i is not None)
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) == pytest.approx(sum(size.values()), abs=len(size))
    texts = mixing.mix_texts(docs, block=4)
    assert texts.columns == docs.columns
    taken, mixed = defaultdict(int), defaultdict(int)
    for r in got:
        taken[r.doc_id] += r.taken
    for r in texts.collect():
        mixed[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert mixed == {k: v for k, v in taken.items() if v}


def test_stage_takes_whole_documents_near_the_target(spark, make_docs):  # noqa: F811
    """Line breaks stay, and each source misses its target by at most half a document (40 words)."""
    import corpus_pipeline
    rows = [(i, "\n".join(f"w{i} x{k}" for k in range(5 + i % 16)), "abcd"[i % 4]) for i in range(90)]
    texts, size, words = {i: t for i, t, _ in rows}, defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    got = dict(corpus_pipeline.STAGES)["mix_sources"](spark, make_docs(rows), "").collect()
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in got)
    for r in got:
        words[r.source] += len(r.text.split())
    plan = source_plan(list(size.items()))
    assert all(abs(words[s] - n) <= 20 for s, n in zip(plan.names, plan.words))
    assert any(words[s] != n for s, n in zip(plan.names, plan.words))


def test_reruns_and_layout_change_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = sorted(map(tuple, mixing.mix_counts(docs).collect()))
    assert first == sorted(map(tuple, mixing.mix_counts(docs.repartition(7, "text")).collect()))


def test_empty_table(spark, make_docs):  # noqa: F811
    none = make_docs(ODD_TEXTS).limit(0)
    assert mixing.mix_counts(none).count() == 0 and mixing.mix_texts(none).count() == 0
