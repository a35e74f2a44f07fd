"""Operators 2, 7 and 8, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from llm_fixtures import ODD_TEXTS, SMALL, make_docs  # noqa: F401

import corpus_pipeline
from tablesmith.llm import ann, quality_model, registry, toxicity

# --- nearest vectors -----------------------------------------------------------


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, vec string")


def brute_nearest(rows, every, k):
    fine = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 4:
            fine[(i, tuple(np.float32(x) for x in v))] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for (i, key), q in fine.items():
        if i % every == 0:
            found = sorted((-float((q * x).sum()), j) for (j, _), x in fine.items() if j != i)
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def test_exact_on_small_tables_with_copies_ties_and_bad_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(40)] + [(100, [1.0, 1.0, 1.0, 1.0])]
    rows += [(200, None), (205, []), (210, [0.0] * 4), (215, [1.0, None, 1.0, 1.0]), (220, [float("nan")] * 4),
             (225, [float("inf"), 0.0, 0.0, 0.0]), (230, [1.0, 2.0]), (None, [1.0, 2.0, 3.0, 4.0]), (-5, [9.0, 9.0, 9.0, 9.0])]
    got = {}
    for r in ann.nearest(_vectors(spark, rows), every=5, k=7, confidence=0.999999).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute_nearest(rows, 5, 7)
    assert set(got) == set(want)
    for q in want:
        assert [got[q][n] for n in sorted(got[q])] == want[q], q


def test_fewer_candidates_than_asked_and_empty_tables(spark):
    got = ann.nearest(_vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]), every=2, k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 2), (0, 2, 1), (2, 1, 0), (2, 2, 1)]
    assert ann.nearest(_vectors(spark, [])).count() == 0
    assert ann.nearest(_vectors(spark, [(0, [1.0])])).count() == 0


def test_many_blocks_and_units_keep_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 128)
    monkeypatch.setattr(ann, "UNIT_QUERIES", 8)
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((30, 24))
    x = (centers[rng.integers(0, 30, 1500)] + 0.5 * rng.standard_normal((1500, 24))).astype(np.float32)
    got = {}
    for r in ann.nearest(_vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), every=10, k=10).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q in range(0, 1500, 10):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:10].tolist()) & set(got[q]))
    assert len(got) == 150 and hits / 1500 >= 0.9


def test_query_recall_against_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    got = {}
    for r in registry.queries()["op2_nearest_vectors"](spark, SMALL).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    recalls = []
    for k in np.flatnonzero(ids % 20 == 0):
        score = (x * x[k]).sum(axis=1)
        found = sorted(got[ids[k]])
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(f[2] == score[np.flatnonzero(ids == f[1])[0]] for f in found)
        score[k] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        recalls.append(len(best & {f[1] for f in found}) / 20)
    assert np.mean(recalls) >= 0.9


def test_chi_square_quantile():
    draws = np.random.default_rng(1).chisquare(10, 200_000)
    assert (draws <= ann.chi_square_quantile(0.9, 10)).mean() == pytest.approx(0.9, abs=0.005)


# --- classifiers ---------------------------------------------------------------

def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _corpus(n=240):
    rng = random.Random(8)
    syllables = ["an", "er", "on", "th", "re", "st", "ti", "le"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for k in range(0, len(words), 12):
                words[k] = rng.choice(["grobian", "lumpenhund", "scheusal"])
        if not good:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words), "a"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.mark.parametrize("module, column, buckets, held", [(toxicity, "toxic", 3, 1), (quality_model, "quality", 5, 0)])
def test_held_out_documents_are_told_apart(spark, make_docs, module, column, buckets, held):  # noqa: F811
    docs, labels = _corpus()
    extra = [(1000 + k, t, s) for k, (_, t, s) in enumerate(ODD_TEXTS)] + [(None, None, None), (0, docs[0][1], "a")]
    odd = [(None, 1, 1), (5000, None, None), (0, None, None), (0, 0, 0)]
    got = module.predictions(make_docs(docs + extra), _labels(spark, labels + odd)).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r.score <= 1 for r in got)
    cut = 0.7 if column == "toxic" else 0.3
    assert all(r.predicted == int(r.score >= cut) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % buckets == held) for r in got if r.doc_id is not None)
    truth = {i: (q, x)[column == "toxic"] for i, q, x in labels}
    hits = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(hits) > 20 and np.mean(hits) >= 0.95


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_held_out_labels_are_never_read(spark, make_docs, module):  # noqa: F811
    docs, labels = _corpus(120)
    buckets, held = (3, 1) if module is toxicity else (5, 0)
    flipped = [(i, 1 - q, 1 - x) if zlib.crc32(str(i).encode()) % buckets == held else (i, q, x) for i, q, x in labels]
    a, b = (sorted((r.doc_id, r.score) for r in module.predictions(make_docs(docs), _labels(spark, x)).collect())
            for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_without_labels_of_both_kinds(spark, make_docs, module):  # noqa: F811
    docs = make_docs(ODD_TEXTS)
    assert {r.score for r in module.predictions(docs, _labels(spark, [])).collect()} == {0.5}
    only = _labels(spark, [(i, 1, 1) for i in range(1, 10)])
    assert {r.score for r in module.predictions(docs, only).collect()} == {1.0}
    assert module.predictions(docs.limit(0), only).count() == 0


def test_trees_walk_like_single_rows():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    trees = quality_model.grow(x, y, np.ones(400), rounds=20, depth=3)

    def walk(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            i = 0
            while i < len(f):
                i = 2 * i + (2 if row[f[i]] > t[i] else 1)
            total += leaf[i - len(f)]
        return total
    assert trees.raw(x[:50]) == pytest.approx([walk(r) for r in x[:50]])
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.97


# --- pipeline --------------------------------------------------------------------

def test_stages_keep_what_they_should(spark, make_docs):  # noqa: F811
    plain = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix several jars of ink".split()
    rng = random.Random(1)
    rows = [(300 + i, " ".join(rng.sample(plain, len(plain))) + f" number{i}", "ab"[i % 2]) for i in range(30)]
    rows += [(400 + i, rows[0][1], "a") for i in range(5)] + [(200, "too short", "a"), (201, "same " * 40, "a")]
    rows += [(202, " ".join(plain) + " password=abcdef1234", "b")] + ODD_TEXTS
    docs, seen = make_docs(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "")
        if name != "byte_bpe":
            assert docs.columns == before.columns
        seen[name] = docs.cache().collect()
    ids = {k: [r.doc_id for r in v] for k, v in seen.items()}
    assert not {200, 201, 2, 3} & set(ids["quality_rules"]) and set(range(300, 330)) <= set(ids["quality_rules"])
    assert not set(range(400, 405)) & set(ids["simhash_near_dedup"]) and set(range(300, 330)) <= set(ids["simhash_near_dedup"])
    assert ids["simhash_near_dedup"].count(1) == 1
    assert all("abcdef1234" not in r.text for r in seen["secret_scan"]) and len(seen["secret_scan"]) == len(seen["simhash_near_dedup"])
    assert sorted(ids["byte_bpe"], key=repr) == sorted(ids["mix_sources"], key=repr)


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect())) and got.count() > 50
