"""Operator 11 against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import ODD_TEXTS, make_docs  # noqa: F401

from tablesmith.llm import lexical

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counts:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in split(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if missing else i, -s) for rank, (s, missing, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed=3, n=900):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "naïve", "中文", "ÀB"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = []
    for i in range(n):
        words = rng.choices(vocabulary, weights, k=int(rng.paretovariate(1.0) * 5) % 3000)
        docs.append((i, rng.choice([" ", "-", "\n", ", "]).join(words)))
    docs += [(n + i, docs[7][1]) for i in range(60)]  # equal scores
    items = [(j, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40)))) for j in range(25)]
    return docs, items + [(90, docs[7][1]), (91, None), (92, "!!"), (93, "nowhere"), (94, "w0 W0 w0"), (94, "w0 W0 w0"), (None, "w3 w9")]


@pytest.fixture
def run(spark, make_docs):  # noqa: F811
    def go(docs, items, **kw):
        found = spark.createDataFrame(items, "item_id long, text string")
        table = make_docs([(i, t, "a") for i, t in docs]).repartition(5)
        return sorted((tuple(r) for r in lexical.search(lexical.build_index(table), found, **kw).collect()), key=repr)
    return go


@pytest.mark.parametrize("part", [1, 3, 1000])
def test_search_equals_brute_force(run, monkeypatch, part):
    """With known scores from all blocks, from a third of them and from none, and items in several blocks."""
    monkeypatch.setattr(lexical, "SEED_PART", part)
    monkeypatch.setattr(lexical, "ITEM_BLOCK", 20)
    docs, items = corpus()
    assert run(docs, items) == brute(docs, items)


def test_small_k_and_odd_rows(run):
    docs = [(i, t) for i, t, _ in ODD_TEXTS]
    items = [(1, "alpha word x we ll"), (2, "words to count anyway"), (3, "")]
    assert run(docs, items) == brute(docs, items)
    assert run(docs, items, k=1) == brute(docs, items, k=1)
    assert run([], items) == [] and run(docs, []) == []


def test_bounds_hold_and_exclude():
    docs, items = corpus(seed=4, n=400)
    blocks = list(lexical._blocks([i for i, _ in docs], [t for _, t in docs]))
    assert sum(b["docs"] for b in blocks) == sum(bool(split(t)) for _, t in docs) and len(blocks) > 3
    group = lexical.Items([(i, t or "") for i, t in items])
    counts = {i: Counter(split(t)) for i, t in docs}
    n_docs, n_terms = sum(map(bool, counts.values())), sum(sum(c.values()) for c in counts.values())
    df = Counter(t.encode() for c in counts.values() for t in c)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in group.number], dtype=np.int64)
    s = lexical.Searcher(group, weight, n_docs, n_terms, 5, np.zeros(len(items), dtype=np.int64))
    for b in blocks:
        b = dict(b)
        m = 75 + 25 * np.frombuffer(b["sizes"], "<i8") * n_docs // n_terms
        bound = s.bounds(b, m)
        for d, i in enumerate(b["doc_ids"]):
            for j, (_, text) in enumerate(items):
                score = sum(int(weight[group.number[t.encode()]]) * int(lexical.added(counts[i][t], int(m[d])))
                            for t in split(text) if t in counts[i])
                assert bound[j, d] >= score
        s.take(b)
    assert 0 < s.scored < 0.7 * s.seen


def test_long_texts_are_counted_in_parts(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(["ab", "Cd", "é1", "中文中文"]) for _ in range(3000))
    whole = Counter(t.encode() for t in split(text))
    monkeypatch.setattr(lexical, "CHUNK_BYTES", 100)
    dictionary, _, term, tf, sizes = lexical._counts([text])
    assert {dictionary[a]: int(n) for a, n in zip(term, tf)} == whole and sizes.tolist() == [3000]
