"""Operator 6 against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from llm_fixtures import ODD_TEXTS, SMALL, make_docs  # noqa: F401

from tablesmith.llm import registry, simhash


def brute_print(text, width=4):
    import xxhash
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(ids, prints, radius=4):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(ids))]
    least = {r: min((ids[i] for i in range(len(ids)) if roots[i] == r and ids[i] is not None), default=None) for r in roots}
    return [least[r] for r in roots]


def test_fingerprint_is_the_majority_of_shingles():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 6, 50):
        text = " ".join(rng.choice(["A", "bé", "c", "D"]) for _ in range(n)) + "\n"
        assert simhash.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_every_pair_within_the_radius_shares_a_table(radius):
    rng = random.Random(radius)
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), radius):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def _points(spark, values):
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    return spark.createDataFrame(signed, "fp long")


@pytest.mark.parametrize("block", [8, 2048])
def test_components_of_clusters_equal_brute_force(spark, block):
    """A dense cluster, a chain, pairs at distance 4 and 5, and noise; with small blocks the buckets are taken apart."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base} | {base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    chain = rng.getrandbits(64)
    for k in range(0, 60, 4):
        chain ^= 0b1111 << k
        values.add(chain)
    for d in (4, 5):
        x = rng.getrandbits(64)
        values |= {x, x ^ ((1 << d) - 1) << 20}
    values |= {0, 0b111} | {rng.getrandbits(64) for _ in range(50)}
    values = sorted(values)
    points = _points(spark, values)
    found = {r.node: r.root for r in simhash.components(simhash.links(points, 4, block)).collect()}
    label = [found.get(x, x) for (x,) in (tuple(r) for r in _points(spark, values).collect())]
    want = brute_groups(list(range(len(values))), values)
    assert len(set(label)) == len(set(want))
    assert len({*zip(label, want)}) == len(set(want))


def test_odd_rows(spark, make_docs):  # noqa: F811
    got = simhash.near_duplicates(make_docs(ODD_TEXTS))
    rows = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got.collect()), key=repr)
    prints = [brute_print(t) for _, t, _ in ODD_TEXTS]
    ids = [i for i, _, _ in ODD_TEXTS]
    assert rows == sorted(zip(ids, prints, brute_groups(ids, prints)), key=repr)
    assert simhash.near_duplicates(make_docs(ODD_TEXTS).limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark, make_docs):  # noqa: F811
    docs = make_docs(ODD_TEXTS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = [brute_print(t) for _, t, _ in ODD_TEXTS]
    assert kept.count() == len(set(brute_groups(list(range(len(prints))), prints)))
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [1, 2, 5, 6, 7, 8, 9]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_print(d.text) for d in docs]
    groups = brute_groups([d.doc_id for d in docs], prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.queries()["op6_simhash_groups"](spark, SMALL).collect()}
    assert got == {d.doc_id: (f"{p:016x}", g) for d, p, g in zip(docs, prints, groups)}
