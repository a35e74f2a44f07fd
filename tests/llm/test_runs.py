"""Operator 12 against the definition of a run."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from llm_fixtures import ODD_TEXTS, SMALL, make_docs  # noqa: F401

from tablesmith.llm import registry, runs


def brute_runs(words):
    """Every maximal stretch by its definition, period by period."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            size = j + p - i
            if size >= max(6, 4 * p):
                found.setdefault((i, size), p)  # periods ascend: the smallest stays
            i = j
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    dropped = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in
              ("".join(f"{s},{m},{p}\n" for s, m, p in found), " ".join(x for i, x in enumerate(w) if i not in dropped))]
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], *digest)


def texts_of_many_kinds(rng, count):
    out = []
    for _ in range(count):
        kind, n = rng.randrange(6), rng.randint(0, 120)
        if kind == 0:
            out.append([rng.choice("ab") for _ in range(n)])
        elif kind == 1:
            out.append([rng.choice("abcdefghij") for _ in range(n)])
        elif kind == 2:
            out.append(["x"] * n)
        else:
            words = []
            while len(words) < n:
                unit = [rng.choice("abc" if kind == 3 else "abcdefgh") for _ in range(rng.randint(1, 9))]
                size = rng.randint(len(unit), 7 * len(unit))
                words += (unit * 8)[:size]
            out.append(words)
    return [[w.encode() for w in t] for t in out]


@pytest.mark.parametrize("held", [1, runs.GRID_PAIRS])
def test_runs_equal_brute_force(held, monkeypatch):
    monkeypatch.setattr(runs, "GRID_PAIRS", held)
    rng = random.Random(12)
    for _ in range(60):
        texts = texts_of_many_kinds(rng, rng.randint(1, 40))
        assert runs.runs_of(texts) == [brute_runs(t) for t in texts]


def test_extensions_equal_brute_force():
    rng = np.random.default_rng(4)
    for size, letters in ((1, 1), (2, 1), (50, 1), (300, 2), (300, 3), (500, 20), (64, 2)):
        s = rng.integers(0, letters, size).astype(np.int32)
        if size > 100:  # long repeats
            s[size // 2:size // 2 + size // 3] = s[:size // 3]
        levels = runs.grammar(s)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(-1, size), np.arange(-1, size + 1)))
        a, b = a[a < b], b[a < b]
        for forward in (True, False):
            step = 1 if forward else -1
            want = []
            for x, y in zip(a.tolist(), b.tolist()):
                n = 0
                while x >= 0 and y < size and (y >= 0) and s[x] == s[y]:
                    n, x, y = n + 1, x + step, y + step
                want.append(n)
            assert runs.extensions(levels, a, b, forward).tolist() == want, (size, letters, forward)


def test_the_grammar_spells_its_text():
    s = np.random.default_rng(5).integers(0, 3, 400).astype(np.int32)
    levels = runs.grammar(s)
    assert len(levels) > 5

    def spell(no, at):
        level = levels[no]
        if no == 0:
            return [level.symbol[at]]
        return [x for c in range(level.first[at], level.last[at] + 1) for x in spell(no - 1, c)]
    for no in (1, 3, len(levels) - 1):
        whole = [x for at in range(len(levels[no].symbol)) for x in spell(no, at)]
        assert whole == s.tolist() and levels[no].width.sum() == 400


def test_long_texts():
    unit = [b"w%d" % i for i in range(5000)]
    assert runs.runs_of([unit * 4, unit * 3, unit * 5 + unit[:7]]) == [[(0, 20000, 5000)], [], [(0, 25007, 5000)]]
    assert runs.runs_of([[b"same"] * 100_000]) == [[(0, 100_000, 1)]]
    rng = random.Random(6)
    noise = [b"%d" % rng.randrange(10 ** 6) for _ in range(60_000)]
    assert runs.runs_of([noise[:30_000] + noise[:40] * 9 + noise[30_000:]]) == [[(30_000, 360, 40)]]


def test_digests_of_odd_rows(spark, make_docs):  # noqa: F811
    rng = random.Random(7)
    rows = ODD_TEXTS + [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60))), "a") for i in range(-100, 200)]
    got = sorted(map(tuple, runs.run_digests(make_docs(rows)).collect()), key=repr)
    assert got == sorted((brute_row(i, t) for i, t, _ in rows), key=repr)
    assert runs.run_digests(make_docs(rows).limit(0)).count() == 0


def test_operator_gives_runs_and_texts(spark, make_docs):  # noqa: F811
    got = {r.doc_id: r for r in runs.periodic_runs(make_docs([(5, "a b " * 4 + "c", "a"), (6, None, "a")])).collect()}
    assert [tuple(x) for x in got[5].runs] == [(0, 8, 2)] and got[5].collapsed == "a b c" and got[5].exponent_milli == 4000
    assert got[6].runs == [] and got[6].start is None and got[6].collapsed == "" and got[6].n_runs == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    docs = [d for d in docs if len(d.text or "") < 12_000]
    got = {r.doc_id: tuple(r) for r in registry.queries()["op12_periodic_runs"](spark, SMALL).collect()}
    assert [got[d.doc_id] for d in docs] == [brute_row(d.doc_id, d.text) for d in docs]
