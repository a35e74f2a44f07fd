"""The pipeline's rows against a plain-Python version of its five stages."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers as P
from llm_fixtures import ODD_TEXTS, SMALL, make_docs  # noqa: F401
from test_mixing import source_plan
from test_native_operators import ASSIGN, brute_quality
from test_simhash import brute_groups, brute_print

import corpus_pipeline
from tablesmith.llm import mixing, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality_kept(text):
    n_words, chars, symbols, _, _, failed = brute_quality(text)
    text = text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    upper, letters = (sum(map(f, text)) for f in (lambda c: c.isupper() and c.lower() != c, str.isalpha))
    return not (failed or 10 * symbols > n_words or 2 * upper > letters or len(lines) < 2 * (len(lines) - len(set(lines)))
                or chars < 2 * n_words or chars > 20 * n_words)


def one_of_each(rows):
    """The first row, by id (missing last), of each group within four bits."""
    prints = [brute_print(t) for _, t, _ in rows]
    groups = brute_groups(list(range(len(rows))), prints)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    return [rows[i] for i in sorted({groups[i]: i for i in reversed(order)}.values())]


def redacted(text):
    if text is None:
        return None
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    for rule in secrets.MORE:
        spans += [m.span() for m in re.finditer(rule.pattern, text)]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mixed(rows, block=mixing.BLOCK_WORDS):
    """Rows as the mix takes them: documents in hashed order, slots one after the other, pass by pass."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    plan = source_plan(list(total.items()), block=block)

    def key(i):
        doc_id, text, _ = rows[i]
        inner = hashlib.md5((text or "").encode()).hexdigest()
        return int(hashlib.md5(f"mix|{'' if doc_id is None else doc_id}|{inner}".encode()).hexdigest()[:15], 16)
    slots = defaultdict(int)
    for i in range(plan.length):
        x = int(f"{i:0{mixing.BITS}b}"[::-1], 2)
        slots[int(np.searchsorted(np.array(plan.bounds, dtype=np.int64), x, side="right")) - 1] += 1
    out = []
    for no, name in enumerate(plan.names):
        docs = sorted((i for i in range(len(rows)) if rows[i][2] == name), key=lambda i: (key(i), rows[i][0] or 0, size[i]))
        starts, at = {}, 0
        for i in docs:
            starts[i] = at
            at += size[i]
        taken = defaultdict(int)  # (document, pass) -> words taken of it
        n = plan.sizes[no]
        for rank in range(plan.slots[no]):  # what the schedule left short follows, so all ranks are there
            blocks = max(1, -(-n // block))
            turn, b = divmod(rank, blocks)
            limit = plan.words[no] % n if turn == plan.words[no] // n else n
            lo, hi = b * block, min(b * block + block, limit)
            for i in docs:
                a, z = max(lo, starts[i]), min(hi, starts[i] + size[i])
                if a < z:
                    taken[i, turn] = max(taken[i, turn], z - starts[i])
        out += [rows[i] for (i, _), upto in taken.items() if 2 * upto >= size[i]]
    return out


@pytest.fixture(scope="module")
def library():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute_pipeline(rows, library):
    rows = [r for r in rows if quality_kept(r[1])]
    rows = [(i, redacted(t), s) for i, t, s in one_of_each(rows)]
    out = []
    for i, t, _ in mixed(rows):
        ids = library.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def planted(seed=21, n=70):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "krtlmnsv" for b in ("ando", "elic", "imus", "orta", "uven", "ys", "are")]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(12, 400))]
        if i % 9 == 0:
            words[5] = "password=hunter2hunter2"
        text = "\n".join(" ".join(words[k:k + 11]) for k in range(0, len(words), 11))
        rows.append((1000 + 10 * i, text, "abcd"[i % 4] if i % 5 else None))
        if i % 3 == 0:
            rows.append((1001 + 10 * i, text, "c"))  # an exact copy
        if i % 4 == 0:
            rows.append((1002 + 10 * i, text.upper().replace("A", "a", 3), "d"))  # the same words, shouted: fails the rules
        if i % 7 == 0:
            other = list(words)
            other[len(other) // 2] = "changed"
            rows.append((1003 + 10 * i, " ".join(other), "a"))  # a near copy
    rows += [(3, "too short", "a"), (4, "spam " * 60, "b"), (5, "### $$$ " * 30, "b"),
             (6, " ".join(rng.choice(vocabulary) for _ in range(6000)), "a")]  # a long one
    return rows


def stages_run(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    return sorted(map(tuple, docs.collect()), key=repr)


def test_stages_equal_plain_python(spark, make_docs, library):  # noqa: F811
    rows = planted() + [(i, t, s) for i, t, s in ODD_TEXTS if i is not None]
    want = brute_pipeline(rows, library)
    got = stages_run(spark, make_docs(rows))
    assert got == want and 40 < len(got)
    assert 3 not in {r[0] for r in got} and 1001 not in {r[0] for r in got}


def test_run_equals_plain_python(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect()), key=repr)
    assert got == brute_pipeline([(d.doc_id, d.text, d.source) for d in docs], library)
    assert zlib.crc32(repr(got).encode()) and len(got) > 50


def test_empty_table(spark, make_docs):  # noqa: F811
    assert stages_run(spark, make_docs(ODD_TEXTS).limit(0)) == []
