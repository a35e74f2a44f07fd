"""Operator 13 against the public library."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers as P
from llm_fixtures import ODD_TEXTS, SMALL, make_docs  # noqa: F401

from tablesmith.llm import pieces, registry

MODEL = P.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "the", "ing", "er", " ", "  ", "\n", "\t", "é", "中", "文", "😀", "\0", "▁", "1", "23", ".", "xx", "▁▁▁",
            "\r", "e", "s", "t", "th", "An", "ON", "-", "----", "    ", "</s>", "<0x0A>", "\x85", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return pieces.codec(pieces.read_model(MODEL))


def test_any_text_encodes_like_the_library(library, codec):
    rng = random.Random(13)
    for _ in range(3000):
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 3))]
        assert [x.tolist() for x in codec.encode(texts)] == library.encode(texts, add_eos=True), texts


def test_any_ids_decode_like_the_library(library, codec):
    rng = random.Random(14)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(262) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, "<u4")).decode() == library.decode(ids), ids


def test_pairs_are_compatible_when_merging_leaves_them(codec):
    rng, m = random.Random(15), codec.merges
    some = m.reached[:2000] + [p for p in m.reached if set(p) == {" "}] * 20
    for _ in range(20_000):
        u, t = rng.choice(some), rng.choice(some)
        assert m.compatible(u, t) == (m.merged(u + t) == [u, t]), (u, t)


def test_ranks_that_run_against_their_parts():
    """A vocabulary whose longer tokens rank before their parts, by brute force over all short texts."""
    rng = random.Random(16)
    for _ in range(30):
        words = {"".join(rng.choice("ab ") for _ in range(rng.randint(2, 5))) for _ in range(8)} | {"a", "b", " "}
        merges = pieces.Merges({w: -float(rng.randrange(6)) for w in words})
        for _ in range(200):
            u, t = rng.choice(merges.reached), rng.choice(merges.reached)
            assert merges.compatible(u, t) == (merges.merged(u + t) == [u, t]), (merges.ranks, u, t)


def test_long_texts_and_parts(library, codec):
    rng = random.Random(17)
    text = "".join(rng.choice(ALPHABET) for _ in range(20_000))
    want = library.encode(text, add_eos=True)
    for limit in (1, 50, 4096, 1 << 20):
        assert codec.encode_long(text, limit).tolist() == want
    for text in ("x" * 60_000, " " * 5000, "中文字" * 9000):
        ids = codec.encode([text])[0]
        assert ids.tolist() == library.encode(text, add_eos=True) and codec.decode(ids).decode() == text


def test_small_cache_changes_nothing(codec):
    small = pieces.Codec(pieces.read_model(MODEL))
    small.cache.limit = 4
    for t in ["the cat sat on the mat"] * 3 + ["another text entirely"]:
        assert small.encode([t])[0].tolist() == codec.encode([t])[0].tolist()


def _want(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_round_trip_of_odd_rows(spark, make_docs, library):  # noqa: F811
    got = sorted(map(tuple, pieces.round_trip(make_docs(ODD_TEXTS), MODEL).collect()), key=repr)
    assert got == sorted(((i, *_want(library, t)) for i, t, _ in ODD_TEXTS), key=repr)
    assert pieces.round_trip(make_docs(ODD_TEXTS).limit(0), MODEL).count() == 0


def test_ids_and_texts_as_tables(spark, make_docs, library):  # noqa: F811
    ids = pieces.encode(make_docs(ODD_TEXTS), MODEL, keep=["doc_id"])
    rows = pieces.decode(ids.withColumn("more", ids.ids), MODEL, keep=["doc_id", "more"]).collect()
    assert sorted(((r.doc_id, np.frombuffer(r.more, "<u4").tolist(), r.decoded) for r in rows), key=repr) == sorted(
        ((i, x := library.encode(t or "", add_eos=True), library.decode(x)) for i, t, _ in ODD_TEXTS), key=repr)


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = sorted(map(tuple, registry.queries()["op13_piece_bpe"](spark, SMALL).collect()))
    assert got == sorted((d.doc_id, *_want(library, d.text)) for d in docs)
