"""Operators 5 and 10 against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from llm_fixtures import ODD_TEXTS, SMALL, make_docs  # noqa: F401

from tablesmith.llm import bpe, registry, token_files

RANKS, CONFIG = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ALPHABET = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "!", "#", "　", " ",
            "中", "😀", "\0", "'S", "x'", "\x1c", "\x85", "ʼ", "²"]


@pytest.fixture(scope="module")
def library():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(open(RANKS, "rb").read())


def test_any_mix_of_classes_splits_and_merges_like_the_library(library, codec):
    rng = random.Random(5)
    for _ in range(600):
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 5))]
        got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
        assert got == [library.encode_ordinary(t) for t in texts], texts


def test_long_pieces_and_parts(library, codec):
    rng = random.Random(6)
    word = "".join(rng.choice("abcde") for _ in range(3000))
    assert np.frombuffer(codec.encode([word])[0], "<u4").tolist() == library.encode_ordinary(word)
    text = " ".join("".join(rng.choice(ALPHABET) for _ in range(9)) for _ in range(400))
    for limit in (1, 7, 100):
        parts = bpe.safe_parts(text, limit)
        assert "".join(parts) == text
        assert b"".join(codec.encode([p])[0] for p in parts) == codec.encode([text])[0]


def test_offsets_lead_back_to_the_bytes(codec):
    text = "héllo 中文 😀 it's"
    ids = codec.encode([text])[0]
    assert codec.decode(ids, codec.offsets(ids), step=3) == text.encode()


def test_small_cache_changes_nothing(codec):
    small = bpe.Codec(open(RANKS, "rb").read())
    small.cache.limit = 4
    texts = ["the cat sat on the mat"] * 3 + ["another text entirely"]
    assert [small.encode([t])[0] for t in texts] == [codec.encode([t])[0] for t in texts]


def test_round_trip_of_odd_rows(spark, make_docs, library):
    got = sorted(map(tuple, bpe.round_trip(make_docs(ODD_TEXTS), RANKS).collect()), key=repr)
    want = []
    for i, t, _ in ODD_TEXTS:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(make_docs(ODD_TEXTS).limit(0), RANKS).count() == 0


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_planes_round_trip(bits, dtype):
    ids = np.random.default_rng(1).integers(0, 50_000, 1003).astype(dtype)
    planes = token_files.to_planes(ids, bits)
    assert len(planes) == np.dtype(dtype).itemsize * (8 if bits else 1)
    assert (token_files.from_planes(planes, len(ids), dtype, bits) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_hold_every_document_in_order(spark, make_docs, tmp_path, planes):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(CONFIG)
    rows = ODD_TEXTS + [(10, "with <|endoftext|> inside", "a")]
    path = str(tmp_path / "ids")
    token_files.write_tokens(make_docs(rows), path, CONFIG, planes=planes, block=64, files=3)
    docs = token_files.token_index(spark, path).orderBy("start").collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows if i is not None}
    assert [d.doc_id for d in docs] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for d in docs:
        assert d.start == start
        start += d.n_tokens
        if d.doc_id is not None:
            assert d.ids_crc32 == zlib.crc32(np.array(ids[d.doc_id], "<u4").tobytes())
    whole = token_files.read_tokens(spark, path).where("doc_id = 8").first()
    assert whole.ids == ids[8]


@pytest.mark.parametrize("limits", [{"file_docs": 3}, {"file_bytes": 200}, {"file_docs": 1}])
def test_a_task_starts_new_files(spark, make_docs, tmp_path, limits):
    """Whatever ends a file: the same documents, positions and digests, over more files."""
    rows = ODD_TEXTS + [(100 + i, f"text number {i} " * (1 + i % 40), "a") for i in range(60)]
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    token_files.write_tokens(make_docs(rows), one, CONFIG, block=32, files=2)
    token_files.write_tokens(make_docs(rows), many, CONFIG, block=32, files=2, records=600, **limits)
    count = [len(list((tmp_path / d).glob("part-*"))) for d in ("one", "many")]
    assert count[0] == 2 and count[1] > 8
    a, b = (sorted(map(tuple, token_files.token_index(spark, p).collect()), key=lambda r: r[1]) for p in (one, many))
    assert a == b and len(a) == len(rows)


def test_empty_table_writes_readable_files(spark, make_docs, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_tokens(make_docs(ODD_TEXTS).limit(0), path, CONFIG)
    assert token_files.token_index(spark, path).count() == 0


def test_registered_queries_agree_with_the_libraries(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in registry.queries()["op5_byte_bpe"](spark, SMALL).collect()}
    files = {r.doc_id: r for r in registry.queries()["op10_token_planes"](spark, SMALL).collect()}
    start = 0
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
        assert (files[d.doc_id].start, files[d.doc_id].n_tokens) == (start, len(ids) + 1)
        assert files[d.doc_id].ids_crc32 == zlib.crc32(np.array(ids + [2], "<u4").tobytes())
        start += len(ids) + 1
