"""Scores of operators 7 and 8 against plain-Python scorers of the same models."""

import math
import pickle
import random
import re

import numpy as np
import pytest
import zstandard
from llm_fixtures import ODD_TEXTS, make_docs  # noqa: F401
from pyspark.sql import functions as F

from tablesmith.llm import quality_model, toxicity


def corpus(rng, n=120):
    calm, rude = ["river", "stone", "garden", "window", "letter", "morning"], ["zorgle", "vexbit", "grumk", "snarf"]
    rows = []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(15, 60))]
        if i % 3 == 0:
            words += [rng.choice(rude) for _ in range(6)]
        rng.shuffle(words)
        rows.append((i, ("!!! " * 20 if i % 2 else "") + " ".join(words), "a"))
    rows.append((n, " ".join(rng.choice(calm) for _ in range(9000)) + " zorgle vexbit grumk", "a"))  # long
    return rows + [(1000 + k, t, s) for k, (_, t, s) in enumerate(ODD_TEXTS)]


@pytest.fixture
def data(spark, make_docs):  # noqa: F811
    rows = corpus(random.Random(8))
    labels = [(i, int(i % 2 == 0), int(i % 3 == 0)) for i, _, _ in rows if i < 120]
    return rows, make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_scores(data):
    rows, docs, labels = data
    packed = toxicity.train(docs, labels, F.lit(True))
    model = pickle.loads(packed)
    sizes = []
    for content in model["dictionaries"]:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        z = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append(lambda w, z=z: len(z.compress(w)))
    plain, toxic = sizes

    def by_hand(text):
        gains = []
        for word in (text or "").lower().encode().split():
            window = toxicity.CARRIER + toxicity.MARK + word.strip(toxicity.EDGES) + b" "
            gains.append(plain(window) - toxic(window))
        n = len(gains)
        at = [sum(g >= t for g in gains) for t in toxicity.THRESHOLDS]
        x = [math.log1p(200 * c / max(n, 1)) for c in at] + [min(c, 3) for c in at] + [min(max(max(gains, default=0), 0), 10)]
        m = model["logistic"]
        z = sum((v - a) / s * b for v, a, s, b in zip(x, m["mean"], m["scale"], m["beta"])) + m["beta"][-1]
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))

    got = {r.doc_id: r.score for r in toxicity.score(docs, packed).collect()}
    assert all(got[i] == pytest.approx(by_hand(t), abs=1e-9) for i, t, _ in rows)
    assert np.mean([got[i] for i in range(0, 120, 3)]) > 0.6 > 0.4 > np.mean([got[i] for i in range(1, 120, 3)])


def test_quality_scores(data):
    rows, docs, labels = data
    packed = quality_model.train(docs, labels, F.lit(True))
    trees = pickle.loads(packed)

    def numbers(text):
        data = (text or "").encode()
        words = data.split()
        n = len(words)
        if not n:
            return [math.log1p(len(data))] + [0.0] * (len(quality_model.STATISTICS) - 1)
        lengths = [len(w) for w in words]
        mean = sum(lengths) / n

        def count(chars):
            return sum(b in chars for b in data)
        lines = [x for x in data.split(b"\n") if x.strip()]
        letters = max(1, count(bytes(range(65, 91))) + count(bytes(range(97, 123))))
        return [math.log1p(len(data)), math.log1p(n), mean, math.sqrt(sum((v - mean) ** 2 for v in lengths) / n), len(set(words)) / n,
                max(words.count(w) for w in set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
                count(b"#*$%&|<>@^~_=+\\{}") / n, count(b".,;:?'\"()-") / n, count(b"!") / n, count(b"0123456789") / sum(lengths),
                count(bytes(range(65, 91))) / letters, count(bytes(range(128, 256))) / sum(lengths), math.log1p(len(lines)),
                1 - len(set(lines)) / len(lines), count(b"|") / n]

    def by_hand(text):
        x, total = numbers(text), trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            i = 0
            while i < len(feature):
                i = 2 * i + (2 if x[feature[i]] > threshold[i] else 1)
            total += leaf[i - len(feature)]
        return 1 / (1 + math.exp(-min(max(total, -30), 30)))

    got = {r.doc_id: r.score for r in quality_model.score(docs, packed).collect()}
    assert all(got[i] == pytest.approx(by_hand(t), abs=1e-9) for i, t, _ in rows)
    assert re.match(r"!!!", rows[1][1]) and got[0] > 0.5 > got[1]
