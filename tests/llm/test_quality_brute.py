"""Passages and the forward pass of the quality classifier against plain Python; the bounds of its sample."""

import math
import random

import numpy as np
import pytest

from fleetfootprint.llm import quality


def plain_passages(text):
    """Features by definition, a passage of 100 words at a time."""
    text = text or ""
    words, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        end = at
        while end < len(text) and not text[end].isspace():
            end += 1
        words.append((at, end))
        at = end
    if not words:
        return [[0.0] * quality.FEATURES]
    heads = [words[i][0] for i in range(0, len(words), quality.PASSAGE_WORDS)]
    heads[0] = 0
    out = []
    for p, head in enumerate(heads):
        part = text[head : heads[p + 1] if p + 1 < len(heads) else len(text)]
        own = [text[a:b] for a, b in words[p * quality.PASSAGE_WORDS : (p + 1) * quality.PASSAGE_WORDS]]
        kinds = [0] * quality.CLASSES
        for c in part:
            if c in quality.PUNCTUATION:
                kinds[6 + quality.PUNCTUATION.index(c)] += 1
            elif c.islower():
                kinds[0] += 1
            elif c.isupper():
                kinds[1] += 1
            elif c.isalpha():
                kinds[2] += 1
            elif c.isdigit():
                kinds[3] += 1
            elif c.isspace():
                kinds[4] += 1
            else:
                kinds[5] += 1
        before = words[p * quality.PASSAGE_WORDS - 1] if p else None
        previous = [text[before[0] : before[1]] if before else None, *own[:-1]]
        n = len(own)
        row = [math.sqrt(k / len(part)) for k in kinds]
        row += [sum(map(len, own)) / n / 10, sum(a == b for a, b in zip(own, previous)) / n, len(set(own)) / n]
        row += [sum(w[0].isupper() for w in own) / n, sum(len(w) > 20 for w in own) / n, math.log1p(part.count("\n")) / 4, math.log1p(n) / 5]
        out.append(row)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_passages(seed):
    rng = random.Random(seed)
    signs = "aaabbb  \n\tXYé日1,.!#<€"
    text = " ".join("".join(rng.choice(signs) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(0, 300)))
    text += rng.choice(["", " the the the", "\n\n", " " + "w" * 60])
    assert np.allclose(quality.passages(text), plain_passages(text), atol=1e-6)


@pytest.mark.parametrize("text", [None, "", " \n ", "a", "same same same", "  lead"])
def test_short_passages(text):
    assert np.allclose(quality.passages(text), plain_passages(text), atol=1e-6)


def test_forward_pass():
    rng = np.random.default_rng(2)
    bags = [rng.random((k, quality.FEATURES)) for k in (1, 4, 2)]
    model = quality.train(bags, np.array([0.0, 1.0, 1.0]), epochs=2)
    w = model.weights
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for bag in bags:
        encoded, pull = [], []
        for row in bag:
            x = [(a - m) / s for a, m, s in zip(row, model.mean, model.scale)]
            h = [math.tanh(sum(x[i] * w["encode"][i][k] for i in range(len(x))) + w["encode_0"][k]) for k in range(quality.HIDDEN)]
            value = [math.tanh(sum(h[i] * w["value"][i][k] for i in range(len(h)))) for k in range(quality.ATTENTION)]
            gate = [sigmoid(sum(h[i] * w["gate"][i][k] for i in range(len(h)))) for k in range(quality.ATTENTION)]
            encoded.append(h)
            pull.append(sum(v * g * a for v, g, a in zip(value, gate, w["attend"])))
        top = [math.exp(p - max(pull)) for p in pull]
        weights = [t / sum(top) for t in top]
        z = [sum(a * h[k] for a, h in zip(weights, encoded)) for k in range(quality.HIDDEN)]
        want = sigmoid(sum(a * b for a, b in zip(z, w["score"])) + float(w["score_0"]))
        assert model.forward(bag, np.zeros(1, np.int64))["p"][0] == pytest.approx(want, abs=1e-9)


def test_sample_is_bounded_by_passages(spark, monkeypatch):
    rows = [(i, "word " * (100 * (i % 5 + 1))) for i in range(60)] + [(99, "long " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags, own: seen.append(bags))
    quality.fit(docs, labels, train_passages=50)
    quality.fit(docs, labels, train_passages=50)
    quality.fit(docs, labels)
    sizes = [[len(b) for b in bags] for bags in seen]
    assert sum(sizes[0]) <= 50 and len(sizes[0]) > 10 and sizes[0] == sizes[1]
    assert len(sizes[2]) == 61 and max(sizes[2]) == 1000
