"""The learned operators' arithmetic against plain versions of it."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from geoplane.llm import language, toxicity


class PlainPpm:
    """Method C with exclusion, worked out byte by byte."""

    def __init__(self, texts, order):
        self.order, self.after = order, defaultdict(Counter)
        for t in texts:
            data = b" " * order + t.lower()
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.after[data[i - k : i]][data[i]] += 1

    def p(self, byte, context):
        seen = self.after.get(context)
        shorter = (lambda b: self.p(b, context[1:])) if context else (lambda b: 1 / 256)
        if not seen:
            return shorter(byte)
        total, kinds = sum(seen.values()), len(seen)
        left = sum(shorter(b) for b in range(256) if b not in seen)
        if not left:
            return seen[byte] / total
        return seen[byte] / (total + kinds) if byte in seen else kinds / (total + kinds) * shorter(byte) / left

    def bits(self, text):
        data = b" " * self.order + text.lower()
        return sum(-math.log2(self.p(data[i], data[i - self.order : i])) for i in range(self.order, len(data)))


@pytest.mark.parametrize("order", [1, 2])
def test_code_lengths(spark, order):
    learn = {"aa": ["the cat sat", "the hat"], "bb": ["der Hund und die Katze", "ein Hut"], "cc": ["ö é"]}
    rows = [(k, t) for k, ts in learn.items() for t in ts]
    found = language.gram_counts(spark.createDataFrame(rows, "lang string, text string"), order).toPandas()
    model = language.Model({k: (g.gram.to_numpy(np.int64), g.n.to_numpy(np.int64)) for k, g in found.groupby("lang")}, order)
    texts = [t.encode() for t in ("the cat", "der Hut", "xyz", "é", "A", "\x00\xff~")]
    want = [[PlainPpm([x.encode() for x in learn[k]], order).bits(t) for k in model.langs] for t in texts]
    assert np.allclose(model.lengths(texts), want, rtol=1e-5)


def plain_kernel(s, t):
    """The sum over common subsequences of LENGTH characters, by all of them."""
    from itertools import combinations

    total, n = 0.0, toxicity.LENGTH
    for a in combinations(range(len(s)), n):
        for b in combinations(range(len(t)), n):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_similarities_of_words():
    rng = random.Random(0)
    landmarks = ["^idiot", "moron", "^scumbag"[:8]]
    words = ["^idiot", "^idi-ot", "^ixdiot", "moronic", "a longer word with moron in it"[:30], "^plain", "", "ab"] + ["".join(rng.choice("idotmr^") for _ in range(rng.randrange(1, 20))) for _ in range(40)]
    got = toxicity.Features(landmarks).similar(words)
    width = toxicity.WIDTH
    for w, row in zip(words, got):
        parts = [w[i : i + width] for i in range(max(1, len(w) - width + 1))]
        for mark, value in zip(landmarks, row):
            best = max(plain_kernel(p, mark) / math.sqrt(max(plain_kernel(p, p), 1e-300) * plain_kernel(mark, mark)) if len(p) >= toxicity.LENGTH else 0.0 for p in parts)
            pairs = lambda x: {(x[i], x[j]) for i in range(len(x)) for j in range(i + 1, min(len(x), i + 1 + toxicity.CLOSE))}
            few = len(pairs(w) & pairs(mark)) < toxicity.LENGTH
            assert value == pytest.approx(best, abs=1e-4) or (value < best and (few or best < 2 * toxicity.LEAST)), (w, mark, value, best)
