from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscan.llm.katz import SMALL, discounts, pack, score_texts, unpack

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]


class Plain:
    """The same model on dicts."""

    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.one.update(w)
            self.two.update(zip(["<s>", *w[:-1]], w, strict=True))
        self.total = sum(self.one.values())
        self.d1, self.d2 = (discounts([sum(c == r for c in x.values()) for r in range(1, SMALL + 2)]) for x in (self.one, self.two))
        self.left = sum((1 - self.d(self.d1, c)) * c for c in self.one.values()) / self.total if self.total else 1.0
        self.after = {}
        for (v, w), c in self.two.items():
            self.after.setdefault(v, {})[w] = c

    @staticmethod
    def d(d, c):
        return d[c - 1] if c <= SMALL else 1.0

    def p1(self, w):
        c = self.one[w]
        if not c:
            return self.left or 1 / (self.total + 1)
        return self.d(self.d1, c) * c / self.total if self.left else c / (self.total + 1)

    def p(self, v, w):
        seen = self.after.get(v)
        if not seen:
            return self.p1(w)
        total = sum(seen.values())
        bare = all(c > SMALL for c in seen.values())
        if w in seen:
            return seen[w] / (total + 1) if bare else self.d(self.d2, seen[w]) * seen[w] / total
        kept = sum(self.d(self.d2, c) * c for c in seen.values()) / total
        left = 1 / (total + 1) if bare else 1 - kept
        return left / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p(v, x)) for v, x in zip(["<s>", *w[:-1]], w, strict=True))

    def base(self, text):
        return sum(math.log10((self.one[x] + 1) / (self.total + len(self.one) + 1)) for x in tokens(text))


def corpus(n, seed=3):
    draw = random.Random(seed)
    names = ["the", "The", "é", "a,"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(draw.choices(names, [40, 9, 9, 9] + [200 / (i + 5) for i in range(60)], k=draw.randint(0, 40))) for _ in range(n)]
    return [None, "", " \t\n", "Only\x0bonce", *texts, texts[0], texts[0]]


@pytest.mark.parametrize("run_tokens", [40, 1 << 22])
def test_matches_a_plain_model(spark, run_tokens):
    texts = corpus(220)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    model = Plain([t for i, t in enumerate(texts) if not held(i)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    got = score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, run_tokens=run_tokens).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        t = texts[r.doc_id]
        assert r.n_tokens == len(tokens(t)) and r.n_known == sum(model.one[w] > 0 for w in tokens(t)) and r.train_tokens == model.total
        assert r.base_score == pytest.approx(model.base(t), abs=1e-9)
        assert r.score == pytest.approx(model.score(t), abs=1e-9)


def test_probabilities_add_up():
    model = Plain(corpus(100))
    for v in [*model.after, "nowhere"]:
        assert sum(model.p(v, w) for w in [*model.one, "unknown"]) == pytest.approx(1)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(empty, F.lit(True)).collect() == []
    none = score_texts(spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string"), F.lit(None).cast("boolean")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.score) for r in none) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    same = score_texts(spark.createDataFrame([(1, "a " * 50)] * 9, "doc_id long, text string"), F.lit(True)).collect()
    assert len(same) == 9 and len({r.score for r in same}) == 1 and same[0].score <= 0


def test_packed_numbers():
    import numpy as np

    for x in ([], [0], [5, 5, 900], [1 << 40, (1 << 40) + 3]):
        assert unpack(pack(np.array(x, np.uint64))).tolist() == x
        assert unpack(pack(np.array(sorted(x), np.uint64), True)).tolist() == sorted(x)
