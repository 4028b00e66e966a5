from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from folioscan.llm import suffixes
from folioscan.llm.queries import QUERIES
from folioscan.llm.rows import Bits
from folioscan.llm.suffixes import core_hash, front_code, front_decode, merge, remove_repeats


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, longest, sha256) of each text, by counting all strings."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[i : i + length]) for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        longest = max((len(run) for run in "".join("x" if g else " " for g in gone).split()), default=0)
        out.append((len(b), sum(gone), spans, longest, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdeé", k=draw.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (20, 40, 60, 90, 200)]
    texts = [None, "", "x", "a" * 900, "ab" * 300, "a" * 59, "a" * 60]
    for _ in range(40):
        texts.append(" ".join(draw.choice(passages) if draw.random() < 0.3 else text(draw.randint(1, 60)) for _ in range(4)))
    base = text(400)
    for _ in range(12):
        w = base.split(" ")
        for _ in range(draw.randint(1, 6)):
            w[draw.randrange(len(w))] = word()
        texts.append(" ".join(w))
    p = passages[3]
    texts += [p[k : k + 80 + k] + text(30) for k in range(0, 200, 13)]
    return texts + [texts[9]] * 5 + [base, base]


@pytest.mark.parametrize(("length", "depth", "seed"), [(60, 20, 1), (100, 24, 2), (80, 80, 3)])
def test_matches_counting_all_strings(spark, length, depth, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, lo int").repartition(4)
    got = remove_repeats(docs, length=length, depth=depth).collect()
    want = brute(texts, length)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.longest, r.kept_sha256) == want[r.doc_id], texts[r.doc_id]
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and r.lo == 1


def test_query_equals_counting_all_strings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = brute([d.text for d in docs], 400)
    got = {r.doc_id: r for r in QUERIES["op3_repeated_passages"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs) and any(w[1] for w in want)
    for d, w in zip(docs, want, strict=True):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.longest, r.kept_sha256) == w


def test_planted_passages_are_cut_from_400_bytes_on_whatever_their_words(spark, tmp_path):
    draw = random.Random(11)
    text = lambda n: " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 6))) for _ in range(n))
    rows = [(text(draw.randint(60, 300)), 0) for _ in range(30)]
    for size in (320, 399, 400, 401, 2000):
        for _ in range(4):
            passage = text(size)[:size].rstrip().ljust(size, "x")
            assert len(passage.split()) > 50
            rows += [(f"{text(60)} {k}{passage}{k} {text(60)}", size if size >= 400 else 0) for k in range(3)]  # unlike neighbours
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in QUERIES["op3_repeated_passages"](spark, str(tmp_path)).collect()}
    assert got == {i: (n, int(n > 0)) for i, (_, n) in enumerate(rows)}


def test_texts_without_repeats_pass_one_python_worker(spark):
    docs = spark.createDataFrame([(1, "x" * 100), (2, "é" * 300), (3, None)], "doc_id long, text string").coalesce(1)
    out = remove_repeats(docs, length=60, depth=20)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # two filters, and the cut of the texts that the bitmap doesn't rule out
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in out.collect()) == [(1, 100, 100), (2, 600, 600), (3, 0, 0)]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_merge_of_front_coded_runs():
    import numpy as np

    draw = random.Random(5)
    runs, depth = [], 12
    for _ in range(7):
        own = sorted({bytes(draw.choices(b"ab", k=depth)) for _ in range(draw.randint(0, 200))})
        runs.append(own)
    coded = [front_code(np.frombuffer(b"".join(r), np.uint8).reshape(-1, depth), np.zeros(len(r), bool)) for r in runs]
    out = list(merge([front_decode(c, depth) for c in coded], depth))
    assert [s for _, s, _ in out] == sorted(s for r in runs for s in r)
    last = None
    for same, s, _ in out:
        if last is not None:
            assert same == next((k for k in range(depth) if s[k] != last[k]), depth)
        last = s
    assert len(set(core_hash([s for _, s, _ in out]).tolist())) == len({s for r in runs for s in r})


def test_groups_are_hashed_not_sorted(spark, monkeypatch):
    plans, write = {}, suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(df, name))
    docs = spark.createDataFrame([(i, f"{i} " + "abcdefghij" * 30 + f" {i}") for i in range(6)], "doc_id long, text string")
    assert {r.n_removed for r in remove_repeats(docs, length=60, depth=20).collect()} == {302}
    assert all("HashAggregate" in plans[x] and "SortAggregate" not in plans[x] for x in ("groups", "classes"))


def test_anchors_that_the_bitmap_rules_out_are_not_shuffled(spark):
    import numpy as np

    text = "".join(random.Random(7).choices("abcdefgh", k=5000))
    (found,) = [x[2] for x in suffixes.anchored(pa.array([text, None, "short"]), 60, 20)]
    assert [s for lo, hi in zip(found.lo, found.hi, strict=True) for s in range(lo, hi + 1)] == list(range(5000 - 60 + 1))
    assert all(lo <= p and hi <= p and p + 20 <= lo + 60 for lo, hi, p in zip(found.hi, found.lo, found.place, strict=True))
    words = np.zeros(Bits.WORDS, np.int64)
    for h in found.core_hashes().view(np.int64)[:3].tolist():
        words[h & (Bits.WORDS - 1)] |= np.int64(np.uint64(1) << np.uint64((h >> 20) & 63))
    rows = spark.createDataFrame([(1, text)], "th long, t string").mapInArrow(suffixes._anchor_rows(60, 20, Bits(words), spark), "th long, lo long, hi long, place long, core long, u long, v long")
    assert rows.count() == 3 < len(found.lo)
