"""Periodic runs of words."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from folioscan.llm.periodic import find_runs
from folioscan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w, exponent=4, least=6):
    """All runs by trying each period."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and not any(s <= i and i + (j - i + q) <= s + m for s, m, p in out if p < q):
                out.append((i, j - i + q, q))
            i = j + 1 if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def nested(draw, depth):
    """Words with repetitions within repetitions."""
    if not depth:
        return draw.choices("abc", k=draw.randint(1, 3))
    out = []
    for _ in range(draw.randint(1, 3)):
        out += nested(draw, depth - 1) * draw.choice([1, 2, 4, 5, 7])
        out += draw.choices("abcd", k=draw.randint(0, 2))
    return out


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 7), (2, 9)])
def test_all_runs(spark, exponent, least):
    draw = random.Random(exponent * 10 + least)
    texts = [" ".join(draw.choices("ab", k=draw.randint(0, 60))) for _ in range(60)]
    texts += ["\t".join(nested(draw, draw.randint(1, 3))) for _ in range(80)]
    texts += ["x " * 4000, "the cat sat " * 700 + "on the mat", None, "", " \n ", "é é é é é é", "a\na a  a a\ta a"]
    docs = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, runs string").repartition(3)
    got = {r.doc_id: r for r in find_runs(docs, exponent=exponent, least=least).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain_runs(words_of(t), exponent, least)
        assert [tuple(r) for r in got[i].runs] == want, t
        assert got[i].collapsed == plain_collapse(words_of(t), want)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 9, 1), (1, "a b " * 9, 1), (None, None, None)], "doc_id long, text string, collapsed int")
    assert sorted((str(r.doc_id), r.collapsed, len(r.runs)) for r in find_runs(docs).collect()) == [("1", "a b", 1), ("1", "a b", 1), ("None", "", 0)]
    assert find_runs(docs.limit(0)).collect() == []
    assert "collapsed" in find_runs(docs, collapse=False).columns  # the column of the table stays
    with pytest.raises(ValueError):
        find_runs(docs, exponent=1)


def test_query_equals_a_plain_version(spark):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    with_runs = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w, h = words_of(r.text), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        with_runs += bool(best)
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli) == (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert x.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and x.collapsed_sha256 == sha(plain_collapse(w, runs))
    assert with_runs > 5
