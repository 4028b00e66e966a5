"""Decontamination, language ID, quality, near duplicates, packing and the pipeline."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscan.llm import quality
from folioscan.llm.decontamination import decontaminate
from folioscan.llm.jaccard import bands_for, intersections, one_of_each, similar
from folioscan.llm.language import identify, suffix_automaton, train
from folioscan.llm.packing import Encoder, pack, pack_documents
from folioscan.llm.queries import QUERIES, vocabulary
from folioscan.llm.rows import DOCUMENTS
from folioscan.session import cut

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_hits(text, items, n):
    w = ALNUM.findall((text or "").translate(LOW))
    hit, names = set(), set()
    for name, item in items:
        v = ALNUM.findall((item or "").translate(LOW))
        size = min(n, len(v))
        grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                names.add(str(name) if name is not None else "")
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontamination(spark, block_bytes):
    draw = random.Random(2)
    text = lambda k: " ".join(draw.choices(["Ab", "c,", "dé", "e-f", "G", "9"], k=k))
    items = [(1, text(9)), (2, text(3)), (None, "Ab c"), (4, None), (5, "..."), (1, text(6)), (10, text(5))]
    texts = [None, "", "!!", items[0][1], "Ab C dé", *(text(draw.randint(1, 60)) for _ in range(40)), "x " * 30 + items[0][1].upper()]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(docs, bench, n=5, block_bytes=block_bytes).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, h, names = plain_hits(t, items, 5)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, h, names), t
        assert got[i].contaminated == (h > 0 and 20 * h >= n)
    left = {r.doc_id for r in decontaminate(docs, bench, n=5, mode="documents", block_bytes=block_bytes).collect()}
    assert left == {i for i in got if not got[i].contaminated}
    for r in decontaminate(docs, bench, n=5, mode="spans", block_bytes=block_bytes).collect():
        assert r.text == texts[r.doc_id] if not got[r.doc_id].n_hit else len(ALNUM.findall(r.text)) <= got[r.doc_id].n_words - got[r.doc_id].n_hit
    assert not any(r.contaminated for r in decontaminate(docs, bench.limit(0)).collect())
    assert decontaminate(docs.limit(0), bench).collect() == []


def test_automaton_knows_all_pieces():
    text = [1, 2, 1, 1, 2, 3, 1, 2, 1]
    steps = suffix_automaton(text)

    def has(piece):
        state = 0
        for c in piece:
            if c not in steps[state]:
                return False
            state = steps[state][c]
        return True

    pieces = {tuple(text[i:j]) for i in range(9) for j in range(i + 1, 10)}
    assert all(map(has, pieces)) and not any(has((a, b, c)) for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3) if (a, b, c) not in pieces)


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = identify(docs, docs.where(~held)).where(held).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "en", "a"), (2, "", None, "a"), (3, "123 !!", "en", "a"), (4, "the theand", "xx", "a"), (4, "the theand", "xx", "a")], "doc_id long, text string, lang string, score string")
    found = identify(odd, docs.where(~held)).collect()
    assert sorted((r.doc_id, r.lang_pred == "und", r.score == 0) for r in found) == [(1, True, True), (2, True, True), (3, True, True), (4, False, False), (4, False, False)]
    assert {r.lang_pred for r in identify(odd, odd.where("lang is null")).collect()} == {"und"}
    assert identify(odd.limit(0), odd).collect() == []


def test_copies_teach_no_more_than_one_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    langs = [r.lang for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2).collect()]
    one, two = (cut(docs.where(F.col("lang") == x).dropDuplicates(["text"]).orderBy("doc_id").limit(60).select("text", "lang")) for x in langs)
    copied = one.orderBy(F.xxhash64("text")).limit(1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(1000)))).select("text", "lang")
    plain, many = train(one.union(two)), train(one.union(two).union(copied))
    own = lambda m: {x: (t.tolist(), b) for x, t, b in zip(m.langs, m.tables, m.bits)}
    assert own(plain) == own(many)
    texts = [r.text for r in docs.where(F.col("lang") == langs[0]).select("text").collect()]
    assert np.mean([x == langs[0] for x in many.predict(texts)[0]]) > 0.95


def test_quality_of_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = quality.classify(docs, quality.train(docs, labels.where(~held))).join(labels.where(held), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a")], "doc_id long, text string, score string")
    for y, want in (([(3, 1), (3, None)], 1.0), ([], 0.5)):
        model = quality.train(odd, spark.createDataFrame(y, "doc_id long, quality int"))
        assert {r.score for r in quality.classify(odd, model).collect()} == {want}
    assert quality.classify(odd.limit(0), model).collect() == []


def plain_classes(texts, n=5, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent, links = list(range(len(texts))), Counter()
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
    top = []
    for i in range(len(texts)):
        while parent[i] != i:
            i = parent[i]
        top.append(i)
    return top, links


def near_texts(seed, group):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=4))
    texts = [None, "", "  \n", "One", "one", "Two words", *(" ".join(word() for _ in range(draw.randint(5, 80))) for _ in range(60))]
    for base in [texts[10].split(), [word() for _ in range(120)], [word() for _ in range(300)]]:
        for _ in range(group):
            w = list(base)
            for _ in range(draw.randint(0, 6)):
                w[draw.randrange(len(w))] = word()
            texts.append(" ".join(w))
    return texts + [texts[-1]] * 4


@pytest.mark.parametrize(("seed", "group"), [(1, 20), (2, 320)])
def test_jaccard_join(spark, seed, group):
    texts = near_texts(seed, group)
    top, links = plain_classes(texts)
    docs = spark.createDataFrame([(i, t, "z", 3) for i, t in enumerate(texts)], "doc_id long, text string, th string, id int").repartition(4)
    got = similar(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    assert [(r.doc_id, r.class_id, r.n_links) for r in got if (r.class_id, r.n_links) != (top[r.doc_id], links[r.doc_id])] == []
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == sorted(set(top))


def test_jaccard_edges(spark):
    assert bands_for(0.8, 0.9999, 6) == 31
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "x y"), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in similar(docs).collect()) == [(0, 0, 0), (0, 1, 2), (1, 1, 2), (1, 1, 2), (5, 5, 0), (5, 5, 0)]
    assert sorted((r.doc_id or 0, r.text or "") for r in one_of_each(docs).collect()) == [(0, "x y"), (1, "a b c"), (5, ""), (5, "")]
    assert similar(docs.limit(0)).collect() == [] and one_of_each(docs.limit(0)).collect() == []


def test_intersections():
    draw = np.random.default_rng(1)
    a = [np.unique(draw.integers(0, 60, n)).astype(np.uint64) for n in draw.integers(0, 50, 40)]
    b = [np.unique(draw.integers(0, 60, n)).astype(np.uint64) for n in draw.integers(0, 50, 30)]
    assert intersections(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


@pytest.mark.parametrize("seed", range(4))
def test_pack_keeps_every_id_once(seed):
    draw = random.Random(seed)
    lengths = [draw.choice([0, 1, 7, 64, 65, 130, draw.randint(0, 400)]) for _ in range(draw.randint(0, 120))]
    pieces, filled, costs = pack(lengths, 64, 1.0, 1 / 64)
    mine, theirs = defaultdict(list), defaultdict(list)
    for i, start, n, k, offset in pieces:
        mine[i].append((start, n))
        theirs[k].append((offset, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(mine[i]):
            assert start == at and size > 0
            at += size
        assert at == n
    for k, size in enumerate(filled):
        at = 0
        for offset, n in sorted(theirs[k]):
            assert offset == at
            at += n
        assert at == size and (size == 64 or size & (size - 1) == 0)
    assert len(costs) == len(filled)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary())
    texts = [None, "", "it's they'll 'sat !'s x'", "Ünïcode ÉÀ 12 l'été x", "<|endoftext|> a", "日本 ﬁ", "'", "word " * 3000, "a b", "a b"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    got = defaultdict(list)
    for r in pack_documents(docs, vocabulary()).collect():
        assert zlib.crc32(np.array(r.ids, np.uint32).tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        got[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for i, t in enumerate(texts):
        ids = [x for _, own, _ in sorted(got[i]) for x in own]
        assert ids == model.encode(t or "", add_special_tokens=False).ids + [1] and {n for *_, n in got[i]} == {len(ids)}
    assert pack_documents(docs.limit(0), vocabulary()).collect() == []


def test_pieces_are_encoded_once():
    encoder, asked = Encoder(vocabulary(), 1), []

    class Model:
        def tokenize(self, piece, own=encoder.model):
            asked.append(piece)
            return own.tokenize(piece)

    encoder.model = Model()
    letters = [a + b for a in "abcdefghijklmnopqrstuvwxyzàéñöü" for b in "abcdefghijklmnopqrstuvwx"]
    rows = ["it's l'été: " + " ".join(a + b + c for b in letters[::2] for c in letters[k::97]) for k, a in enumerate(letters[:90])] + [None, "", "''s a.'re !!x9 9"]
    got = list(encoder.encode(rows))
    n = len(asked)
    assert n == len(set(asked)) > 250_000
    assert list(encoder.encode(rows)) == got and len(asked) == n
    for text, ids in [*zip(rows, got)][::30] + [*zip(rows, got)][-3:]:
        assert np.frombuffer(ids, np.uint32).tolist() == [*encoder.whole.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_every_row(spark, name):
    out = QUERIES[name](spark, SF)
    rows = out.select(*[c for c in out.columns if c in ("doc_id", "conv_id")]).distinct().count()
    assert rows == spark.read.parquet(f"{SF}/documents.parquet").count() if "doc_id" in out.columns else rows > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    keys = sorted(texts)
    top, _ = plain_classes([texts[k] for k in keys])
    first = {keys[i] for i in set(top)}
    clean = set()
    for k in first:
        n, h, _ = plain_hits(texts[k], bench, 13)
        if re.search(r"[^\W\d_]", texts[k]) and not (h and 20 * h >= n):
            clean.add(k)
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert tuple(out.columns) == DOCUMENTS, name
    assert {r.doc_id for r in out.collect()} == clean
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == clean
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "the and a@b.com of", None, None, None), (1, "the and a@b.com of", None, None, None)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, SF)
    # without a model the rows with letters stay, and of repeated rows one
    (row,) = odd.collect()
    assert row.doc_id == 1 and row.text.startswith("the and ") and row.text.endswith(" of") and "a@b.com" not in row.text
    assert {r.doc_id for r in corpus_pipeline.packed(spark, odd, SF).collect()} == {1}
