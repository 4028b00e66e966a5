"""Alignment of two tokenizers."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from folioscan.llm.alignment import align, byte_letters, slices
from folioscan.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_groups(text, tokenizers):
    """Groups of whole texts, byte by byte; None if they have no tokens."""
    a, b = tokenizers
    if not text:
        return None
    data = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    letters = byte_letters()
    left = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
    right = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(ids_b, map(b.id_to_piece, ids_b))]
    if b"".join(left) != data or b"".join(right) != data:
        return None
    own_a, own_b = [k for k, t in enumerate(left) for _ in t], [k for k, t in enumerate(right) for _ in t]
    out, start = [], 0
    for at in range(1, len(data) + 1):
        if at == len(data) or own_a[at - 1] != own_a[at] and own_b[at - 1] != own_b[at]:
            out.append(([ids_a[k] for k in dict.fromkeys(own_a[start:at])], [ids_b[k] for k in dict.fromkeys(own_b[start:at])]))
            start = at
    return out


def plain_align(texts, tokenizers):
    groups = [plain_groups(t, tokenizers) or [] for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for g, own in zip(groups, links):
        lines = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
            sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()), lines,
        )


def test_slices():
    assert slices([2, 1, 2], [1, 2, 1, 1]) == [(0, 2, 0, 2), (2, 3, 2, 4)]
    assert slices([], []) == []
    assert len(byte_letters()) == 256 and sorted(byte_letters().values()) == list(range(256))


def test_odd_texts(spark, tokenizers):
    draw = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x00", "a", "don't", "it's", "12345", "é", "é", "日本語", "😀", "<|endoftext|>", "</s>", "<s>", "<0x41>", "ﬁ", "...", "!?", "supercalifragilistic", "​", "﻿"]
    texts = ["".join(draw.choices(bits, k=draw.randint(1, 30))) for _ in range(300)]
    texts += [None, "", " ", "  ", "foo ", " foo", "foo  ", "a▁b", "▁", "x" * 5000, "word " * 20_000, "a b", "a b", "\n", "a\n b", "a  b"]
    docs = spark.createDataFrame([(i if i % 50 else None, t, i, i) for i, t in enumerate(texts)], "doc_id long, text string, run int, groups int").repartition(5)
    want = sorted(plain_align(texts, tokenizers))
    got = align(docs, A, B, groups=True).collect()
    assert sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got) == want
    assert sum(w[0] == 0 for w in want) >= 4 and sorted(r.doc_id or 0 for r in got) == sorted(i if i % 50 else 0 for i in range(len(texts)))
    hashed = align(docs, A, B).collect()
    assert sorted(r.groups_sha256 for r in hashed) == sorted(hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "" for w in want)
    assert align(docs.limit(0), A, B).collect() == []


def test_query_equals_a_plain_version(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d.doc_id: x for d, x in zip(docs, plain_align([d.text for d in docs], tokenizers))}
    got = QUERIES["op13_tokenizer_alignment"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        *numbers, lines = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == tuple(numbers)
        assert r.groups_sha256 == (hashlib.sha256(lines.encode()).hexdigest() if lines else "")
