"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the word windows of every text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.kernel import ALNUM, LOWER, chunks, inside, ngram_hashes, per_text, word_hashes, words
from folioscan.llm.rows import map_texts, without

RESULT = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"


def windows(texts: list, n: int) -> list[list[bytes]]:
    """The normalised windows of each text: n words in a row, or all words of a text that has fewer."""
    out = []
    for _, data, at in chunks(pa.array(texts, pa.string())):
        low = LOWER[data]
        starts, ends, first = words(low, at, ALNUM)
        text = low.tobytes()
        for d in range(len(at) - 1):
            own = [text[starts[i] : ends[i]] for i in range(first[d], first[d + 1])]
            out.append([b" ".join(own[i : i + n]) for i in range(max(1, len(own) - n + 1))] if own else [])
    return out


class Grams:
    """The hash set: for each window length a bit table that most windows of a text miss, and the windows themselves."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.items: dict[bytes, tuple[str, ...]] = {}
        for (name, _), own in zip(items, windows([t for _, t in items], n), strict=True):
            for w in own:
                if name not in self.items.get(w, ()):
                    self.items[w] = (*self.items.get(w, ()), name)
        self.shift = np.uint64(64 - max(16, min(26, len(self.items).bit_length() + 7)))
        self.tables: dict[int, np.ndarray] = {}
        for w in self.items:
            at = np.array([0, len(w)])
            data = np.frombuffer(w, np.uint8)
            starts, ends, _ = words(data, at, ALNUM)
            table = self.tables.setdefault(len(starts), np.zeros(1 << (64 - int(self.shift)), bool))
            table[ngram_hashes(word_hashes(data, starts, ends), len(starts)) >> self.shift] = True

    def find(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[tuple[int, int, tuple[str, ...]]]:
        """(first word, number of words, items) of each verified occurrence."""
        hashes, text, found = word_hashes(low, starts, ends), low.tobytes(), []
        for size, table in self.tables.items():
            if size > len(starts):
                continue
            maybe = table[ngram_hashes(hashes, size) >> self.shift] & inside(first, size, len(starts))
            for i in np.flatnonzero(maybe).tolist():
                w = b" ".join([text[a:b] for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True)])
                if w in self.items:
                    found.append((i, size, self.items[w]))
        return found


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The test items in blocks of a checked size. The number of blocks follows the size of the items."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null").distinct()
    total = rows.select(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    n = 1 + total // block_bytes
    return [rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    n: int = 13, share: int = 20, mode: str = "flag", block_bytes: int = 8 << 20,
) -> DataFrame:
    """Find the words of each text that stand inside an occurrence of a test window.

    Words are runs of digits, letters and bytes over 0x7F after A-Z are lower-cased. Adds ``n_words, n_hit, n_items, items,
    items_sha256, contaminated``; a text is contaminated if ``share * n_hit >= n_words`` and anything is hit.
    ``mode``: "flag" returns all rows with the columns, "documents" removes contaminated rows, "spans" cuts the hit spans
    out of ``text`` (from the first byte of the first hit word to the last byte of the last).

    Test items are broadcast in blocks of ``block_bytes`` at most, each against all rows; with one block (a test set of up
    to 8 MB) the table is read once, without a shuffle, and every further block is one more pass over the rows.
    Null and empty texts have no words and are never contaminated. A null item id counts as ''; rows with the same item id
    are one item; items without words have no window; an empty test set hits nothing. Repeated rows give repeated results.
    """
    if mode not in ("flag", "documents", "spans"):
        raise ValueError(f"mode {mode!r}")
    spark = docs.sparkSession
    many = _blocks(benchmark, item, item_text, block_bytes)
    out = without(docs, ["_hits"]).withColumn("_hits", F.lit(None).cast("array<struct<at:int,len:int,item:string>>"))
    for k, block in enumerate(many):
        grams = spark.sparkContext.broadcast(Grams([(r.i, r.t) for r in block.collect()], n))
        last = k == len(many) - 1
        if len(many) > 1:
            out = _add_hits(out, text, grams)
        if last:
            out = _judge(out, text, grams if len(many) == 1 else None, share, mode)
    return without(out, ["_hits"])


def _add_hits(docs: DataFrame, text: str, grams) -> DataFrame:
    """Append the occurrences of one block to the list of each row."""

    def work(texts):
        rows: list[list] = [[] for _ in range(len(texts))]
        for row, data, at in chunks(texts):
            low = LOWER[data]
            starts, ends, first = words(low, at, ALNUM)
            for i, size, names in grams.value.find(low, starts, ends, first):
                d = int(np.searchsorted(first, i, "right")) - 1
                rows[row + d] += [{"at": i - int(first[d]), "len": size, "item": x} for x in names]
        return [pa.array(rows, pa.list_(pa.struct([("at", pa.int32()), ("len", pa.int32()), ("item", pa.string())])))], None

    more = map_texts(docs, text, "_more array<struct<at:int,len:int,item:string>>", work)
    return more.withColumn("_hits", F.when(F.col("_hits").isNull(), F.col("_more")).otherwise(F.concat("_hits", "_more"))).drop("_more")


def _judge(docs: DataFrame, text: str, grams, share: int, mode: str) -> DataFrame:
    """Counts and the verdict of each row, from the hash set or from the hits gathered so far."""
    if grams is None:
        packed = docs.withColumn("_pair", F.struct(F.col(f"`{text}`").alias("t"), F.col("_hits").alias("h")))
        return _apply(packed, "_pair", text, None, share, mode)
    return _apply(docs, text, text, grams, share, mode)


def _apply(docs: DataFrame, source: str, text: str, grams, share: int, mode: str) -> DataFrame:
    def work(column):
        texts, given = (column, None) if grams is not None else (column.field("t"), column.field("h").to_pylist())
        n_words, n_hit, items, cut = [], [], [], []
        for row, data, at in chunks(texts):
            low = LOWER[data]
            starts, ends, first = words(low, at, ALNUM)
            if given is None:
                found = grams.value.find(low, starts, ends, first)
            else:
                found = [(int(first[d]) + h["at"], h["len"], (h["item"],)) for d in range(len(at) - 1) for h in given[row + d] or ()]
            cover = np.zeros(len(starts) + 1, np.int64)
            own: dict[int, set[str]] = {}
            for i, size, names in found:
                cover[i] += 1
                cover[i + size] -= 1
                own.setdefault(int(np.searchsorted(first, i, "right")) - 1, set()).update(names)
            hit = np.cumsum(cover[:-1]) > 0
            n_words += np.diff(first).tolist()
            n_hit += per_text(hit, first).tolist()
            items += [sorted(own.get(d, ())) for d in range(len(at) - 1)]
            if mode == "spans":
                cut += _cut(data, at, starts, ends, first, hit, own)
        bad = [h > 0 and share * h >= w for w, h in zip(n_words, n_hit, strict=True)]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        out = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(digest, pa.string()), pa.array(bad, pa.bool_())]
        if mode == "spans":
            same = texts.to_pylist()
            out.append(pa.array([s if c is None else c for s, c in zip(same, cut, strict=True)], pa.string()))
        return out, pa.array([not b for b in bad], pa.bool_()) if mode == "documents" else None

    if mode == "spans":
        out = map_texts(docs, source, f"{RESULT}, _cut string", work)
        return without(without(out, [text, "_pair"]).withColumnRenamed("_cut", text), ["_pair"])
    return without(map_texts(docs, source, RESULT, work), ["_pair"])


def _cut(data, at, starts, ends, first, hit, own) -> list:
    """The texts without their hit spans; None where nothing is hit."""
    out: list = []
    for d in range(len(at) - 1):
        if d not in own:
            out.append(None)
            continue
        keep = np.ones(at[d + 1] - at[d], bool)
        flags = hit[first[d] : first[d + 1]].astype(np.int8)
        edge = np.diff(np.concatenate([[0], flags, [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            keep[starts[first[d] + a] - at[d] : ends[first[d] + b - 1] - at[d]] = False
        out.append(data[at[d] : at[d + 1]][keep].tobytes().decode())
    return out
