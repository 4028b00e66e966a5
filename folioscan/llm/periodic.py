"""Periodic runs of words: union-find over suffix classes in order of falling common prefixes."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.kernel import SPACED, chunks, word_hashes, words
from folioscan.llm.rows import map_texts

RUNS = "runs array<struct<start:long,length:long,period:long>>"
# Rounds of dropping words that recur too seldom; more would only save work.
ROUNDS = 6


def stretches(ids: np.ndarray, group: np.ndarray, times: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that a run can hold: their places, and for each the number of its stretch.

    A run of ``times`` periods holds each of its words ``times`` times, so a word that recurs less often in its stretch
    stands in no run and ends the stretch; so does one of fewer than ``least`` words. What is left holds all runs whole.
    """
    at, part = np.arange(len(ids)), group
    for _ in range(ROUNDS):
        if not len(at):
            break
        _, back, count = np.unique(part * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        keep = count[back] >= times
        at, part = at[keep], part[keep]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])
        part = np.cumsum(fresh) - 1
        long = np.bincount(part, minlength=1)[part] >= least if len(part) else np.zeros(0, bool)
        at, part = at[long], part[long]
        if keep.all() and long.all():
            break
    return at, np.unique(part, return_inverse=True)[1] if len(part) else part


def suffix_order(ids: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all stretches in order, and how many words each shares with the one before it (0 across stretches).

    Ranks of windows of 1, 2, 4, ... words; a window that its stretch cuts off equals no other.
    """
    n = len(ids)
    end = np.searchsorted(part, part, "right")
    levels = [np.unique(part * (int(ids.max()) + 1) + ids, return_inverse=True)[1].astype(np.int32)]
    size = 1
    while int(levels[-1].max()) + 1 < n:
        rank, nxt = levels[-1], np.zeros(n, np.int64)
        ahead = np.arange(n) + size
        whole = ahead < end
        nxt[whole] = rank[ahead[whole]] + 1
        levels.append(np.unique(rank.astype(np.int64) * (n + 1) + nxt, return_inverse=True)[1].astype(np.int32))
        size *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank, ok = levels[k], (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = rank[a[ok]] == rank[b[ok]]
        step = same.astype(np.int64) << k
        a, b, shared = a + step, b + step, shared + step
    return order, shared


def runs_of(ids: np.ndarray, part: np.ndarray, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in stretches of words, in no order.

    Suffixes that share l words are united in order of falling l; a class is a sorted list of places, and the shorter list goes
    into the longer. Two places that become neighbours in a class at a distance d within l begin a repetition of d + l words
    with smallest period d; the one that no word on the left extends is the run. Places further apart than ``exponent``
    asks for seed nothing, and classes that share fewer words than any seed needs are not united.
    """
    order, shared = suffix_order(ids, part)
    floor = min(max((exponent - 1) * q, least - q) for q in range(1, least + 1))
    edges = np.flatnonzero(shared >= floor)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    word, stretch = ids.tolist(), part.tolist()
    parent = list(range(len(word)))
    places: dict[int, list[int]] = {}
    found = []
    for left, right, common in zip(order[edges].tolist(), order[edges + 1].tolist(), shared[edges].tolist(), strict=True):
        while parent[left] != left:
            parent[left] = left = parent[parent[left]]
        while parent[right] != right:
            parent[right] = right = parent[parent[right]]
        big, small = places.get(left) or [left], places.pop(right, None) or [right]
        top, low = left, right
        if len(big) < len(small):
            big, small, top, low = small, big, right, left
            places.pop(left, None)
        parent[low] = top
        places[top] = big
        reach, last = common // (exponent - 1), -1
        for x, following in zip(small, [*small[1:], len(word)], strict=True):
            i = bisect_left(big, x)
            big.insert(i, x)
            # only neighbours that come from different classes are new, and what follows in the shorter list may come between
            before = big[i - 1] if i and big[i - 1] != last else x
            behind = big[i + 1] if i + 1 < len(big) and big[i + 1] < following else x
            for p, q in ((before, x), (x, behind)):
                d = q - p
                if 0 < d <= reach and d + common >= least and (p == 0 or stretch[p - 1] != stretch[p] or word[p - 1] != word[q - 1]):
                    found.append((p, d + common, d))
            last = x
    return found


def find_in(array, exponent: int, least: int, collapse: bool) -> tuple[pa.Array, pa.Array | None]:
    """The runs of each text of a column, and the texts without what repeats in them."""
    counts, flat, texts = [], [], []
    for _, data, at in chunks(array):
        starts, ends, first = words(data, at, SPACED)
        rows = np.zeros(0, np.int64)
        runs = np.zeros((0, 3), np.int64)
        if len(starts):
            ids = np.unique(word_hashes(data, starts, ends), return_inverse=True)[1]
            own = np.repeat(np.arange(len(first) - 1), np.diff(first))
            place, part = stretches(ids, own, exponent, least)
            if len(place):
                found = runs_of(ids[place], part, exponent, least)
                if found:
                    runs = np.array(found, np.int64)
                    runs[:, 0] = place[runs[:, 0]]
                    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
                    rows = own[runs[:, 0]]
        counts.append(np.bincount(rows, minlength=len(at) - 1))
        if collapse:
            texts.append(collapsed(data, at, starts, ends, first, runs))
        runs[:, 0] -= first[rows]
        flat.append(runs)
    total = np.concatenate([np.zeros(1, np.int64), *counts]).cumsum().astype(np.int32)
    each = np.concatenate(flat) if flat else np.zeros((0, 3), np.int64)
    items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(each[:, k])) for k in range(3)], names=["start", "length", "period"])
    kept = pa.chunked_array(texts, pa.string()).combine_chunks() if collapse else None
    return pa.ListArray.from_arrays(pa.array(total), items), kept


def collapsed(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, runs: np.ndarray) -> pa.Array:
    """The texts of a chunk without the words behind the first period of a run, joined by single spaces."""
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    keep = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[keep]] += 1
    edge[ends[keep]] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    out = data
    if len(keep):
        text = np.searchsorted(first, keep, "right") - 1
        follows = keep[:-1][text[1:] == text[:-1]]
        # a kept word with another kept one of its text behind it keeps the white space at its end as its separator
        out = data.copy()
        out[ends[follows]] = 32
        mask[ends[follows]] = True
    sizes = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask)])[at]
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(sizes.astype(np.int32).tobytes()), pa.py_buffer(out[mask].tobytes()))


def find_runs(docs: DataFrame, *, text: str = "text", exponent: int = 4, least: int = 6, collapse: bool = True) -> DataFrame:
    """Add ``runs`` (by start, then period) and, with ``collapse``, ``collapsed`` to every row.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of words with smallest period q and
    length of at least ``exponent * q`` and ``least`` words that no neighbouring word extends; ``exponent`` is a whole number from 2.
    ``collapsed`` is the text without the words that stand in a run behind its first q words, joined by single spaces.

    Each text is worked on in its task; words go by 64-bit hashes. Most words stand in no run because they recur too seldom
    nearby, and only the others are sorted by suffix, many texts at once.
    Null and empty texts have no runs and an empty ``collapsed``; repeated rows have the same answer each; an empty table gives
    an empty table; columns of the table with these names are replaced. A very long text is worked on whole: it takes some 300
    bytes of memory a word.
    """
    if exponent < 2:
        raise ValueError("exponent is 2 at least")

    def work(column):
        parts = [find_in(column.slice(k, 1000), exponent, least, collapse) for k in range(0, len(column), 1000)]
        return [pa.concat_arrays(x) for x in zip(*parts, strict=True) if x[0] is not None], None

    return map_texts(docs, text, RUNS + (", collapsed string" if collapse else ""), work)


def run_lines() -> Column:
    """The runs of a row as lines ``start,length,period``."""
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return F.array_join(line, "")
