"""Removal of repeated passages: a sparse suffix array, sorted by a distributed merge of front-coded runs with loser trees.

Every start of ``length`` bytes belongs to one anchor: the position of the smallest hash of GRAM bytes in its window (the leftmost of
equal ones). The choice depends on the window's bytes alone, so equal windows have their anchors at equal places, and only the
suffixes at anchors need to be sorted: about one in 150 bytes at the defaults. A window holds the first ``depth`` bytes of its anchor's suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.kernel import Prefix, chunks, raw
from folioscan.llm.rows import Bits, map_texts, without, written

GRAM = 16
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
# Bytes whose anchors are looked for together; a longer text comes in pieces.
BLOCK = 1 << 16
RUN_SUFFIXES = 1 << 16
BUCKET_BYTES = 1 << 26
# Starts that are compared together before they are compared one by one.
TOGETHER = 8


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row; uses up x."""
    other, have = np.empty_like(x), 1
    while have < w:
        step = min(have, w - have)
        n = len(x) - step
        np.minimum(x[:n], x[step:], out=other[:n])
        x, other, have = other[:n], x, have + step
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place, with the place in its lowest 24 bits; of equal ones the leftmost is the smallest."""
    n = len(data) - GRAM + 1
    data = np.ascontiguousarray(data)
    out, more = (np.ndarray(n, np.uint64, data, 8 * k, (1,)) * odd for k, odd in enumerate(ODD))  # eight bytes from each place
    out += more
    np.right_shift(out, np.uint64(32), out=more)
    out ^= more
    out *= ODD[0]
    out &= ~np.uint64((1 << 24) - 1)
    out |= np.arange(n, dtype=np.uint64)
    return out


class Anchors:
    """The anchors of some texts: text, first and last start, position, and hashes of the bytes that they decide about."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int, depth: int):
        self.data, self.at, self.length, self.depth = data, at, length, depth
        count = np.maximum(0, np.diff(at) - length + 1)
        if not count.any():
            self.text = self.lo = self.hi = self.place = np.zeros(0, np.int64)
            return
        least = sliding_min(gram_hashes(data), length - depth + 1)[: len(data) - length + 1]
        new = np.ones(len(least), bool)
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[at[:-1][count > 0]] = True
        first = np.flatnonzero(new)
        text = np.searchsorted(at, first, "right") - 1
        ends = at[text] + count[text]
        inside = first < ends  # the others cross the end of a text
        self.text, self.lo = text[inside], first[inside]
        self.hi = np.minimum(np.append(first[1:], len(least)), ends)[inside] - 1
        self.place = (least[self.lo] & np.uint64((1 << 24) - 1)).astype(np.int64)

    @cached_property
    def one(self) -> Prefix:
        return Prefix(self.data, 1)

    def keep(self, mask: np.ndarray) -> None:
        """Forget the anchors outside the mask."""
        self.text, self.lo, self.hi, self.place = self.text[mask], self.lo[mask], self.hi[mask], self.place[mask]

    def cores(self) -> np.ndarray:
        """The first bytes of the suffixes at the anchors, a row each."""
        return self.data[self.place[:, None] + np.arange(self.depth)]

    def core_hashes(self) -> np.ndarray:
        return self.one.pieces(self.place, self.place + self.depth)

    def reach_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of all bytes that the windows of an anchor cover."""
        return self.one.pieces(self.lo, self.hi + self.length), Prefix(self.data, 2).pieces(self.lo, self.hi + self.length)


def anchored(array, length: int, depth: int) -> Iterator[tuple[int, np.ndarray, Anchors]]:
    """(first row, offset of each text's bytes, anchors) of the texts; a very long text comes in pieces, each start in one of them."""
    for row, data, at in chunks(array, BLOCK):
        if len(data) <= 2 * BLOCK:
            yield row, np.zeros(len(at) - 1, np.int64), Anchors(data, at, length, depth)
            continue
        for s in range(0, max(1, len(data) - length + 1), BLOCK):
            part = data[s : s + BLOCK + length - 1]
            yield row, np.array([s]), Anchors(part, np.array([0, len(part)]), length, depth)


def core_hash(strings: list[bytes]) -> np.ndarray:
    """The hashes of whole strings, as Anchors.core_hashes gives them."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    return Prefix(data, 1).pieces(np.concatenate([[0], ends[:-1]]), ends) if strings else np.zeros(0, np.uint64)


def front_code(rows: np.ndarray, repeated: np.ndarray) -> bytes:
    """A sorted run of distinct strings: what each shares with the one before, the rest of its bytes, and a mark for repeats."""
    same = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        same[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    rest = rows[np.arange(rows.shape[1]) >= same[:, None]].tobytes()
    return zstandard.compress(len(rows).to_bytes(4, "little") + same.astype(np.uint16).tobytes() + repeated.astype(np.uint8).tobytes() + rest, 1)


def front_decode(raw: bytes, depth: int) -> Iterator[tuple[int, bytes, int]]:
    """(shared bytes, string, repeated) of a run, in order."""
    raw = zstandard.decompress(raw)
    n = int.from_bytes(raw[:4], "little")
    same, marks = np.frombuffer(raw, np.uint16, n, 4).tolist(), raw[4 + 2 * n : 4 + 3 * n]
    at, last = 4 + 3 * n, b""
    for k, mark in zip(same, marks, strict=True):
        end = at + depth - k
        last = last[:k] + raw[at:end]
        at = end
        yield k, last, mark


def merge(runs: list[Iterator[tuple[int, bytes, int]]], depth: int) -> Iterator[tuple[int, bytes, int]]:
    """Merge sorted runs with a loser tree: (bytes shared with the string before, string, repeated), in order.

    Each waiting string carries how many bytes it shares with the last string that left. Of two, the one that shares more
    comes first and nothing is compared; only if they share alike are the bytes behind the known prefix looked at.
    """
    size = 1
    while size < len(runs):
        size *= 2
    head: list[tuple[int, bytes, int] | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [h[0] if h else -1 for h in head]
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared bytes become those with the winner where they were compared."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = shared[a], shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        s, t = x[1], y[1]
        if s == t:
            shared[b] = depth
            return a, b
        u, v = int.from_bytes(s[p:]), int.from_bytes(t[p:])
        k = depth - ((u ^ v).bit_length() + 7) // 8
        if u < v:
            shared[b] = k
            return a, b
        shared[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, loser[node] = play(build(2 * node), build(2 * node + 1))
        return win

    win = build(1) if size > 1 else 0
    while head[win] is not None:
        yield shared[win], head[win][1], head[win][2]
        head[win] = step = next(runs[win], None)
        shared[win] = step[0] if step else -1
        node = (win + size) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


def _runs(splits: np.ndarray, length: int, depth: int):
    """Sorted, front-coded runs of the suffixes at the anchors, cut at the splits."""
    weights = np.array([1 << 40, 1 << 32, 1 << 24, 1 << 16, 1 << 8, 1], np.int64)

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").reshape(-1), kind="stable")
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        repeated = np.diff(np.append(first, len(rows))) > 1
        rows = rows[first]
        bucket = np.searchsorted(splits, rows[:, :6].astype(np.int64) @ weights, "right")
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(cut[1:], len(rows))
        coded = [front_code(rows[a:b], repeated[a:b]) for a, b in zip(cut, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array(coded, pa.binary())], names=["bucket", "run"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, have = [], 0
        for batch in batches:
            for _, _, found in anchored(batch.column(0), length, depth):
                if len(found.lo):
                    parts.append(found.cores())
                    have += len(found.lo)
                if have >= RUN_SUFFIXES:
                    yield flush(parts)
                    parts, have = [], 0
        if have:
            yield flush(parts)

    return work


def _merged(depth: int):
    """The hashes of the strings that occur twice or more in a bucket."""

    def work(table: pa.Table) -> pa.Table:
        out, last, told = [], b"", False
        for same, string, repeated in merge([front_decode(x.as_py(), depth) for x in table["run"]], depth):
            again = same >= depth and string == last
            if (again and not told) or (not again and repeated):
                out.append(string)
                told = True
            elif not again:
                told = False
            last = string
        return pa.table({"core": pa.array(core_hash(out).view(np.int64), pa.int64())})

    return work


def _anchor_rows(length: int, depth: int, bits: Bits, spark: SparkSession):
    """The anchors whose core the bitmap does not rule out."""
    shared = spark.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.asarray(batch.column(0))
            for row, offset, found in anchored(batch.column(1), length, depth):
                if not len(found.lo):
                    continue
                cores = found.core_hashes().view(np.int64)
                near = shared.value.maybe(cores)
                if not near.any():
                    continue
                found.keep(near)
                base = offset[found.text] - found.at[found.text]
                u, v = found.reach_hashes()
                columns = [names[row + found.text], found.lo + base, found.hi + base, found.place + base, cores[near], u.view(np.int64), v.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["th", "lo", "hi", "place", "core", "u", "v"])

    return work


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(hash, bytes, columns of the ranges in question) of each text; copies of a text in one task come once."""
    done: set[int] = set()
    for batch in batches:
        for th, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if th not in done:
                done.add(th)
                yield th, np.frombuffer(text.cast(pa.binary()).as_py(), np.uint8), [np.asarray(c, np.int64) for c in asked.values.flatten()]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of each range, and the number of the range of each."""
    n = last - first + 1
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n), owner


def _rows(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64), pa.int64()) for c in columns], names=names)


def _block_rows(length: int):
    """For each block of starts, aligned at the anchor, a hash of what all its windows share and two of what they cover."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for th, data, (lo, hi, place, w) in _asked(batches):
            one, two = Prefix(data, 1), Prefix(data, 2)
            block, owner = _spread((place - hi) // TOGETHER, (place - lo) // TOGETHER)
            at, near = place[owner], block * TOGETHER
            first, last = np.maximum(lo[owner], at - near - TOGETHER + 1), np.minimum(hi[owner], at - near)
            shared = one.pieces(at - near, at - near - TOGETHER + 1 + length)
            yield _rows([shared, one.pieces(first, last + length), two.pieces(first, last + length), w[owner], np.full(len(at), th), first, last], ["p", "u", "v", "w", "th", "lo", "hi"])

    return work


def _window_rows(length: int):
    """Two hashes of every window in question."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for th, data, (lo, hi, w) in _asked(batches):
            at, owner = _spread(lo, hi)
            yield _rows([Prefix(data, k).pieces(at, at + length) for k in (1, 2)] + [w[owner], np.full(len(at), th), at], ["u", "v", "w", "th", "lo"])

    return work


def _held(bits: Bits, spark: SparkSession, inside: bool = True):
    """The rows whose first column, a hash, the bitmap does not rule out; or the others."""
    shared = spark.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.maybe(batch.column(0)) == inside))

    return work


def _removed(length: int, kept: bool):
    def work(column):
        texts, spans = column.field("t"), column.field("s")
        values = texts.cast(pa.large_binary()).fill_null(b"")
        data, at = raw(values)
        data, n = memoryview(np.ascontiguousarray(data)), len(values)
        counts = np.asarray(pc.fill_null(pc.list_value_length(spans), 0), np.int64)
        # all starts of the batch in one line, the texts far apart
        owner = np.repeat(np.arange(n), counts)
        packed = np.asarray(spans.flatten(), np.int64)
        order = np.lexsort((packed, owner))
        owner, packed = owner[order], packed[order]
        begin = (owner << 32) + (packed >> 31)
        reach = np.maximum.accumulate((owner << 32) + (packed & ((1 << 31) - 1)) + length) if len(begin) else begin
        new = np.ones(len(begin), bool)
        new[1:] = begin[1:] > reach[:-1]
        runs = np.flatnonzero(new)
        owner, begin, end = owner[runs], begin[runs], reach[np.append(runs[1:], len(reach)) - 1] if len(runs) else begin[runs]
        begin, end = begin - (owner << 32), end - (owner << 32)
        n_spans, removed, longest = np.bincount(owner, minlength=n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(removed, owner, end - begin)
        np.maximum.at(longest, owner, end - begin)
        digests, rests = [], []
        last = np.concatenate([[0], np.cumsum(n_spans)])
        for i in range(n):
            a, b = at[i], at[i + 1]
            cuts = [a, *(x for j in range(last[i], last[i + 1]) for x in (a + begin[j], a + end[j])), b]
            parts = [data[cuts[j] : cuts[j + 1]] for j in range(0, len(cuts), 2)]
            digest = hashlib.sha256()
            for part in parts:
                digest.update(part)
            digests.append(digest.hexdigest())
            if kept:
                rests.append(b"".join(parts))
        numbers = [pa.array(np.asarray(x, np.int64)) for x in (np.diff(at), removed, n_spans, longest)]
        return [*numbers, pa.array(digests, pa.string())] + ([pa.array(rests, pa.binary())] if kept else []), None

    return work


def repeated_spans(docs: DataFrame, *, text: str = "text", length: int = 400, depth: int = 96) -> DataFrame:
    """(th, spans): for each text with repeats its hash and its repeated starts, as an array of lo * 2**31 + hi."""
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64(f"`{text}`").alias("th"), F.col(f"`{text}`").cast("string").alias("t")).where(F.octet_length("t") >= length)

    def one(*names: str) -> list[Column]:
        """The same row of a group for all names, whichever it is: plain numbers, so that groups are hashed, not sorted."""
        return [F.first(x).alias(x) for x in names]

    # 1. split points of the suffixes, from one place of each text
    size = F.octet_length("t")
    place = F.pmod(F.xxhash64("t", F.lit(9)), (size - length + 1).cast("long")).cast("int")
    head = F.conv(F.hex(F.substring(F.col("t").cast("binary"), place + 1, F.lit(6))), 16, 10).cast("long")
    total = rows.agg(F.sum(size)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)
    cuts = [k / buckets for k in range(1, buckets)]
    splits = (rows.agg(F.percentile_approx(head, cuts, 20 * buckets).alias("s")).first().s or []) if cuts else []

    # 2. sorted runs are exchanged and merged; strings that meet an equal one are candidates
    runs = rows.select("t").mapInArrow(_runs(np.array(splits, np.int64), length, depth), "bucket long, run binary")
    cores = written(runs.groupBy("bucket").applyInArrow(_merged(depth), "core long"), "cores")

    # 3. anchors at a candidate; those with all their bytes in common are settled
    near = _anchor_rows(length, depth, Bits.of(cores, "core"), spark)
    flagged = written(rows.mapInArrow(near, "th long, lo long, hi long, place long, core long, u long, v long").join(cores, "core", "left_semi"), "anchors")
    groups = written(flagged.groupBy("core", "u", "v").agg((F.count("*") > 1).alias("again"), *one("th", "lo", "hi", "place")), "groups")
    whole = flagged.join(groups.where("again"), ["core", "u", "v"], "left_semi").select("th", "lo", "hi")

    def rims(groups: DataFrame, kin: str, *fields: str) -> DataFrame:
        """What is compared more closely, one of each group whose kin has other groups: the texts and their ranges."""
        several = groups.groupBy(kin).agg(F.count("*").alias("n")).where("n > 1").select(kin)
        open_ = groups.join(several, kin, "left_semi").select("th", *fields, F.when(F.col("again"), 2).otherwise(1).cast("long").alias("w"))
        asked = written(open_.groupBy("th").agg(F.collect_list(F.struct(*fields, "w")).alias("asked")), "asked")
        close = rows.mapInArrow(_held(Bits.of(asked, "th"), spark), rows.schema)
        return close.join(asked, "th").select("th", "t", "asked")

    # A range stands for others (w = 2), or another place has the same bytes. Places, not rows: a text may be looked at twice.
    place = F.xxhash64("th", "lo")
    twice = (F.max("w") > 1) | (F.min(place) < F.max(place))

    # 4. where anchors of one suffix differ around it, blocks of starts are compared, then the starts of the blocks that differ
    texts = rims(groups, "core", "lo", "hi", "place")
    blocks = written(texts.mapInArrow(_block_rows(length), "p long, u long, v long, w long, th long, lo long, hi long"), "blocks")
    classes = written(blocks.groupBy("p", "u", "v").agg(twice.alias("again"), *one("th", "lo", "hi")), "classes")
    parts = blocks.where("w = 1").join(classes.where("again"), ["p", "u", "v"], "left_semi").select("th", "lo", "hi")
    texts = rims(classes, "p", "lo", "hi")
    windows = written(texts.mapInArrow(_window_rows(length), "u long, v long, w long, th long, lo long"), "windows")
    again = windows.groupBy("u", "v").agg(twice.alias("again")).where("again")
    single = windows.where("w = 1").join(again, ["u", "v"], "left_semi").select("th", "lo", F.col("lo").alias("hi"))
    return whole.unionByName(parts).unionByName(single).groupBy("th").agg(F.collect_set(F.shiftleft("lo", 31).bitwiseOR(F.col("hi"))).alias("spans"))


def remove_repeats(docs: DataFrame, *, text: str = "text", length: int = 400, depth: int = 96, kept: bool = True) -> DataFrame:
    """Cut every byte that lies in a string of ``length`` bytes which starts anywhere else too, in the same text or another.

    Texts are UTF-8 bytes; what is repeated is judged on the input. Adds ``n_bytes, n_removed, n_spans`` (maximal removed runs),
    ``longest`` (the bytes of the longest of them), ``kept_sha256`` and, with ``kept``, the remaining bytes in ``kept`` (binary, as a cut may fall inside a character).

    1. Suffixes at the anchors are sorted to ``depth`` bytes: each task sorts its own into runs, front-codes them with equal ones
    joined, and sends each piece to the owner of its range; the owners merge with a loser tree. 2. Anchors whose suffix occurs
    again are compared by the bytes of all their windows; equal ones are settled. 3. The others (the rims of repeated
    passages) are compared in blocks of eight starts, and where these differ start by start, by two 64-bit hashes. 4. The spans return to their texts. Texts that a
    bitmap of fixed size rules out are not shuffled.

    Null counts as empty; texts under ``length`` bytes lose nothing; repeated rows are copies of each other and lose alike. Columns with
    the names of results are replaced. ``depth`` must lie between GRAM and ``length``.
    """
    names = ["n_bytes", "n_removed", "n_spans", "longest", "kept_sha256", "kept"]
    base = without(docs, [*names, "_th", "_spans", "_both"])
    spans = written(repeated_spans(base, text=text, length=length, depth=depth), "spans")
    bits = Bits.of(spans, "th")
    added = "n_bytes long, n_removed long, n_spans long, longest long, kept_sha256 string" + (", kept binary" if kept else "")

    def cut(rows: DataFrame, found: Column) -> DataFrame:
        both = rows.withColumn("_both", F.struct(F.col(f"`{text}`").alias("t"), found.alias("s")))
        return without(map_texts(without(both, ["_th", "_spans"]), "_both", added, _removed(length, kept)), ["_both"])

    hashed = base.select(F.xxhash64(f"`{text}`").alias("_th"), *[F.col(f"`{c}`") for c in base.columns])
    close, far = (hashed.mapInArrow(_held(bits, docs.sparkSession, inside), hashed.schema) for inside in (True, False))
    joined = close.join(spans.select(F.col("th").alias("_th"), F.col("spans").alias("_spans")), "_th", "left")
    # texts that the bitmap rules out lose nothing: what they get is worked out without a second Python worker in the task
    data = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    none = {x: F.lit(0).cast("long") for x in ("n_removed", "n_spans", "longest")}
    whole = {"n_bytes": F.octet_length(data).cast("long"), **none, "kept_sha256": F.sha2(data, 256)} | ({"kept": data} if kept else {})
    return cut(joined, F.col("_spans")).unionByName(without(far.withColumns(whole), ["_th"]))
