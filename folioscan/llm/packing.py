"""Cost-balanced packing of tokenized texts into training sequences."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.alignment import byte_letters
from folioscan.llm.kernel import chunks, word_hashes

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, cost double"

# Texts of ASCII and of Latin letters only are split here: they have no composed forms, odd white space or special tokens.
PLAIN = re.compile("[\t\n\r\x20-;=-~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u0233]*")
SPACE, LETTER, DIGIT, MARK = range(4)
KINDS = np.full(256, MARK, np.uint8)
KINDS[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
KINDS[ord("0") : ord("9") + 1] = DIGIT
KINDS[ord("a") : ord("z") + 1] = LETTER
KINDS[0x80:] = LETTER
FORGET = 500_000
# The letter by which the vocabulary file writes each byte.
BYTE_LEVEL = {b: letter for letter, b in byte_letters().items()}


def split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of lower-cased plain texts as the vocabulary file defines them.

    Fixed values: a run of letters, one digit, a run of other marks, or one of 's 't 'm 'd 're 've 'll where a run of marks
    would begin.
    """
    kind = KINDS[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    edge[at] = True
    quote = np.flatnonzero(data == ord("'"))
    quote = quote[edge[quote]]
    for tail in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        q = quote[quote + len(tail) < len(data)]
        for k, c in enumerate(tail, 1):
            q = q[data[q + k] == c]
            q = q[~np.isin(q + k, at)] if len(q) else q
        edge[q + 1] = False
        edge[q + 1 + len(tail)] = True
    bounds = np.flatnonzero(edge)
    if len(bounds) < 2:
        return bounds[:0], bounds[:0]
    full = kind[bounds[:-1]] != SPACE
    return bounds[:-1][full], bounds[1:][full]


class Encoder:
    """Ids of texts by the vocabulary file. The ids of a piece do not depend on its neighbours, so the library encodes
    each piece once; texts that are not plain go to it whole. Which pieces are known is kept in arrays, not piece by piece."""

    def __init__(self, path: str, end: int | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.end = b"" if end is None else np.array([end], np.uint32).tobytes()
        self._forget()

    def _forget(self) -> None:
        """No pieces known: their hashes in order, and where the ids of each begin and end in ``ids``."""
        self.known, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids and the end id, as unsigned little-endian 32-bit numbers."""
        plain = [t.lower() if t and PLAIN.fullmatch(t) else "" for t in texts]
        coded = (x for _, data, at in chunks(pa.array(plain, pa.string())) for x in self._plain(data, at))
        for text, easy, got in zip(texts, plain, coded, strict=True):
            if text and not easy:
                got = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
            yield got + self.end

    def _plain(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        starts, ends = split(data, at)
        if not len(starts):
            return [b""] * (len(at) - 1)
        names, first, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > FORGET:
            self._forget()
        new = self._place(names)[1]
        if new.any():
            self._learn(names[new], data, starts[first[new]], ends[first[new]])
        place = self._place(names)[0][back]
        each, begin = self.size[place], self.begin[place]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = self.ids[np.repeat(begin - upto[:-1], each) + np.arange(upto[-1])].tobytes()
        cut = 4 * upto[np.searchsorted(starts, at)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _place(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands or would stand among the known ones, and which are new."""
        place = np.searchsorted(self.known, names)
        new = place == len(self.known)
        new[~new] = self.known[place[~new]] != names[~new]
        return place, new

    def _learn(self, names: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode the pieces and keep their ids."""
        text, tokenize = data.tobytes(), self.model.tokenize
        coded = [tokenize(text[a:b].decode("latin-1").translate(BYTE_LEVEL)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter([t.id for own in coded for t in own], np.uint32, size.sum())
        begin = self.used + np.cumsum(size) - size
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        place = np.searchsorted(self.known, names)
        self.known, self.begin, self.size = (np.insert(x, place, y) for x, y in ((self.known, names), (self.begin, begin), (self.size, size)))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end: int | None) -> Encoder:
    """One encoder per Python worker."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def cost(length: int, linear: float, quadratic: float) -> float:
    """Estimated work for a piece: its feed-forward part and its attention to itself."""
    return linear * length + quadratic * length * length


def pack(lengths: list[int], size: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[float]]:
    """Pieces (text, start, length, sequence, offset), and the length and cost of each sequence.

    Whole multiples of the sequence size become sequences of their own. The rests are taken in descending order (ties: the
    earlier text first), each to the sequence with the lowest cost among those with room for it; only one that fits
    nowhere is cut, over the sequences with the most room. The number of sequences is the least possible, and the tokens
    of the last, unfilled one lie in sequences whose lengths are powers of two, so nothing is padded.
    """
    pieces, filled, costs = [], [], []
    rests = []
    for i, n in enumerate(lengths):
        for k in range(n // size):
            pieces.append((i, k * size, size, len(filled), 0))
            filled.append(size)
            costs.append(cost(size, linear, quadratic))
        if n % size:
            rests.append((n % size, i))
    total = sum(n for n, _ in rests)
    bins = [size] * (total // size) + [1 << b for b in range(size.bit_length(), -1, -1) if (total % size) >> b & 1]
    base = len(filled)
    room, spent = list(bins), [0.0] * len(bins)
    filled += bins
    fits: list[tuple[float, int]] = []  # sequences with room for the current rest, by cost
    tight = [(-r, k) for k, r in enumerate(bins)]  # the others, by room
    heapq.heapify(tight)

    def put(i: int, start: int, n: int, k: int) -> None:
        pieces.append((i, start, n, base + k, bins[k] - room[k]))
        room[k] -= n
        spent[k] += cost(n, linear, quadratic)
        if room[k]:
            heapq.heappush(tight, (-room[k], k))

    for n, i in sorted(rests, key=lambda x: (-x[0], x[1])):
        start = lengths[i] - n
        while tight and -tight[0][0] >= n:
            k = heapq.heappop(tight)[1]
            heapq.heappush(fits, (spent[k], k))
        if fits:
            put(i, start, n, heapq.heappop(fits)[1])
            continue
        while n:  # fits nowhere whole: cut it over the sequences with the most room
            k = heapq.heappop(tight)[1]
            take = min(n, room[k])
            put(i, start, take, k)
            n, start = n - take, start + take
    return pieces, filled, costs + spent


def pack_documents(
    docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", size: int = 2048, end: int | None = 1,
    linear: float = 1.0, quadratic: float = 1.0 / 2048, group_tokens: int = 4 << 20, ids: bool = True,
) -> DataFrame:
    """Pack the texts into sequences of at most ``size`` ids, with next to no padding; one row per piece.

    Result: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, cost`` and, with ``ids``, the ids of the
    piece. ``cost`` is the estimated cost of the whole sequence: ``linear * length + quadratic * length**2`` over its pieces.

    Each task packs the rows it has read, ``group_tokens`` at a time, so nothing is shuffled and memory is bounded by the
    group and the longest text. A group's last tokens go to sequences whose lengths are powers of two. ``sequence_id`` holds
    the task's partition in its upper bits; the same files read in the same splits give the same result.
    ``vocabulary`` is the path of a tokenizers file, the same on every executor.
    Null and empty texts have the end id only (no rows if ``end`` is None); repeated rows are packed each on its own; other
    columns of the table are ignored.
    """
    extra = ", ids array<int>" if ids else ""
    field = docs.schema[next(c for c in docs.columns if c.lower() == key.lower())]
    base = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    schema = T.StructType([T.StructField(key, field.dataType), *T._parse_datatype_string(PIECES + extra)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        code, first = encoder(vocabulary, end), (context.partitionId() if context else 0) << 33
        keys, coded, tokens = [], [], 0
        for batch in batches:
            for k, got in zip(batch.column(0), code.encode(batch.column(1).to_pylist()), strict=True):
                keys.append(k)
                coded.append(got)
                tokens += len(got) // 4
                if tokens >= group_tokens:
                    out, used = flush(keys, coded, first)
                    yield out
                    keys, coded, tokens, first = [], [], 0, first + used
        if keys:
            yield flush(keys, coded, first)[0]

    def flush(keys, coded, first) -> tuple[pa.RecordBatch, int]:
        pieces, filled, costs = pack([len(x) // 4 for x in coded], size, linear, quadratic)
        own = [coded[i][4 * a : 4 * (a + n)] for i, a, n, _, _ in pieces]
        columns = [
            pa.array([keys[p[0]].as_py() for p in pieces], batch_type),
            pa.array([p[1] for p in pieces], pa.int64()),
            pa.array([p[2] for p in pieces], pa.int64()),
            pa.array([zlib.crc32(x) for x in own], pa.int64()),
            pa.array([len(coded[p[0]]) // 4 for p in pieces], pa.int64()),
            pa.array([first + p[3] for p in pieces], pa.int64()),
            pa.array([p[4] for p in pieces], pa.int64()),
            pa.array([filled[p[3]] for p in pieces], pa.int64()),
            pa.array([costs[p[3]] for p in pieces], pa.float64()),
        ]
        if ids:
            columns.append(pa.array([np.frombuffer(x, np.uint32).astype(np.int32) for x in own], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=names), len(filled)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(field.dataType)
    return base.mapInArrow(run, schema)
