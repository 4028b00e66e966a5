"""Cross-tokenizer alignment: groups of two tokenizers' ids over the same bytes, and how many texts link each pair of ids."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioscan.llm.rows import written

SPACE = "▁"
# Segments remembered in a worker (some 300 bytes each), and the most bytes of their links and groups; texts that are looked up together.
FORGET, HELD, TOGETHER, LETTERS_TOGETHER = 400_000, 64 << 20, 64, 1 << 20
# A run of texts ends when it holds so many links or texts.
RUN_LINKS, RUN_ROWS = 1 << 20, 20_000

COUNTS = "n_a long, n_b long, n_groups long, n_links long"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ends(sizes: list[int]) -> dict[int, int]:
    """For each byte offset at which a token ends the number of tokens up to there."""
    return dict(zip(accumulate(sizes), count(1)))


def slices(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """(from, to) among the tokens of a and of b, given by their sizes, for each group: the stretches between byte offsets where tokens of both end."""
    left, right = ends(a), ends(b)
    out, i, j = [], 0, 0
    for at in sorted(left.keys() & right.keys()):
        m, n = left[at], right[at]
        out.append((i, m, j, n))
        i, j = m, n
    return out


def open_marks(pieces: list[str]) -> str:
    """ASCII marks that follow a letter in no piece of a vocabulary, so that none of its tokens reaches from a letter to such a mark."""
    joined = {m for p in pieces for c, m in zip(p, p[1:]) if c.isalnum() and not c.isdecimal()}
    return "".join(m for m in map(chr, range(0x21, 0x7F)) if not m.isalnum() and m not in joined)


class Pair:
    """Two tokenizers, and the aligned segments that this worker has seen.

    Both tokenizers cut a text at the places that ``edge`` finds, and what they do on one side does not depend on the other:
    before a space behind another character than white space, since no token of either goes on behind such a space; where no piece of b holds a line feed,
    around a single one and before a mark behind a letter, if a always cuts there and no piece of b holds both.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        names = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.width = len(pieces)
        self.bits = (len(names) * len(pieces)).bit_length()
        self.alone = self.b.piece_to_id(SPACE)
        # b puts a space in front of what it encodes; behind a line feed, which no piece goes beyond, it is told apart
        self.front = self.b.encode("\n")
        places = [r"(?<=\S)(?= )"]
        if not any("\n" in p for p in pieces):
            places += [r"(?<=\S)(?=\n)", r"(?<=\S\n)(?=\S)"]
            marks = open_marks(pieces)
            places += [rf"(?<=[^\W\d_])(?=[{re.escape(marks)}])"] if marks else []
        self.edge = re.compile("|".join(places))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.counts = np.zeros((1 << 12, 4), np.int64)  # ids of a, of b, groups, and 1 if the bytes are not those of the text
        self.upto = np.zeros((1 << 12) + 1, np.int64)  # where the links of a segment end
        self.flat = np.zeros(1 << 14, np.int64)
        self.groups: list[bytes] = []
        self.held = 0

    def learn(self, segments: list[str]) -> None:
        """Align segments; one that does not begin with a space goes on behind another."""
        ours = self.a.encode_batch_fast(segments, add_special_tokens=False)
        theirs = self.b.encode([s[1:] if s[0] == " " else "\n" + s for s in segments], num_threads=1)
        a_bytes, b_bytes, a_sizes, b_sizes, width, skip = self.a_bytes, self.b_bytes, self.a_sizes, self.b_sizes, self.width, len(self.front)
        counts, codes, ends = [], [], []
        for segment, x, b in zip(segments, ours, theirs, strict=True):
            a, data = x.ids, segment.encode()
            b = (b or [self.alone]) if segment[0] == " " else b[skip:]
            same = b"".join([a_bytes[k] for k in a]) == data == b"".join([b_bytes[k] for k in b])
            parts = []
            for i, j, m, n in slices([a_sizes[k] for k in a], [b_sizes[k] for k in b]) if same else ():
                if j - i == 1 == n - m:
                    codes.append(a[i] * width + b[m])
                    parts.append(f"{a[i]}|{b[m]}")
                else:
                    codes += [x * width + y for x in a[i:j] for y in b[m:n]]
                    parts.append(f"{','.join(map(str, a[i:j]))}|{','.join(map(str, b[m:n]))}")
            counts.append((len(a), len(b), len(parts), not same))
            ends.append(len(codes))
            self.known[segment] = len(self.groups)
            self.groups.append(";".join(parts).encode())
            self.held += len(self.groups[-1])
        old, new = len(self.groups) - len(segments), len(self.groups)
        used = int(self.upto[old])
        self.counts, self.upto, self.flat = grown(self.counts, new), grown(self.upto, new + 1), grown(self.flat, used + len(codes))
        self.counts[old:new], self.upto[old + 1 : new + 1], self.flat[used : used + len(codes)] = counts, np.array(ends) + used, codes
        self.held += 8 * len(codes)

    def texts(self, texts: list[str | None], groups: bool) -> Iterator[tuple]:
        """For each text its counts, groups or their hash, and its distinct links with how often each occurs."""
        part, letters = [], 0
        for text in texts:
            part.append(text)
            letters += len(text or "")
            if len(part) >= TOGETHER or letters >= LETTERS_TOGETHER:
                yield from self._texts(part, groups)
                part, letters = [], 0
        yield from self._texts(part, groups)

    def _texts(self, texts: list[str | None], groups: bool) -> Iterator[tuple]:
        cut = [self.edge.split(" " + t) if t else [] for t in texts]
        if len(self.groups) > FORGET or self.held > HELD:
            self.clear()
        segments = list(chain.from_iterable(cut))
        new = [s for s in dict.fromkeys(segments) if s not in self.known]
        if new:
            self.learn(new)
        where = list(map(self.known.__getitem__, segments))
        at, sizes = np.array(where, np.int64), np.array(list(map(len, cut)), np.int64)
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        running = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[at], axis=0)])
        sums = running[first[1:]] - running[first[:-1]]
        owner = np.repeat(np.arange(len(texts)), sizes)
        begin, n = self.upto[at], self.upto[at + 1] - self.upto[at]
        flat = self.flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        keys, often = np.unique(np.repeat(owner, n) << self.bits | flat, return_counts=True)
        edges = np.searchsorted(keys, np.arange(len(texts) + 1) << self.bits)
        n_links = np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64).tolist()
        keys &= (1 << self.bits) - 1
        for k, (n_a, n_b, n_groups, wrong) in enumerate(sums.tolist()):
            if wrong or not sizes[k]:
                yield NOTHING
                continue
            joined = b";".join(map(self.groups.__getitem__, where[first[k] : first[k + 1]]))
            own = slice(edges[k], edges[k + 1])
            yield (n_a, n_b, n_groups, n_links[k], joined.decode() if groups else hashlib.sha256(joined).hexdigest(), keys[own], often[own])


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or one of twice the size asked for with the same beginning."""
    if len(array) >= size:
        return array
    out = np.zeros((2 * size, *array.shape[1:]), array.dtype)
    out[: len(array)] = array
    return out


NOTHING = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """One pair of tokenizers per Python worker."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    """A column of lists."""
    upto = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(flat.astype(kind)))


def _runs(key, a_path: str, b_path: str, groups: bool):
    """Batches of texts to runs: a row per text, with its links as places in the run's list, and a row that holds the list and
    how many texts of the run have each link."""

    def flush(run: int, keys: list, got: list[tuple]) -> pa.RecordBatch:
        codes, where = np.unique(np.concatenate([g[5] for g in got]), return_inverse=True)
        cuts = np.cumsum([len(g[5]) for g in got])[:-1]
        n, texts = len(got), np.bincount(where, minlength=len(codes))
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([run] * (n + 1), pa.int64()),
                pa.array([False] * n + [True]),
                pa.concat_arrays([pa.array([k.as_py() for k in keys], key), pa.nulls(1, key)]),
                *(pa.array([g[k] for g in got] + [None], pa.int64()) for k in range(4)),
                pa.array([g[4] for g in got] + [None], pa.string()),
                _lists([*np.split(where, cuts), none], np.int32),
                _lists([*(g[6] for g in got), none], np.int32),
                _lists([none] * n + [codes], np.int64),
                _lists([none] * n + [texts], np.int64),
            ],
            names=["run", "head", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "at", "times", "codes", "texts"],
        )

    def work(batches):
        from pyspark import TaskContext

        both, run = pair(a_path, b_path), TaskContext.get().partitionId() << 32
        keys, got, links = [], [], 0
        for batch in batches:
            for k, one in zip(batch.column(0), both.texts(batch.column(1).to_pylist(), groups), strict=True):
                keys.append(k)
                got.append(one)
                links += len(one[5])
                if links >= RUN_LINKS or len(got) >= RUN_ROWS:
                    yield flush(run, keys, got)
                    keys, got, links, run = [], [], 0, run + 1
        if got:
            yield flush(run, keys, got)
        pa.default_memory_pool().release_unused()

    return work


def _judge(names: list[str]):
    """The texts of a run with the counts of the run's links, which come back in any order."""

    def work(texts: pa.Table, replies: pa.Table) -> pa.Table:
        size = replies.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = np.asarray(replies["place"])
        count[place], best[place] = np.asarray(replies["count"]), np.asarray(replies["best"])
        at, times = (pa.concat_arrays(texts[c].chunks) for c in ("at", "times"))
        upto = np.asarray(at.offsets)
        flat, often = np.asarray(at.values)[upto[0] : upto[-1]], np.asarray(times.flatten())
        upto = upto - upto[0]

        def sums(values: np.ndarray) -> pa.Array:
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
            return pa.array(total[upto[1:]] - total[upto[:-1]])

        columns = [texts[c] for c in ("key", "n_a", "n_b", "n_groups", "n_links", "groups")]
        return pa.table([*columns, sums(often * best[flat]), sums(often * count[flat])], names=names)

    return work


def align(docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """The alignment of two tokenizers over every text: ``key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``; with
    ``groups``, ``groups`` holds the groups themselves in place of their hash.

    Tokenizer a is a byte-level vocabulary of the tokenizers library and encodes a space and the text, with the strings of special tokens as
    plain text; b is a sentencepiece model, which adds the space itself. The byte offsets at which tokens of both end are the common keys of
    two dictionaries from end to index; sorted, they slice both lists of ids into groups, and each id of a is linked to each id of b of
    its group. Groups are written ``a1,a2|b1;a3|b2,b3``. The count of a pair of ids is the number of rows that hold it linked;
    ``count_sum`` adds it up over the links of a row, and ``n_best`` counts the links whose count is the highest of their a.

    Texts are cut where both tokenizers always cut (``Pair``), so segments are aligned once per worker and remembered. A run of texts keeps its links once, as a list; the counts of lists are added up in Spark, and each
    run gets the counts of its own list back, so nothing that grows with the input is broadcast, and a frequent pair is one row per run.

    A null or empty text, or one whose tokens of a or b do not give back its bytes, has no tokens: zeros and an empty text
    for the groups. Repeated rows count as rows each; null keys are kept; an empty table gives an empty table; other columns are
    ignored, whatever their names. A very long text is a run of its own and takes some 200 bytes of memory a word.
    """
    spark = docs.sparkSession
    field = docs.schema[next(c for c in docs.columns if c.lower() == key.lower())]
    base = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = T.StructType([T.StructField("run", T.LongType()), T.StructField("head", T.BooleanType()), T.StructField("key", field.dataType), *T._parse_datatype_string(COUNTS), *T._parse_datatype_string("groups string, at array<int>, times array<int>, codes array<long>, texts array<long>")])
    runs = written(base.mapInArrow(_runs(to_arrow_type(field.dataType), a_path, b_path, groups), kind), "aligned")

    lists = runs.where("head").select("run", F.posexplode(F.arrays_zip("codes", "texts")).alias("place", "x")).select("run", "place", "x.codes", "x.texts")
    width = _width(b_path)
    totals = lists.groupBy(F.col("codes").alias("code")).agg(F.sum("texts").alias("count"))
    best = F.max("count").over(Window.partitionBy(F.floor(F.col("code") / width)))
    totals = written(totals.withColumn("best", (F.col("count") == best).cast("int")), "pair-counts")
    replies = lists.drop("texts").join(totals, F.col("codes") == F.col("code")).select(F.col("run").alias("back"), "place", "count", "best")

    names = [key, "n_a", "n_b", "n_groups", "n_links", "groups" if groups else "groups_sha256", "n_best", "count_sum"]
    out = T.StructType([T.StructField(key, field.dataType), *T._parse_datatype_string(f"{COUNTS}, {names[5]} string, n_best long, count_sum long")])
    texts = runs.where("not head").drop("head", "codes", "texts")
    return texts.groupBy("run").cogroup(replies.groupBy("back")).applyInArrow(_judge(names), out)


def _width(b_path: str) -> int:
    """The number of ids of a sentencepiece model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
