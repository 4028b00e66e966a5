"""LM scoring: a Katz backoff model of word pairs with Good-Turing discounts, counted and looked up by exchange of packed runs.

A run is a bounded piece of the corpus: the tokens of some whole texts as indices into its own list of words. Runs ask the owners of
words and of word pairs (tasks, by hash) for counts with sorted, compressed lists, and get answers in the same order. So each
distinct word and pair of a run is sent once, however frequent it is, and no table is larger in one place than its share.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.kernel import LOWER, SPACED, chunks, mix, word_hashes, words
from folioscan.llm.rows import written
from folioscan.session import ensure_checkpoint_dir

RUN_TOKENS = 1 << 20
SMALL = 5  # counts up to here are discounted
END = np.uint64(0x5DEECE66D1234567)
UNKNOWN, START, FIRST = 0, 1, 2

ANSWER = "kind int, run long, bucket int, a binary, b binary, c binary, stats array<double>"
REPLY, STATS, HOT, TABLE = range(4)


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers from 0 up as compressed planes of bytes; rising values as differences."""
    values = np.asarray(values, np.uint64)
    if rising and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, kind.itemsize).T
    head = bytes([kind.itemsize, rising]) + len(values).to_bytes(8, "little")
    return head + zstandard.compress(planes.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    size, rising, n = raw[0], raw[1], int.from_bytes(raw[2:10], "little")
    planes = np.frombuffer(zstandard.decompress(raw[10:]) if n else b"", np.uint8).reshape(size, n)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(f"u{size}").astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if rising else values


def discounts(n: list[float]) -> list[float]:
    """Factors for the counts 1 to SMALL from the numbers of events that occur 1, 2, ... SMALL + 1 times: Good and Turing's as Katz
    scales them, up to the highest count for which all lie between 0 and 1; half an event less where there is none."""
    for k in range(SMALL, 0, -1):
        if min(n[: k + 1]) <= 0:
            continue
        top = (k + 1) * n[k] / n[0]
        if top >= 1:
            continue
        d = [((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return d + [1.0] * (SMALL - k)
    return [1 - 0.5 / r for r in range(1, SMALL + 1)]


@dataclass
class Words:
    """The lower order: discounted shares of the words, and what is left for all unknown words together."""

    total: int
    distinct: int
    factors: np.ndarray
    unknown: float
    scale: float

    @staticmethod
    def of(total: int, distinct: int, n: list[float]) -> Words:
        d = discounts(n)
        left = sum((1 - d[r - 1]) * r * n[r - 1] for r in range(1, SMALL + 1)) / total if total else 1.0
        scale = 1.0
        if total and left <= 0:
            left, scale = 1 / (total + 1), total / (total + 1)
        return Words(total, distinct, np.array([0.0, *d]), left, scale)

    def share(self, count: np.ndarray) -> np.ndarray:
        """The probability of a word that occurs so often; that of an unknown word at 0."""
        factor = np.where(count <= SMALL, self.factors[np.minimum(count, SMALL).astype(np.int64)], 1.0)
        return np.where(count > 0, self.scale * factor * count / max(1, self.total), self.unknown)


def _runs(key_type: pa.DataType, run_tokens: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        keys, train, sizes, hashes, have = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            found, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            size, known = np.concatenate(sizes), np.array(train, bool)
            counts = np.bincount(tokens[np.repeat(known, size)], minlength=len(found))
            columns = [
                pa.array([number], pa.int64()), pa.array([keys], pa.list_(key_type)), pa.array([known.tolist()], pa.list_(pa.bool_())), pa.array([size.tolist()], pa.list_(pa.int64())),
                pa.array([pack(tokens)], pa.binary()), pa.array([pack(found, True)], pa.binary()), pa.array([pack(counts)], pa.binary()), pa.array([int(counts.sum())], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["run", "keys", "train", "sizes", "tokens", "hashes", "counts", "learned"])

        for batch in batches:
            for row, data, at in chunks(batch.column(2)):
                low = LOWER[data]
                starts, ends, first = words(low, at, SPACED)
                keys += [x.as_py() for x in batch.column(0)[row : row + len(at) - 1]]
                train += batch.column(1)[row : row + len(at) - 1].to_pylist()
                hashes.append(np.insert(word_hashes(low, starts, ends), first[1:], END))
                sizes.append(np.diff(first) + 1)
                have += len(hashes[-1])
                if have >= run_tokens:
                    yield flush()
                    keys, train, sizes, hashes, have = [], [], [], [], 0
                    number += 1
        if keys:
            yield flush()

    return work


def _ask_words(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, n = unpack(hashes), unpack(counts)
                owner = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(owner, kind="stable")
                cut = np.searchsorted(owner[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                parts = [order[cut[b] : cut[b + 1]] for b in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([run] * len(full), pa.int64()), pa.array([pack(h[p], True) for p in parts], pa.binary()), pa.array([pack(n[p]) for p in parts], pa.binary())],
                    names=["bucket", "run", "a", "b"],
                )

    return work


def _answer(rows: list[tuple]) -> pa.Table:
    names = ["kind", "run", "bucket", "a", "b", "c", "stats"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _own_words(buckets: int, hot: float):
    """Counts of the words of one bucket. The id of a word is its rank by count within the bucket times the number of buckets
    plus the bucket, so frequent words have small ids in all of them."""

    def work(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        asked = [unpack(x.as_py()) for x in table["a"]]
        found, back = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.zeros(len(found), np.int64)
        np.add.at(counts, back, np.concatenate([unpack(x.as_py()) for x in table["b"]]).astype(np.int64))
        rank = np.empty(len(found), np.int64)
        rank[np.lexsort((found, -counts))] = np.arange(len(found))
        ids = np.where(counts > 0, FIRST + rank * buckets + b, UNKNOWN)
        rows, at = [], 0
        for run, h in zip(table["run"].to_pylist(), asked, strict=True):
            mine = back[at : at + len(h)]
            rows.append((REPLY, run, b, pack(ids[mine]), pack(counts[mine]), None, None))
            at += len(h)
        seen = counts > 0
        rows.append((STATS, None, b, None, None, None, [float(counts.sum()), float(seen.sum()), *(float((counts == r).sum()) for r in range(1, SMALL + 2))]))
        rows += [(HOT, None, b, None, None, None, [float(ids[i]), float(counts[i])]) for i in np.flatnonzero(counts > hot)]
        rows.append((TABLE, None, b, pack(found[seen], True), pack(counts[seen]), pack(ids[seen]), None))
        return _answer(rows)

    return work


class Run:
    """One run with the ids and counts of its words, and its distinct word pairs in the order in which they are asked for."""

    def __init__(self, left: pa.Table, replies: list[dict], buckets: int, hot: np.ndarray):
        row = {name: left[name][0].as_py() for name in left.column_names}
        self.run, self.keys, self.train, self.sizes = row["run"], row["keys"], np.array(row["train"], bool), np.array(row["sizes"], np.int64)
        self.tokens, hashes = unpack(row["tokens"]).astype(np.int64), unpack(row["hashes"])
        owner = (hashes % np.uint64(buckets)).astype(np.int64)
        n = len(hashes)
        self.ids, self.counts = np.zeros(n + 2, np.int64), np.zeros(n + 2, np.int64)
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(buckets + 1))
        for r in replies:
            mine = order[cut[r["bucket"]] : cut[r["bucket"] + 1]]
            self.ids[mine], self.counts[mine] = unpack(r["a"]), unpack(r["b"])
        self.ids[n], self.ids[n + 1] = START, UNKNOWN
        w = np.where(self.ids[self.tokens] == UNKNOWN, n + 1, self.tokens)
        v = np.concatenate([[n], w[:-1]])
        v[np.concatenate([[0], np.cumsum(self.sizes)[:-1]])] = n
        self.word, self.known_before = w, self.ids[v] != UNKNOWN
        pair = v[self.known_before] * (n + 2) + w[self.known_before]
        found, self.back = np.unique(pair, return_inverse=True)
        times = np.bincount(self.back[np.repeat(self.train, self.sizes)[self.known_before]], minlength=len(found))
        pv, pw = self.ids[found // (n + 2)], self.ids[found % (n + 2)]
        spread = np.isin(pv, hot)
        bucket = (mix(pv.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.where(spread, pw + 1, 0).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((pw, pv, bucket))
        self.pv, self.pw, self.times, self.spread = pv[self.order], pw[self.order], times[self.order], spread[self.order]
        self.pw_count = self.counts[found % (n + 2)][self.order]
        self.cut = np.searchsorted(bucket[self.order], np.arange(buckets + 1))


def _ask_pairs(buckets: int, hot: np.ndarray):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        run = Run(left, right.to_pylist(), buckets, hot)
        full = np.flatnonzero(np.diff(run.cut))
        rows = [(b, run.run, *(pack(x[run.cut[b] : run.cut[b + 1]], rising) for x, rising in ((run.pv, True), (run.pw, False), (run.pw_count, False), (run.times, False)))) for b in full]
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["bucket", "run", "v", "w", "c", "n"])

    return work


def _own_pairs(words_: Words, hot: np.ndarray):
    """Counts of the word pairs of one bucket, and of each context what its backoff weight needs."""

    def work(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        parts = [[unpack(x.as_py()) for x in table[name]] for name in ("v", "w", "c", "n")]
        v, w, c, n = (np.concatenate(x).astype(np.int64) for x in parts)
        if len(v) and max(int(v.max()), int(w.max())) < 1 << 31:
            _, at, back = np.unique((v << 32) | w, return_index=True, return_inverse=True)
        else:
            _, at, back = np.unique(np.stack([v, w]), axis=1, return_index=True, return_inverse=True)
            back = back.reshape(-1)
        counts = np.zeros(len(at), np.int64)
        np.add.at(counts, back, n)
        uv, seen = v[at], counts > 0
        share = np.where(seen, words_.share(c[at]), 0.0)
        begin = np.flatnonzero(np.concatenate([[True], uv[1:] != uv[:-1]]))
        context = uv[begin]
        small = np.stack([np.add.reduceat((counts == r).astype(np.int64), begin) for r in range(1, SMALL + 1)], 1)
        large = np.add.reduceat(np.where(counts > SMALL, counts, 0), begin)
        mass = np.add.reduceat(share, begin)
        which = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(uv))))
        bare = (small.sum(1) == 0) & ~np.isin(context, hot)
        value = counts * 2 + bare[which]
        rows, start = [], 0
        for run, mine in zip(table["run"].to_pylist(), parts[0], strict=True):
            pick = back[start : start + len(mine)]
            start += len(mine)
            need = np.unique(which[pick[counts[pick] == 0]])
            need = need[~np.isin(context[need], hot)]
            stats = np.column_stack([small[need], large[need], mass[need]]).astype(np.float64)
            rows.append((REPLY, run, b, pack(value[pick]), zstandard.compress(np.ascontiguousarray(stats.T).tobytes(), 1), None, None))
        rows.append((STATS, None, b, None, None, None, [float((counts == r).sum()) for r in range(1, SMALL + 2)]))
        for k in np.flatnonzero(np.isin(context, hot)):
            rows.append((HOT, None, b, None, None, None, [float(context[k]), *map(float, small[k]), float(large[k]), float(mass[k])]))
        rows.append((TABLE, None, b, pack(uv[seen], True), pack(counts[seen]), pack(w[at][seen]), None))
        return _answer(rows)

    return work


def _weights(stats: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The backoff weight of each context from (numbers of successors by small count, sum of large counts, share of the successors)."""
    r = np.arange(1, SMALL + 1)
    total = stats[:, :SMALL] @ r + stats[:, SMALL]
    kept = stats[:, :SMALL] @ (r * factors[1:]) + stats[:, SMALL]
    left = np.where(kept < total, 1 - kept / np.maximum(total, 1), 1 / (total + 1))
    weight = left / np.maximum(1 - stats[:, SMALL + 1], 1e-300)
    return np.where(total > 0, weight, 1.0)


def _score(buckets: int, words_: Words, factors: np.ndarray, hot: np.ndarray, hot_stats: np.ndarray):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.to_pylist()
        run = Run(left, [r for r in answers if r["order"] == 1], buckets, hot)
        size = len(run.pv)
        value, weight, bare = np.zeros(size, np.int64), np.ones(size), np.zeros(size, bool)
        context = np.zeros(size)
        for r in answers:
            if r["order"] != 2:
                continue
            lo, hi = run.cut[r["bucket"]], run.cut[r["bucket"] + 1]
            got = unpack(r["a"]).astype(np.int64)
            value[lo:hi], bare[lo:hi] = got >> 1, got & 1
            unseen = (value[lo:hi] == 0) & ~run.spread[lo:hi]
            stats = np.frombuffer(zstandard.decompress(r["b"]), np.float64).reshape(SMALL + 2, -1).T
            names, back = np.unique(run.pv[lo:hi][unseen], return_inverse=True)
            if len(names):
                weight[lo:hi][unseen] = _weights(stats, factors)[back]
        if run.spread.any():
            at = np.searchsorted(hot, run.pv[run.spread])
            weight[run.spread] = _weights(hot_stats, factors)[at]
            bare[run.spread] = (hot_stats[:, :SMALL].sum(1) == 0)[at]
        # how often a context occurs is the count of its word; of the start, that of the end
        by_id = dict(zip(run.ids[:-2].tolist(), run.counts[:-2].tolist(), strict=True))
        by_id[START] = run.starts = int(run.counts[run.tokens[run.sizes[0] - 1]]) if len(run.sizes) else 0
        names, back = np.unique(run.pv, return_inverse=True)
        context = np.array([by_id[x] for x in names.tolist()], np.float64)[back] if size else context
        factor = np.where(value <= SMALL, factors[np.minimum(value, SMALL)], 1.0)
        seen = factor * value / np.where(bare, context + 1, np.maximum(context, 1))
        pair = np.empty(size)
        pair[run.order] = np.log10(np.where(value > 0, seen, weight * words_.share(run.pw_count)))
        own = run.counts[run.word]
        each = np.log10(words_.share(own))
        each[run.known_before] = pair[run.back]
        base = np.log10((own + 1) / (words_.total + words_.distinct + 1))
        begin = np.concatenate([[0], np.cumsum(run.sizes)[:-1]])
        n = len(run.sizes)
        return pa.table({
            "k": pa.array(run.keys, left["keys"].type.value_type),
            "n_tokens": pa.array(run.sizes),
            "n_known": pa.array(np.add.reduceat((own > 0).astype(np.int64), begin)),
            "train_tokens": pa.array([words_.total] * n, pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, begin)),
            "score": pa.array(np.add.reduceat(each, begin)),
        })

    return work


def _sums(answers: DataFrame) -> list[float]:
    """The sum of the figures of all buckets; a handful of numbers whatever the size of the corpus."""
    rows = answers.where(F.col("kind") == STATS).select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    return [r.x for r in sorted(rows)]


def score_texts(docs: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text", run_tokens: int = RUN_TOKENS) -> DataFrame:
    """Score every text with a model learned from the rows where ``train`` is true: ``key, n_tokens, n_known, train_tokens,
    base_score, score``.

    Tokens are the words between ASCII white space after A-Z are lower-cased, then one end. ``score`` is the log10 probability of the
    text: P(w | v) = d * c(vw) / c(v) where the pair was seen, with the Good-Turing discount d for counts up to 5, else
    a(v) * P(w), where a(v) makes the sum over all words exactly 1; P(w) likewise, with what the discounts leave for the unknown
    words, which are one event. After an unknown word P(w) alone holds. A context of which all pairs are frequent gives 1 / (c + 1) to
    the others. ``base_score`` adds one to each count instead and has no context.

    Steps: runs are encoded once and stored in buckets by run, so later joins do not move them; counts of words and of pairs live
    in tables that are partitioned by word and by first word. A first word with more than a quarter of a bucket's share of the
    tokens is dealt out by both words, and the sums of these few are added up apart. What reaches the driver: sums of counts,
    and at most four such words a bucket.

    A null or empty text has the end only. A null train flag counts as false. Without training rows every word is unknown and every score 0.
    Repeated rows are counted and scored each. Other columns are ignored. Words go by 64-bit hashes. No rows give none.
    """
    spark = docs.sparkSession
    field = docs.schema[next(c for c in docs.columns if c.lower() == key.lower())]
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text}`").alias("t"))
    kind = field.dataType.simpleString()
    layout = f"run long, keys array<{kind}>, train array<boolean>, sizes array<long>, tokens binary, hashes binary, counts binary, learned long"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"katz_{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    rows.mapInArrow(_runs(to_arrow_type(field.dataType), run_tokens), layout).write.bucketBy(parts, "run").option("path", folder).saveAsTable(name)
    runs = spark.table(name)

    learned = runs.agg(F.sum("learned")).first()[0] or 0
    buckets = max(parts, math.ceil(learned / run_tokens))
    hot_over = learned / (4 * buckets)
    asked = runs.select("run", "hashes", "counts").mapInArrow(_ask_words(buckets), "bucket int, run long, a binary, b binary")
    first = written(asked.groupBy("bucket").applyInArrow(_own_words(buckets, hot_over), ANSWER), "words")
    total, distinct, *n = _sums(first) or [0.0] * (SMALL + 3)
    words_ = Words.of(int(total), int(distinct), n)
    frequent = [int(r.stats[0]) for r in first.where(F.col("kind") == HOT).select("stats").collect()]
    hot = np.array(sorted([START, *frequent]), np.int64)

    one = first.where(F.col("kind") == REPLY).select("run", "bucket", "a", "b")
    pairs = runs.groupBy("run").cogroup(one.groupBy("run")).applyInArrow(_ask_pairs(buckets, hot), "bucket int, run long, v binary, w binary, c binary, n binary")
    second = written(pairs.groupBy("bucket").applyInArrow(_own_pairs(words_, hot), ANSWER), "pairs")
    factors = np.array([0.0, *discounts(_sums(second) or [0.0] * (SMALL + 1))])
    place = {int(v): i for i, v in enumerate(hot)}
    hot_stats = np.zeros((len(hot), SMALL + 2))
    each = second.where(F.col("kind") == HOT).select(F.col("stats")[0].alias("v"), F.posexplode("stats").alias("i", "x")).groupBy("v", "i").agg(F.sum("x").alias("x")).where("i > 0")
    for r in each.collect():
        hot_stats[place[int(r.v)], r.i - 1] = r.x

    two = second.where(F.col("kind") == REPLY).select("run", "bucket", "a", "b")
    answers = one.withColumn("order", F.lit(1)).unionByName(two.withColumn("order", F.lit(2)))
    result = f"k {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_score(buckets, words_, factors, hot, hot_stats), result)
    return scored.withColumnRenamed("k", key)
