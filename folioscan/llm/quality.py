"""Quality classifier: regularised quadratic discriminant over transformed statistics of a text."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.kernel import SPACED, byte_class, chunks, inside, ngram_hashes, per_text, word_hashes, words
from folioscan.llm.rows import map_texts, without

UPPER = byte_class([(ord("A"), ord("Z"))])
DIGIT = byte_class([(ord("0"), ord("9"))])
LETTER = byte_class([(ord("A"), ord("Z")), (ord("a"), ord("z")), (0x80, 0xFF)])
STOP = byte_class([(ord(c), ord(c)) for c in ".,;:"])
LINE = byte_class([(0x0A, 0x0A)], inside=False)

NAMES = (
    "log_words", "log_word_length", "log_line_words", "upper", "digits", "marks", "stops", "repeated_words",
    "repeated_bigrams", "distinct_words", "repeated_lines", "lone_marks", "short_words", "long_words",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share on the log-odds scale, with half a case added to both sides."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _earlier(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which values equal an earlier one of the same text."""
    order = np.lexsort((np.arange(len(hashes)), hashes, owner))
    same = np.zeros(len(hashes), bool)
    h, o = hashes[order], owner[order]
    same[order[1:]] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return same


def statistics(texts) -> np.ndarray:
    """A row of transformed statistics for each text; null counts as empty."""
    rows = []
    for _, data, at in chunks(texts):
        starts, ends, first = words(data, at, SPACED)
        line_a, line_b, line_first = words(data, at, LINE)
        n, n_bytes, n_lines = np.diff(first), np.diff(at), np.diff(line_first)
        size = (ends - starts).astype(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        hashes = word_hashes(data, starts, ends)
        seen = _earlier(hashes, owner)
        follows = hashes[1:] == hashes[:-1] if len(hashes) > 1 else np.zeros(0, bool)
        runs = np.zeros(len(hashes), bool)
        runs[1:] = follows & (owner[1:] == owner[:-1])
        pairs = np.zeros(len(hashes), bool)
        if len(hashes) > 1:
            ok = np.flatnonzero(inside(first, 2, len(hashes)))
            pairs[ok] = _earlier(ngram_hashes(hashes, 2)[ok], owner[ok])
        lines = _earlier(word_hashes(data, line_a, line_b), np.repeat(np.arange(len(n)), n_lines)) if len(line_a) else np.zeros(0, bool)

        def count(kind: np.ndarray, data=data, at=at) -> np.ndarray:
            return per_text(kind[data], at)

        letters, upper, digits, stops = count(LETTER), count(UPPER), count(DIGIT), count(STOP)
        visible = per_text(size, first)
        marks = visible - letters - digits - stops
        lone = np.zeros(len(hashes), bool)
        single = size == 1
        lone[single] = ~(LETTER | DIGIT)[data[starts[single]]]
        rows.append(np.column_stack([
            np.log1p(n), np.log((visible + 4.0) / (n + 1.0)), np.log((n + 1.0) / (n_lines + 1.0)), _share(upper, letters), _share(digits, visible), _share(marks, visible), _share(stops, n),
            _share(per_text(runs, first), n), _share(per_text(pairs, first), n), _share(per_text(~seen, first), n), _share(per_text(lines, line_first), n_lines),
            _share(per_text(lone, first), n), _share(per_text(size <= 2, first), n), _share(per_text(size >= 14, first), n),
        ]))
    return np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))


class Discriminant:
    """Class means and shrunk covariances, kept as Cholesky factors."""

    def __init__(self, counts: list[float], sums: np.ndarray, squares: np.ndarray, shrink: float, pool: float):
        """Sums and sums of outer products per class (0 and 1).

        The covariance of a class is pulled towards the common one by ``pool`` and towards its own mean variance by
        ``shrink``; both weights grow where a class has few rows for the number of statistics.
        """
        d = sums.shape[1]
        total = max(1.0, sum(counts))
        means = [s / n if n else sums.sum(0) / total for s, n in zip(sums, counts, strict=True)]
        scatter = [q - n * np.outer(m, m) for q, n, m in zip(squares, counts, means, strict=True)]
        common = sum(scatter) / total
        self.known = [n > 0 for n in counts]
        self.mean, self.factor, self.base = [], [], []
        for n, m, s in zip(counts, means, scatter, strict=True):
            few = d / (d + n)
            own = s / max(1.0, n)
            mixed = (1 - max(pool, few)) * own + max(pool, few) * common
            least = max(float(np.trace(mixed)) / d, 1e-3)
            weight = max(shrink, few * shrink * 10)
            factor = np.linalg.cholesky((1 - min(weight, 0.9)) * mixed + (min(weight, 0.9) * least + 1e-6) * np.eye(d))
            self.mean.append(m)
            self.factor.append(np.linalg.inv(factor))
            self.base.append(math.log((n + 1) / (total + 2)) - float(np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1: the logistic of the difference of the log-densities, prior included."""
        if not all(self.known):
            return np.full(len(x), 0.5 if not any(self.known) else float(self.known[1]))
        log_density = [b - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, b in zip(self.mean, self.factor, self.base, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0], -500, 500)))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", shrink: float = 0.02, pool: float = 0.1) -> Discriminant:
    """Fit the classes on all labelled rows. Each task returns the sums of its rows only, which are added up in Spark.

    Rows without a label of 0 or 1, or without a document, teach nothing; a document with several labels counts for each.
    """
    marked = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1)")
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    stats = map_texts(rows, "t", "x array<double>", lambda column: ([pa.array(list(statistics(column)), pa.list_(pa.float64()))], None)).select("k", "x")
    d = len(NAMES)

    def sums(batches):
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            y = np.asarray(batch.column(0))
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                s[c] += own.sum(0)
                q[c] += own.T @ own
        flat = np.concatenate([n, s.ravel(), q.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    total = np.zeros(2 + 2 * d + 2 * d * d)
    joined = stats.join(marked, "k").select("y", "x")
    for r in joined.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[r.i] = r.v
    return Discriminant(total[:2].tolist(), total[2 : 2 + 2 * d].reshape(2, d), total[2 + 2 * d :].reshape(2, d, d), shrink, pool)


def classify(docs: DataFrame, model: Discriminant, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 if score >= threshold) to every row, from its text alone.

    Null counts as the empty text, which has statistics like any other. With labels of one class only every score is that
    class, with none 0.5. Repeated rows get the same score each; columns with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(column):
        return [pa.array(shared.value.score(statistics(column)), pa.float64())], None

    out = map_texts(without(docs, ["predicted"]), text, "score double", work)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
