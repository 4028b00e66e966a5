"""Language ID by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.rows import map_texts

RESULT = "lang_pred string, score double"
UNKNOWN = "und"
# Text is parsed in blocks of this many symbols; a phrase ends where its block ends.
BLOCK = 1024
LANES = 2048


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def points(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(text: str) -> tuple[np.ndarray, int]:
    """Code points with each run of other characters than letters as one space, and the number of letters."""
    p = points(text)
    letter = _letters()[p]
    p = np.where(letter, p, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return p[keep], int(letter.sum())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all pieces of a text; state 0 is the start."""
    step, link, longest, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Model:
    """One automaton per language over a common alphabet, as tables of steps.

    A step that the automaton lacks ends a phrase and starts the next with the same symbol. An entry holds the row of the
    next state (already multiplied by the size of the alphabet) times two, plus one if a phrase has ended.
    """

    def __init__(self, samples: dict[str, str], rows: dict[str, int]):
        text = {x: p for x, (p, letters) in ((x, folded(t)) for x, t in samples.items()) if letters}
        self.langs = sorted(text, key=lambda x: (-rows.get(x, 0), x))
        found = np.unique(np.concatenate([*text.values(), np.array([32], np.uint32)])) if text else np.array([32], np.uint32)
        # symbols: 0 no text (padding), 1 a letter no sample has, then the letters of the samples
        self.alphabet = np.ones(0x110000, np.uint8 if len(found) < 250 else np.int32)
        self.alphabet[found] = np.arange(2, len(found) + 2)
        self.width = len(found) + 2
        self.tables, self.bits = [], []
        for x in self.langs:
            step = suffix_automaton(self.alphabet[text[x]].tolist())
            table = np.zeros((len(step), self.width), np.int64)
            start = np.zeros(self.width, np.int64)
            for c, to in step[0].items():
                start[c] = to
            table[:] = start * self.width * 2 + 1
            table[0] = start * self.width * 2 + (start == 0)
            for s, steps in enumerate(step):
                for c, to in steps.items():
                    table[s, c] = to * self.width * 2
            table[:, 0] = np.arange(len(step)) * self.width * 2
            self.tables.append(table.reshape(-1).astype(np.int32) if table.max() < 2**31 else table.reshape(-1))
            self.bits.append(math.log2(max(2, len(text[x]))))

    def phrases(self, blocks: np.ndarray) -> np.ndarray:
        """Phrases of each block (a row of symbols, padded with 0) for each language."""
        out = np.zeros((len(self.tables), len(blocks)), np.int64)
        steps = np.ascontiguousarray(blocks.T)
        for k, table in enumerate(self.tables):
            state = np.zeros(len(blocks), table.dtype)
            ended = np.zeros(len(blocks), np.int32)
            for column in steps:
                entry = table.take(state + column)
                ended += entry & 1
                state = entry >> 1
            out[k] = ended + 1
        return out

    def predict(self, texts: list[str | None], untrained: str = UNKNOWN) -> tuple[list[str], list[float]]:
        """The language of fewest normalised phrases for each text, and how clear the choice is."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        blocks: list[np.ndarray] = []
        owner: list[int] = []
        total = np.zeros((len(self.tables), len(texts)))

        def flush() -> None:
            if blocks:
                grid = np.zeros((len(blocks), max(map(len, blocks))), np.int32)
                for i, b in enumerate(blocks):
                    grid[i, : len(b)] = b
                for k, row in enumerate(self.phrases(grid)):
                    np.add.at(total[k], owner, row)
                blocks.clear()
                owner.clear()

        if not self.tables:
            return [untrained if t and folded(t)[1] else UNKNOWN for t in texts], scores
        some = []
        for d, text in enumerate(texts):
            if not text:
                continue
            p, letters = folded(text)
            if not letters:
                continue
            some.append(d)
            symbols = self.alphabet[p]
            for a in range(0, len(symbols), BLOCK):
                blocks.append(symbols[a : a + BLOCK])
                owner.append(d)
                if len(blocks) >= LANES:
                    flush()
        flush()
        bits = np.array(self.bits)
        for d in some:
            entropy = total[:, d] * bits
            best = int(np.argmin(entropy))
            rest = np.delete(entropy, best)
            langs[d] = self.langs[best]
            scores[d] = float(rest.min() / (rest.min() + entropy[best])) if len(rest) else 1.0
        return langs, scores


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", rows: int = 96, chars: int = 256, max_langs: int = 400) -> Model:
    """Learn the automata from a bounded sample: of each language ``rows`` texts, ``chars`` characters of each at a place that
    follows from a hash of the text. Both are parameters; at the defaults a language brings 24,576 characters at most.

    The distinct texts with the smallest hashes are taken, so the sample does not depend on the order of rows, on copies of
    a text or on other columns; copies count as training rows only where a tie is broken.
    Rows without a text or a language teach nothing, nor does a language whose sample has no letters. More than ``max_langs`` languages are refused, as their tables would
    not fit a task.
    """
    labelled = docs.select(F.col(f"`{lang}`").cast("string").alias("l"), F.col(f"`{text}`").alias("t")).where("l is not null and t is not null")
    size = F.length("t")
    place = F.pmod(F.xxhash64("t", F.lit(1)), F.greatest(F.lit(1).cast("long"), size - chars + 1).cast("long"))
    cut = labelled.select("l", F.xxhash64("t").alias("h"), F.col("t").substr((place + 1).cast("int"), F.lit(chars)).alias("s"))
    counts = {r.l: r.n for r in labelled.groupBy("l").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"over {max_langs} languages")
    first = cut.distinct().withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "s"))).where(F.col("r") <= rows)
    samples: dict[str, list[tuple[int, str]]] = {}
    for r in first.collect():
        samples.setdefault(r.l, []).append((r.r, r.s))
    return Model({x: " ".join(s for _, s in sorted(own)) for x, own in samples.items()}, counts)


def identify(docs: DataFrame, training: DataFrame, *, text: str = "text", lang: str = "lang", rows: int = 96, chars: int = 256, keep: Column | None = None, untrained: str = UNKNOWN) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row, from its text alone.

    The text is lower-cased, runs of other characters than letters become one space, and the rest is parsed from left to
    right into longest pieces that the sample of a language holds. The language with the fewest phrases wins, where
    phrases count log2 of the length of the sample (the cross-parsing entropy up to a factor that all languages share);
    at a tie the language with more training rows, then the smaller name. ``score`` is runner-up / (runner-up + winner),
    from 0.5 for a tie to 1 where there is one language.

    A null or empty text, and one without letters, is ``und`` with score 0; with nothing to learn from, texts with letters are
    ``untrained`` with score 0 (``und`` if not given). Labels are
    not read here, so null labels do not matter; repeated rows get the same answer each. Columns with these names are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(training, text=text, lang=lang, rows=rows, chars=chars))

    def work(column):
        langs, scores = model.value.predict(column.to_pylist(), untrained)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], None

    out = map_texts(docs, text, RESULT, work)
    return out if keep is None else out.where(keep)
