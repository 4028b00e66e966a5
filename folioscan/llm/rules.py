"""Quality rules: counts of a text, and the log-likelihood ratio of its hashed n-grams between trusted and raw text."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.rows import without, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
BUCKETS = 1 << 14
# Ratios are counted in steps of this size where the threshold is set.
STEP = 0.001
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _words(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def _after(array: str, n: int = 1) -> Column:
    """An array without its first values."""
    return F.slice(array, F.lit(n + 1), F.greatest(F.lit(0), F.size(array) - n))


def _distinct(array: Column) -> Column:
    return F.size(F.array_distinct(array)) == F.size(array)


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def base_counts(docs: DataFrame, text: str = "text", min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Add the counts of each text, and whether it fails the base rules, row by row without a shuffle.

    ``n_repeat_words`` are the words in windows of three that the text has twice or more. The windows are sorted by hash
    within the row, so a long text costs n log n.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = without(docs, [*COUNTS, "_w", "_lines", "_hashes", "_windows", "_twice"])
    one = base.withColumns({"_w": _words(F.col(f"`{text}`")), "_lines": F.array_remove(F.split(t, "\n", -1), "")})
    # hashes of three words in a row; what most texts lack, repeats, is looked for closely only where there are some
    pairs = F.zip_with("_w", _after("_w"), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    triples = F.zip_with(F.slice(pairs, F.lit(1), F.greatest(F.lit(0), F.size("_w") - 2)), _after("_w", 2), lambda p, z: F.xxhash64(p["x"], p["y"], z))
    two = one.withColumn("_hashes", triples)
    placed = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    two = two.withColumn("_windows", F.when(~_distinct(F.col("_hashes")), placed))
    twice = F.filter("_windows", lambda x, j: (F.get("_windows", j + 1)["h"] == x["h"]) | ((j > 0) & (F.get("_windows", j - 1)["h"] == x["h"])))
    three = two.withColumn("_twice", F.coalesce(F.sort_array(F.transform(F.filter(twice, lambda x: x.isNotNull()), lambda x: x["i"])), F.array().cast("array<int>")))
    filled = F.filter("_lines", lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    again = F.when(_distinct(F.col("_lines")), 0).otherwise(F.size(filled) - F.size(F.array_distinct(filled)))
    covered = F.aggregate("_twice", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")))["n"]
    out = three.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": again.cast("long"),
        "n_repeat_words": covered.cast("long"),
    })
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_lines", "_hashes", "_windows", "_twice")


def fold_of(text: Column, folds: int) -> Column:
    """The fold of a text; copies of a text share it."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit("")), F.lit(5)), F.lit(folds)).cast("int")


def bucket_counts(docs: DataFrame, text: str, folds: int) -> DataFrame:
    """(f, b, n): how many words and word pairs of the texts of each fold fall into each bucket. Words are rows here, so all of it runs in generated code."""
    words = docs.select(_words(F.col(f"`{text}`")).alias("w"), fold_of(F.col(f"`{text}`"), folds).alias("f"))
    each = words.select("f", "w", F.posexplode("w").alias("i", "x"))
    after = F.get("w", F.col("i") + 1)
    buckets = F.array(_bucket(F.col("x")), F.when(after.isNotNull(), _bucket(F.col("x"), after)))
    return each.select("f", F.explode(buckets).alias("b")).where("b is not null").groupBy("f", "b").agg(F.count("*").alias("n"))


class Rules(NamedTuple):
    """What ``fit`` learns: the ratios of the buckets for each fold, and the least ``llr`` of a text that is kept."""

    ratios: list[list[float]]
    threshold: float


def fit(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", smooth: float = 1.0, folds: int = 4, keep: float = 0.98) -> Rules:
    """The log-likelihood ratio of each bucket of hashed words and word pairs between the trusted and all rows, one list per fold.

    Texts are dealt into folds by their hash, and the list of a fold is learned from the other folds only, so that no text raises its own ratio and a text
    of the target is judged as one that the target has never seen. The threshold is the ``llr`` that ``keep`` of the texts of the target reach. Counts cover all rows; what returns to the driver is one number per fold and bucket.
    ``trusted`` holds the keys of the rows of the target; keys it repeats, null keys and keys without a row count for nothing more. With one fold all
    counts are used for all texts. With an empty target all ratios and the threshold are 0.
    """
    good = trusted.select(F.col(f"`{key}`").alias("k")).where("k is not null").distinct()
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    # all texts are shuffled once for this join; those of the target are read twice below
    target = written(rows.join(good.hint("shuffle_hash"), "k", "left_semi").select("t"), "target")

    def counted(part: DataFrame) -> list[list[int]]:
        out = [[0] * BUCKETS for _ in range(folds)]
        for r in bucket_counts(part, "t", folds).collect():
            out[r.f][r.b] = r.n
        return out

    raw, own = counted(rows.select("t")), counted(target)

    def ratios(held: int) -> list[float]:
        used = [f for f in range(folds) if f != held or folds == 1]
        r, o = ([sum(part[f][b] for f in used) for b in range(BUCKETS)] for part in (raw, own))
        if not any(o):
            return [0.0] * BUCKETS
        n_raw, n_own = sum(r) + smooth * BUCKETS, sum(o) + smooth * BUCKETS
        return [math.log((y + smooth) / n_own) - math.log((x + smooth) / n_raw) for x, y in zip(r, o, strict=True)]

    found = Rules([ratios(f) for f in range(folds)], 0.0)
    steps = F.floor(F.col("llr") / STEP).cast("long").alias("step")
    seen = sorted((r.step, r.n) for r in scored(target, found, "t").where("n_words > 0").select(steps).groupBy("step").agg(F.count("*").alias("n")).collect())
    allowed, below = (1 - keep) * sum(n for _, n in seen), 0
    for step, n in seen:
        if below + n > allowed:
            return found._replace(threshold=step * STEP)
        below += n
    return found


def scored(docs: DataFrame, rules: Rules, text: str) -> DataFrame:
    """Add ``n_words`` and ``llr``; the words stay in ``_w``."""
    # the lists of all folds one after another, so that a lookup is one place in one array
    table = F.split(F.lit(",".join(f"{x:.9g}" for own in rules.ratios for x in own)), ",").cast("array<double>")
    base = docs if "_w" in docs.columns else docs.withColumn("_w", _words(F.col(f"`{text}`")))
    base = base.withColumns({"n_words": F.size("_w").cast("long"), "_f": fold_of(F.col(f"`{text}`"), len(rules.ratios)) * BUCKETS})

    def ratio(bucket: Column) -> Column:
        return F.get(table, F.col("_f") + bucket)

    each = F.zip_with("_w", _after("_w"), lambda x, y: ratio(_bucket(x)) + F.when(y.isNull(), 0.0).otherwise(ratio(_bucket(x, y))))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return base.withColumn("llr", F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(total / (2 * F.col("n_words") - 1))).drop("_f")


def apply_rules(docs: DataFrame, rules: Rules, *, text: str = "text", min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Add the base counts, ``llr`` and ``kept`` to every row.

    ``llr`` is the sum of the ratios of the words and word pairs of the text over their number, so it does not grow with the
    length; 0 where there is no word. The ratios are those of the text's fold. A text is kept if it passes the base rules and its ``llr`` reaches the threshold: the same text always
    gets the same verdict. With an empty target the base rules decide.
    Null and empty texts have no words and fail; repeated rows get the same verdict each; columns with these names are replaced. A very long text
    is worked on whole in its row, as arrays of some 50 bytes a word.
    """
    base = base_counts(without(docs, ["llr", "kept", "_f"]), text, min_words, repeat_percent)
    out = scored(base, rules, text)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= rules.threshold)).drop("_w")
