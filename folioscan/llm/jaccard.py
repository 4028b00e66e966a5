"""N-gram Jaccard join: MinHash banding, then verification on the full n-gram sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.kernel import LOWER, SPACED, chunks, inside, mix, ngram_hashes, word_hashes, words
from folioscan.llm.rows import Bits, map_texts, unclashed, without, written

# A block of sets that are compared in one task: at most about so many n-grams and so many sets.
BLOCK_GRAMS = 1 << 18
BLOCK_SETS = 256


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The number of bands of so many rows that finds a pair of that similarity with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def gram_sets(texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of n words in a row of each text, ascending, and where each text begins (one more entry at the end).

    A text of fewer words, but not none, has one n-gram of all its words.
    """
    out, sizes = [], []
    for _, data, at in chunks(texts):
        low = LOWER[data]
        starts, ends, first = words(low, at, SPACED)
        hashes, count = word_hashes(low, starts, ends), np.diff(first)
        grams = ngram_hashes(hashes, n)
        where = np.flatnonzero(inside(first, n, len(hashes))) if len(grams) else np.zeros(0, np.int64)
        found, owner = [grams[where]], [np.searchsorted(first, where, "right") - 1]
        for k in range(1, n):
            few = np.flatnonzero(count == k)
            if len(few):
                found.append(ngram_hashes(hashes, k)[first[:-1][few]])
                owner.append(few)
        h, o = np.concatenate(found), np.concatenate(owner)
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        out.append(h[new])
        sizes.append(np.bincount(o[new], minlength=len(at) - 1))
    size = np.concatenate([np.zeros(1, np.int64), *sizes])
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum(size)


def summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the values of each text, modulo 2**64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def band_keys(hashes: np.ndarray, at: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """For each text with n-grams a key per band: a hash of the minima under the band's random orders, and of its number."""
    draw = np.random.default_rng(seed)
    full = np.flatnonzero(at[:-1] < at[1:])
    keys = np.zeros((len(full), bands), np.uint64)
    if not len(full):
        return keys
    short, begin = (hashes >> np.uint64(16)).astype(np.uint32), at[:-1][full]
    for b in range(bands):
        key = np.full(len(full), b + 1, np.uint64)
        for _ in range(rows):
            odd, add = np.uint32(draw.integers(1 << 31) * 2 + 1), np.uint32(draw.integers(1 << 32))
            order = short * odd
            order += add
            order ^= order >> np.uint32(15)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(order, begin))
        keys[:, b] = key
    return keys


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """Add ``_set`` (the hash of the n-gram set, null without words), ``_n`` (its size) and ``_bands`` (a key per band)."""

    def part(column):
        hashes, at = gram_sets(column, n)
        size = np.diff(at)
        keys = band_keys(hashes, at, bands, rows)
        offsets = np.concatenate([[0], np.cumsum((size > 0) * bands)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), signed(np.ascontiguousarray(keys).reshape(-1)))
        return pa.array(summed(mix(hashes), at).view(np.int64), pa.int64(), mask=size == 0), pa.array(size, pa.int64()), lists

    def work(column):  # few texts at a time, so that the memory follows the texts and not the batch
        parts = [part(column.slice(k, 1000)) for k in range(0, len(column), 1000)]
        return [pa.concat_arrays(x) for x in zip(*parts, strict=True)], None

    return map_texts(docs, text, "_set long, _n long, _bands array<long>", work)


def _wanted_sets(n: int, bits):
    """The sets of the texts that the bitmap does not rule out; of copies in one task, one."""

    def work(batches):
        done: set[int] = set()
        for batch in batches:
            names = np.asarray(batch.column(0))
            pick = []
            for i in np.flatnonzero(bits.value.maybe(names)).tolist():
                if names[i] not in done:
                    done.add(int(names[i]))
                    pick.append(i)
            if pick:
                hashes, at = gram_sets(batch.column(1).take(pa.array(pick)), n)
                raw = [hashes[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names[pick], pa.int64()), pa.array(raw, pa.binary())], names=["th", "grams"])

    return work


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each set of b: values that many sets share as products of 0-1 matrices,
    the others occurrence by occurrence."""
    total = np.zeros((len(a), len(b)), np.int64)
    ha, hb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(ha, hb)
    if not len(shared):
        return total
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    at_a, at_b = (np.minimum(np.searchsorted(shared, h), len(shared) - 1) for h in (ha, hb))
    in_a, in_b = shared[at_a] == ha, shared[at_b] == hb
    rows_a, at_a, rows_b, at_b = rows_a[in_a], at_a[in_a], rows_b[in_b], at_b[in_b]
    count_a, count_b = np.bincount(at_a, minlength=len(shared)), np.bincount(at_b, minlength=len(shared))
    common = count_a * count_b > 16

    order = np.argsort(at_b, kind="stable")
    rows_b, at_b = rows_b[order], at_b[order]
    begin = np.cumsum(count_b) - count_b
    rare = ~common[at_a]
    times = count_b[at_a[rare]]
    left = np.repeat(rows_a[rare], times)
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    right = rows_b[np.repeat(begin[at_a[rare]], times) + step]
    total += np.bincount(left * len(b) + right, minlength=total.size).reshape(total.shape)

    place = np.cumsum(common) - 1
    left_rows, left_at = rows_a[common[at_a]], place[at_a[common[at_a]]]
    right_rows, right_at = rows_b[common[at_b]], place[at_b[common[at_b]]]
    wide = max(64, (1 << 19) // max(total.shape))
    for lo in range(0, int(common.sum()), wide):
        x, y = np.zeros((len(a), wide), np.float32), np.zeros((len(b), wide), np.float32)
        pick = (left_at >= lo) & (left_at < lo + wide)
        x[left_rows[pick], left_at[pick] - lo] = 1
        pick = (right_at >= lo) & (right_at < lo + wide)
        y[right_rows[pick], right_at[pick] - lo] = 1
        total += (x @ y.T).astype(np.int64)
    return total


def _verify(percent: int):
    """Compare the sets of a block, or of two blocks, of the sets that share a leader; one row per set with its links."""

    def work(table: pa.Table) -> pa.Table:
        ids, side, weight = np.asarray(table["id"]), np.asarray(table["side"]), np.asarray(table["copies"])
        leader, one = table["leader"][0].as_py(), table["bi"][0].as_py() == table["bj"][0].as_py()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["grams"]]
        smaller = [np.array([y for y in x.as_py() if y < leader], np.int64) for x in table["leaders"]]
        a = np.arange(len(ids)) if one else np.flatnonzero(side == 0)
        b = a if one else np.flatnonzero(side == 1)
        links, root = np.zeros(len(ids), np.int64), ids.copy()
        if len(a) and len(b):
            size = np.array([len(s) for s in sets])
            both = intersections([sets[i] for i in a], [sets[i] for i in b])
            near = 100 * both >= percent * (size[a][:, None] + size[b][None, :] - both)
            # a pair with several common leaders belongs to the smallest
            near &= intersections([smaller[i] for i in a], [smaller[i] for i in b]) == 0
            if one:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = a[i], b[j]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            while True:  # each set takes the smallest id that it reaches
                before = root.copy()
                low = np.minimum(root[i], root[j])
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                if (before == root).all():
                    break
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links), "root": pa.array(root, pa.int64())})

    return work


def components(edges: DataFrame) -> DataFrame:
    """(id, label) with the smallest id of each connected component, from edges (id, root). Labels spread along the edges and
    then jump to the label of their label, so the number of rounds grows with the logarithm of the longest chain."""
    both = written(edges.select(F.col("id").alias("u"), F.col("root").alias("v")).union(edges.select(F.col("root").alias("u"), F.col("id").alias("v"))).distinct(), "edges")
    label = written(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.min("u")).alias("label")), "labels")
    while True:
        heard = both.join(label.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.min("label").alias("near"))
        low = label.join(heard, "id").select("id", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        far = label.select(F.col("id").alias("low"), F.col("label").alias("next"))
        jumped = written(low.join(far, "low").select("id", F.least("low", "next").alias("label"), "was"), "labels")
        label = jumped.select("id", "label")
        if jumped.where("label <> was").isEmpty():
            return label


def _classes(rowed: DataFrame, n: int, percent: int, recall: float, rows: int) -> tuple[DataFrame, DataFrame]:
    """For rows (k, t, th): the rows with words as (k, th, id), and for each set (id, label, class_id, n_links)."""
    bands = bands_for(percent / 100, recall, rows)
    prints = written(fingerprints(rowed, "t", n, bands, rows).drop("t").where("_set is not null").withColumnRenamed("_set", "id"), "fingerprints")
    sets = prints.groupBy("id").agg(F.count("*").alias("copies"), F.min("_n").alias("size"), F.min("th").alias("th"))

    banded = prints.select("id", "_bands").dropDuplicates(["id"]).select("id", F.explode("_bands").alias("band"))
    groups = banded.groupBy("band").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").select("band", "leader")
    member = written(banded.join(groups, "band").groupBy("id", "leader").agg(F.lit(1).alias("one")).drop("one"), "members")
    wanted = written(sets.join(member.groupBy("id").agg(F.collect_set("leader").alias("leaders")), "id"), "wanted")

    bits = rowed.sparkSession.sparkContext.broadcast(Bits.of(wanted, "th"))
    full = rowed.select("th", "t").mapInArrow(_wanted_sets(n, bits), "th long, grams binary")
    known = written(full.join(wanted, "th").dropDuplicates(["id"]), "sets")

    load = member.join(known.select("id", "size"), "id").groupBy("leader").agg(F.count("*").alias("m"), F.sum("size").alias("grams_in"))
    cut = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("grams_in") / BLOCK_GRAMS)).cast("int")
    placed = member.join(load.select("leader", cut.alias("cut")), "leader").withColumn("own", F.pmod(F.xxhash64("id", "leader"), "cut").cast("int"))
    other = placed.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    pairs = other.select("id", "leader", F.least("own", "to").alias("bi"), F.greatest("own", "to").alias("bj"), (F.col("own") > F.col("to")).cast("int").alias("side"))
    blocks = pairs.join(known, "id").groupBy("leader", "bi", "bj")
    checked = written(blocks.applyInArrow(_verify(percent), "id long, links long, root long"), "checked")
    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    label = components(checked.where("id <> root").select("id", "root").distinct())

    per_set = sets.join(links, "id", "left").join(label, "id", "left").select("id", F.coalesce("label", "id").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per_set = written(per_set, "classes")
    member_rows = prints.select("k", "th", "id")
    least = member_rows.join(per_set, "id").groupBy("label").agg(F.min("k").alias("class_id"))
    return member_rows, per_set.join(least, "label")


def _rowed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.xxhash64(f"`{text}`").alias("th"))


def similar(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, recall: float = 0.9999, rows: int = 6) -> DataFrame:
    """Every row with its near-duplicate class: adds ``class_id`` and ``n_links``.

    Words are what stands between ASCII white space after A-Z are lower-cased; a text is the set of its n words in a row (all
    words where it has fewer). Two texts are linked if ``100 * |A and B| >= percent * |A or B|``. ``n_links`` counts the other rows
    linked to a row, copies included. ``class_id`` is the smallest key of the connected component of links.

    1. Texts with equal sets are one set with a number of copies. 2. Each set has ``rows`` minima in each of as many bands as
    find a pair at the threshold with probability ``recall`` (31 bands at the defaults). 3. Shuffled on the band keys, the smallest set of a
    band becomes its leader; sets of one leader are candidates. 4. They are compared on full sets, block against block of
    bounded size, so a large group is many tasks (a bitmap of fixed size spares the shuffle most sets without candidates); each set gets its number of links and a root, pairs are never written.
    5. Roots are joined to components.

    A null or empty text, or one of white space, links to nothing and is a class of its own. A null key is left out of the
    minimum, so a class of null keys has a null id. Repeated rows are copies. Columns with these names are replaced. Sets and texts go
    by 64-bit hashes.
    """
    base = without(docs, ["class_id", "n_links", "_text"])
    member_rows, classes = _classes(_rowed(base, key, text), n, percent, recall, rows)
    by_text = member_rows.groupBy("th").agg(F.min("id").alias("id")).join(classes, "id").select(F.col("th").alias("_text"), "class_id", "n_links")
    out = base.withColumn("_text", F.xxhash64(f"`{text}`")).join(by_text, "_text", "left")
    own = F.coalesce("class_id", F.when(F.col("n_links").isNull(), F.col(f"`{key}`")))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, recall: float = 0.9999, rows: int = 6) -> DataFrame:
    """Only one row of each class of ``similar``: that with the smallest key; of several such rows one with the smallest hash of
    its text. Rows without words all stay. The columns are those of ``docs``."""
    columns = docs.columns
    base = without(docs, ["_key", "_text"])
    member_rows, classes = _classes(_rowed(base, key, text), n, percent, recall, rows)
    first = member_rows.join(classes, "id").where(F.col("k").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("th").alias("th"), F.min("k").alias("k"))
    times = member_rows.groupBy("k", "th").agg(F.count("*").alias("times"))
    chosen = written(first.alias("f").join(times.alias("t"), F.col("f.k").eqNullSafe(F.col("t.k")) & (F.col("f.th") == F.col("t.th"))).select(F.col("f.k").alias("_key"), F.col("f.th").alias("_text"), "times"), "chosen")
    wordy = F.rlike(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    hashed = base.where(wordy).withColumn("_hash", F.xxhash64(f"`{text}`"))
    found = hashed.join(chosen, F.col(f"`{key}`").eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_text")))
    single, repeated = found.where("times = 1"), found.where("times > 1").dropDuplicates(["_key", "_text"])
    return unclashed(single, columns).union(unclashed(repeated, columns)).union(unclashed(base.where(~wordy), columns))
