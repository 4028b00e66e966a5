"""The registered queries of the subpackage: each applies one operator to its whole tables and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.decontamination import decontaminate
from folioscan.llm import quality, rules
from folioscan.llm.alignment import align
from folioscan.llm.chat import format_chats
from folioscan.llm.jaccard import similar
from folioscan.llm.katz import score_texts
from folioscan.llm.language import identify
from folioscan.llm.mixing import mix_totals
from folioscan.llm.packing import pack_documents
from folioscan.llm.periodic import find_runs, run_lines
from folioscan.llm.rows import read, share
from folioscan.llm.suffixes import remove_repeats
from folioscan.llm.surrogates import replace_entities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL of the same answer where SQL can express it."""

    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_SQL = rf"regexp_extract_all({LOW.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION_SQL = f"""
WITH b AS (SELECT cast(item_id AS VARCHAR) AS item, {ALNUM_SQL} AS w FROM benchmark),
g AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {ALNUM_SQL} AS w FROM documents),
s AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, s.n, i, item FROM s JOIN g ON s.n = g.n AND s.g = g.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query("op1_decontamination", CONTAMINATION_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 13 words of the test items in all texts; contaminated from one word in twenty."""
    out = decontaminate(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op2_language_id")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every text, learned from three rows in four."""
    docs = read(spark, sf, "documents")
    out = identify(docs, docs.where(share("doc_id", 4) != 2))
    return out.select("doc_id", (share("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every text, learned from the labels of two rows in three."""
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = quality.train(docs, labels.where(share("doc_id", 3) != 1))
    out = quality.classify(docs, model)
    return out.select("doc_id", (share("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op9_packing")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """All texts in sequences of 2048 ids."""
    return pack_documents(read(spark, sf, "documents"), vocabulary(), ids=False)


@query("op10_quality_rules")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict of every text; trusted are the texts labelled as good."""
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    out = rules.apply_rules(docs, rules.fit(docs, labels.where("quality = 1")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


CHAT_SQL = """
WITH said AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations),
full_ AS (SELECT conv_id, count(*) AS n_turns, list(struct_pack(r := r, t := t) ORDER BY turn NULLS FIRST, r, t) AS l FROM said GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, l FROM full_ GROUP BY n_turns, l),
earlier AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(generate_series(1, n_turns - 1)) AS k FROM full_))
SELECT conv_id, n_turns, n_copies,
       array_to_string(list_transform(l, lambda x: concat('<|', x.r, '|>', chr(10), x.t, chr(10), '<|end|>', chr(10))), '') AS rendered
FROM one WHERE NOT EXISTS (SELECT 1 FROM earlier WHERE earlier.l = one.l)
"""


@query("op6_chat_formatting", CHAT_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations that no longer one continues, rendered."""
    return format_chats(read(spark, sf, "conversations"))


@query("op7_pii_surrogates")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """All texts with surrogates for their entities."""
    return replace_entities(read(spark, sf, "documents")).select("doc_id", "n_entities", "text")


JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOW.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN z u ON u.doc_id = x JOIN z v ON v.doc_id = y WHERE 100 * c >= 80 * (u.n + v.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, least(doc_id, (SELECT min(y) FROM r WHERE x = doc_id)) AS class_id, (SELECT count(*) FROM l WHERE x = doc_id) AS n_links FROM documents
"""


@query("op8_jaccard_join", JACCARD_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """All texts with their class of near duplicates (five words, similarity 0.8) and the number of their links."""
    return similar(read(spark, sf, "documents")).select("doc_id", "class_id", "n_links")


@query("op4_lm_scoring")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """The log10 probability of every text, learned from six rows in seven."""
    held_out = share("doc_id", 7) == 2
    out = score_texts(read(spark, sf, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_repeated_passages")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """What remains of every text without strings of 400 bytes that occur again."""
    out = remove_repeats(read(spark, sf, "documents").select("doc_id", "text"), kept=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "longest")


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS h FROM documents),
g AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST((rank - 1) % 3 + 1 AS BIGINT) AS weight, sum(n) OVER () AS budget FROM g),
o AS (SELECT *, coalesce(sum(3 * n) OVER f, 0) AS before, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS rest
  FROM w WINDOW f AS (ORDER BY CAST(3 * n AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, CAST(3 * n AS DOUBLE) / weight <= CAST(budget - before AS DOUBLE) / rest AS stopped FROM o),
t AS (SELECT source, rank, CAST(n AS BIGINT) AS n, budget, CASE WHEN stopped THEN CAST(3 * n AS DOUBLE)
    ELSE CAST(weight * (budget - coalesce(sum(3 * n) FILTER (stopped) OVER (), 0)) AS DOUBLE) / sum(weight) FILTER (NOT stopped) OVER () END AS target FROM m),
c AS (SELECT doc_id, size, n, rank, budget, target, sum(size) OVER (PARTITION BY rank ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, k * n + c AS start, least(size, floor(target) - (k * n + c)) AS words FROM c, range(3) r(k) WHERE size > 0 AND k * n + c < floor(target)),
p AS (SELECT *, sum(words) OVER (ORDER BY (start + words) / target, rank, start ROWS UNBOUNDED PRECEDING) - words AS position FROM e),
s AS (SELECT rank, c, doc_id, sum(words) AS taken, min(position) AS first_position FROM p GROUP BY ALL)
SELECT c.doc_id, CAST(c.size AS BIGINT) AS size, c.n AS source_size, c.target, CAST(coalesce(s.taken, 0) AS BIGINT) AS taken, CAST(s.first_position AS BIGINT) AS first_position
FROM c LEFT JOIN s ON c.size > 0 AND c.rank = s.rank AND c.c = s.c AND c.doc_id IS NOT DISTINCT FROM s.doc_id
"""


@query("op11_mixing", MIXING_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """What the mix of all sources to weights 1, 2, 3 takes of every text."""
    return mix_totals(read(spark, sf, "documents"))


RUNS_SQL = r"""
WITH k AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce([k] || range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(k))),
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h
  FROM documents, k),
a AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM h),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM a),
o AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
p AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
r AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM p) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
m AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.doc_id = r.doc_id AND b.q < r.q AND b.s <= r.s AND b.s + b.l >= r.s + r.l)),
f AS (SELECT doc_id, count(*) AS n_runs, max(struct_pack(l := l, s := -s, q := -q)) AS best, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM m GROUP BY doc_id),
z AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM m),
c AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM o ANTI JOIN z USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.l AS length, -best.q AS period, 1000 * best.l // -best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def planted(docs: DataFrame) -> DataFrame:
    """The texts with the tail of one in ten made periodic: from word a on each word is that p places back."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g, n = F.floor(h / 10), F.size("_w").cast("long")
    listed = docs.withColumn("_g", g).withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]++)"), F.lit(1))))
    placed = listed.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    at = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    tail = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("_w", at(i).cast("int"))), " ")
    return placed.withColumn("text", F.when(F.col("_a").isNotNull(), tail).otherwise(F.col("text"))).drop("_g", "_w", "_a", "_p")


@query("op12_periodic_runs", RUNS_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of four periods and six words or more in all texts."""
    out = find_runs(planted(read(spark, sf, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = out.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(run_lines().cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """The alignment of two tokenizers over all texts, with the counts of linked ids over the whole table."""
    out = align(read(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
