"""Queries over graphs: element trees of pages, places, turns and style sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.operators import elements as E
from folioscan.operators import graph as G
from folioscan.operators import joins as J
from folioscan.plans.pages import MASKED_SQL
from folioscan.plans.registry import query, table
from folioscan.session import cut

NAMES = ("nav", "ul", "li", "a", "article", "h1", "div", "footer")
NAME_SQL = ", ".join(f"'{n}'" for n in NAMES)

# The same tree by counting: the n-th opening tag of a name ends at the n-th closing tag, which holds for these names.
TREE_SQL = rf"""t AS (SELECT page_id, regexp_extract_all({MASKED_SQL}, '</?[a-zA-Z][^>]*>') AS l FROM pages),
    u AS (SELECT page_id, i - 1 AS idx, l[i] AS k, lower(regexp_extract(l[i], '^</?([a-zA-Z0-9]+)', 1)) AS tag FROM t, unnest(range(1, len(l) + 1)) AS u(i)),
    o AS (SELECT *, row_number() OVER (PARTITION BY page_id, tag ORDER BY idx) AS n FROM u WHERE tag IN ({NAME_SQL}) AND k NOT LIKE '</%'),
    c AS (SELECT *, row_number() OVER (PARTITION BY page_id, tag ORDER BY idx) AS n FROM u WHERE tag IN ({NAME_SQL}) AND k LIKE '</%'),
    s AS (SELECT o.page_id, o.idx, o.tag, c.idx AS e FROM o JOIN c USING (page_id, tag, n)),
    anc AS (SELECT d.page_id, a.idx AS ancestor, d.idx AS descendant, a.tag AS atag, d.tag AS dtag FROM s a JOIN s d ON a.page_id = d.page_id AND a.idx < d.idx AND a.e > d.e),
    tree AS (SELECT s.page_id, s.idx, s.tag, count(ancestor) AS depth, max(ancestor) AS parent_idx FROM s LEFT JOIN anc ON s.page_id = anc.page_id AND s.idx = anc.descendant GROUP BY ALL)"""


def tree(spark, sf):
    return E.element_tree(E.elements(table(spark, sf, "pages")), names=NAMES)


def walk(tree):
    return G.tree_walk(*G.tree_edges(tree, "page_id"), doc="page_id")


def written(spark, sf):
    """The tree, written to the checkpoint folder because the walks read it once per level."""
    return cut(tree(spark, sf))


@query("element_tree", f"WITH {TREE_SQL} SELECT page_id, idx, tag, depth + 1 AS depth, parent_idx FROM tree")
def element_tree(spark, sf):
    t = tree(spark, sf)
    return t.select("page_id", *[F.col(c).cast("bigint").alias(c) for c in ("idx", "depth", "parent_idx")], "tag")


@query(
    "graph_walk",
    f"WITH {TREE_SQL} SELECT page_id, idx AS node, depth, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS rank FROM tree",
)
def graph_walk(spark, sf):
    """The loop of joins, which walks graphs of any shape; the other queries over page trees use the recursive query."""
    r = G.preorder(G.graph_walk(*G.tree_edges(written(spark, sf), "page_id"), doc="page_id"), "page_id")
    return r.select("page_id", F.col("node").cast("bigint").alias("node"), F.col("depth").cast("bigint").alias("depth"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "tree_walk",
    f"WITH {TREE_SQL} SELECT t.page_id, idx AS node, depth, row_number() OVER (PARTITION BY t.page_id ORDER BY idx) AS rank, concat('', (SELECT string_agg(concat('/', atag), '' ORDER BY ancestor) FROM anc WHERE anc.page_id = t.page_id AND anc.descendant = t.idx), '/', tag) AS place FROM tree t",
)
def tree_walk(spark, sf):
    """The same order from one recursive query, which carries the names on the way down."""
    t = written(spark, sf)
    names = t.select("page_id", F.col("idx").alias("dst"), "tag")
    edges, roots = G.tree_edges(t, "page_id")
    named = roots.join(names, (roots.page_id == names.page_id) & (F.col("node") == F.col("dst"))).select(roots.page_id, "node", "pos", "tag")
    w = G.tree_walk(edges.join(names, ["page_id", "dst"]), named, doc="page_id", carry="concat(value, '/', edge.tag)", start="concat('/', tag)")
    r = G.preorder(w, "page_id")
    return r.select("page_id", *[F.col(c).cast("bigint").alias(c) for c in ("node", "depth", "rank")], F.col("value").alias("place"))


@query(
    "place_tree",
    """WITH x AS (SELECT r_regionkey AS doc_id, concat('r', r_regionkey) AS node, 0 AS depth, '' AS p FROM region
    UNION ALL SELECT n_regionkey, concat('n', n_nationkey), 1, concat('r', n_regionkey) FROM nation
    UNION ALL SELECT n_regionkey, concat('s', s_suppkey), 2, concat('n', n_nationkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT doc_id, node, depth, p AS parent FROM x""",
)
def place_tree(spark, sf):
    r, n, s = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    edges = n.select(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.col("n_nationkey").alias("pos"))
    below = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.col("s_suppkey").cast("int").alias("pos")
    )
    roots = r.select(F.col("r_regionkey").alias("doc_id"), F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(0).alias("pos"))
    w = G.tree_walk(edges.unionByName(below), roots)
    return w.select("doc_id", "node", "depth", F.coalesce(F.try_element_at("trail", F.lit(-2)), F.lit("")).alias("parent"))


@query("linked_order", "SELECT conv_id, xor(turn, 5) AS node, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations")
def linked_order(spark, sf):
    """Turns under shuffled numbers, each with a link to the next one."""
    c = table(spark, sf, "conversations").select("conv_id", "turn")

    def number(col):
        return col.bitwiseXOR(5)

    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), number(F.col("turn")).alias("next"))
    nodes = c.join(following, ["conv_id", "turn"], "left").select("conv_id", number(F.col("turn")).alias("node"), "next")
    return G.linked_order(nodes, "node", None, "next", "conv_id").select("conv_id", "node", F.col("rank").cast("bigint").alias("rank"))


@query("ancestors", f"WITH {TREE_SQL} SELECT page_id, atag, dtag, count(*) AS n FROM anc GROUP BY ALL")
def ancestors(spark, sf):
    t = written(spark, sf)
    names = t.select("page_id", "idx", "tag")
    pairs = G.ancestors(walk(t), "page_id")
    a = names.select("page_id", F.col("idx").alias("ancestor"), F.col("tag").alias("atag"))
    d = names.select("page_id", F.col("idx").alias("descendant"), F.col("tag").alias("dtag"))
    return pairs.join(a, ["page_id", "ancestor"]).join(d, ["page_id", "descendant"]).groupBy("page_id", "atag", "dtag").agg(F.count("*").alias("n"))


@query(
    "subtree_flags",
    f"""WITH {TREE_SQL}, b AS (SELECT page_id, idx AS node, idx AS below, idx % 5 <> 0 AS pure FROM s UNION ALL SELECT page_id, ancestor, descendant, descendant % 5 <> 0 FROM anc)
    SELECT page_id, node, bool_and(pure) AS all_below, count(*) - 1 AS descendants FROM b GROUP BY ALL""",
)
def subtree_flags(spark, sf):
    t = written(spark, sf)
    nodes = t.select("page_id", F.col("idx").alias("node"), (F.col("idx") % 5 != 0).alias("pure"))
    out = G.subtree_flags(walk(t), nodes, "pure", "page_id")
    return out.withColumn("node", F.col("node").cast("bigint"))


@query(
    "redundant_parents",
    f"""WITH {TREE_SQL} SELECT page_id, idx AS node, tag FROM s WHERE idx % 3 <> 0 AND EXISTS (SELECT 1 FROM anc WHERE anc.page_id = s.page_id AND anc.ancestor = s.idx AND anc.descendant % 3 = 0)""",
)
def redundant_parents(spark, sf):
    def key(idx):  # an element is named by its page and its number
        return F.struct(F.col("page_id").alias("page_id"), F.col(idx).cast("bigint").alias("idx"))

    t = written(spark, sf)
    nodes = t.select("page_id", "tag", "idx", key("idx").alias("node"), (F.col("idx") % 3 == 0).alias("described"))
    closure = G.ancestors(walk(t), "page_id").select(key("ancestor").alias("ancestor"), key("descendant").alias("descendant"))
    return J.redundant_parents(nodes, closure).select("page_id", F.col("idx").cast("bigint").alias("node"), "tag")


@query(
    "inherit_context",
    f"""WITH {TREE_SQL}, own AS (SELECT page_id, idx, idx AS holder, tag AS htag, 1000000 AS d FROM s UNION ALL SELECT page_id, descendant, ancestor, atag, ancestor FROM anc),
    h AS (SELECT page_id, idx, arg_max(concat(htag, page_id % 3), holder) AS v FROM own WHERE htag IN ('nav', 'article', 'li') GROUP BY ALL)
    SELECT s.page_id, s.idx AS node, v AS inherited FROM s LEFT JOIN h USING (page_id, idx)""",
)
def inherit_context(spark, sf):
    t = written(spark, sf)
    nodes = t.select(
        "page_id", F.col("idx").alias("node"), F.when(F.col("tag").isin("nav", "article", "li"), F.concat("tag", (F.col("page_id") % 3).cast("string"))).alias("context")
    )
    out = G.inherit_context(*G.tree_edges(t, "page_id"), nodes, "context", "page_id")
    return out.withColumn("node", F.col("node").cast("bigint"))


@query(
    "asset_closure",
    """WITH RECURSIVE f AS (SELECT p_partkey AS k FROM part), r AS (SELECT page_id, page_id % 50 AS k, 0 AS depth FROM pages
      UNION ALL SELECT r.page_id, r.k * 3 + 1, depth + 1 FROM r JOIN f ON r.k = f.k WHERE r.k % 4 <> 3)
    SELECT page_id, concat('/css/', k, '.css') AS path, min(depth) AS depth FROM r GROUP BY ALL""",
)
def asset_closure(spark, sf):
    """Style sheets made of the parts: each imports the one with three times its number plus one."""
    k = F.col("p_partkey")
    content = F.when(k % 4 != 3, F.concat(F.lit('@import "../css/./'), (k * 3 + 1).cast("string"), F.lit('.css?v=2"; p{background:url(data:x)}'))).otherwise("p{}")
    files = table(spark, sf, "part").select(F.concat(F.lit("/css/"), k.cast("string"), F.lit(".css")).alias("path"), content.alias("content"))
    refs = table(spark, sf, "pages").select("page_id", F.concat(F.lit("/css/"), (F.col("page_id") % 50).cast("string"), F.lit(".css")).alias("path"))
    return G.asset_closure(refs, files)


WRAP_SQL = f"""{TREE_SQL}, k AS (SELECT page_id, parent_idx AS src, idx AS dst, CASE WHEN idx % 3 = 0 THEN 'Lbl' ELSE 'Link' END AS role FROM tree WHERE parent_idx IS NOT NULL AND tag = 'a'),
    il AS (SELECT * FROM k WHERE role <> 'Lbl'), b AS (SELECT page_id, src, min(dst) AS pos FROM il GROUP BY ALL),
    m AS (SELECT page_id, max(idx) AS m FROM s GROUP BY 1), n AS (SELECT b.*, m + row_number() OVER (PARTITION BY page_id ORDER BY src) AS body FROM b JOIN m USING (page_id))"""


def item_tree(spark, sf):
    t = written(spark, sf)
    role = F.when(F.col("tag") == "li", "LI").when((F.col("tag") == "a") & (F.col("idx") % 3 == 0), "Lbl").when(F.col("tag") == "a", "Link").otherwise(F.col("tag"))
    nodes = t.select("page_id", F.col("idx").alias("id"), role.alias("role"))
    return G.wrap_illegal_children(nodes, G.tree_edges(t, "page_id")[0], "page_id")


@query(
    "wrap_illegal_children",
    f"""WITH {WRAP_SQL} SELECT page_id, parent_idx AS src, idx AS dst, idx AS pos FROM tree t WHERE parent_idx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM il WHERE il.page_id = t.page_id AND il.dst = t.idx)
    UNION ALL SELECT il.page_id, n.body, il.dst, il.dst FROM il JOIN n USING (page_id, src) UNION ALL SELECT page_id, src, body, pos FROM n""",
)
def wrap_illegal_children(spark, sf):
    _, edges = item_tree(spark, sf)
    return edges.select("page_id", *[F.col(c).cast("bigint").alias(c) for c in ("src", "dst", "pos")])


@query("wrapped_bodies", f"WITH {WRAP_SQL} SELECT page_id, body AS id, 'LBody' AS role FROM n")
def wrapped_bodies(spark, sf):
    nodes, _ = item_tree(spark, sf)
    return nodes.filter("role = 'LBody'").withColumn("id", F.col("id").cast("bigint"))


@query(
    "tree_table",
    f"""WITH {TREE_SQL}, kc AS (SELECT page_id, parent_idx, tag, count(*) AS n FROM tree WHERE parent_idx IS NOT NULL GROUP BY ALL),
    k AS (SELECT page_id, parent_idx, string_agg(concat(tag, 'x', n), ' ' ORDER BY tag) AS kids FROM kc GROUP BY ALL)
    SELECT t.page_id, t.idx AS node, t.depth, t.tag AS role, coalesce(kids, '') AS kids, CASE WHEN t.idx % 2 = 0 THEN concat(t.tag, t.idx) END AS descr FROM tree t LEFT JOIN k ON t.page_id = k.page_id AND t.idx = k.parent_idx""",
)
def tree_table(spark, sf):
    t = written(spark, sf)
    described = t.withColumn("descr", F.when(F.col("idx") % 2 == 0, F.concat("tag", F.col("idx").cast("string"))))
    out = G.tree_table(walk(t), described, "page_id", "idx", "tag", "descr")
    return out.select("page_id", F.col("node").cast("bigint").alias("node"), F.col("depth").cast("bigint").alias("depth"), "role", "kids", "descr")
