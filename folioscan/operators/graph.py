"""Walks over reference graphs.

A walk is a loop of joins from the frontier to the edges. Each round handles only the nodes whose path
became smaller, its result is written to the checkpoint folder, and the loop ends when no path
improves. Only a yes-or-no answer per round comes to the driver.
"""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions import html as H
from folioscan.functions.values import clamped_path
from folioscan.operators.ordered import numbered
from folioscan.session import cut


def graph_walk(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, doc: str = "doc_id", carry: str | None = None, start: str = "CAST(NULL AS STRING)") -> DataFrame:
    """Nodes reached from the roots in preorder: ``doc, node, path, trail, depth``.

    ``edges``: ``doc, src, dst, pos``; ``roots``: ``doc, node, pos``. Each node appears once, under the
    least path of child positions, which is where a preorder walk meets it first; so a node is
    expanded again when a smaller path to it turns up. ``trail`` holds the nodes on the path. Sorting by
    ``path`` gives the reading order. Edges to nodes that do not exist do no harm if they are left out of
    ``edges``. With ``max_depth`` deeper nodes are left out, and ``depth_capped`` marks the nodes whose children were.

    ``carry`` folds a value along the least path and adds it as ``value``: a SQL expression of ``value``, that of the parent, and ``edge``,
    a struct of the further columns of ``edges``. ``start`` gives the value of a root from the columns of ``roots``; both have one type.
    """
    links = edges.select(
        F.col(doc).alias("__doc"), F.col("src").alias("__src"), F.col("dst").alias("__dst"), F.col("pos").cast("int").alias("__pos"), further(edges, doc)
    )
    own = [] if carry is None else [F.expr(start).alias("value")]
    first = F.min(F.struct(F.array(F.col("pos").cast("int")).alias("path"), F.array(F.col("node")).alias("trail"), *own))
    frontier = cut(roots.groupBy(doc, "node").agg(first.alias("b")))
    layers = frontier
    deep = count() if max_depth is None else range(max_depth)
    for _ in deep:
        on = (F.col(doc) == F.col("__doc")) & (F.col("node") == F.col("__src"))
        folded = [] if carry is None else [F.expr(carry).alias("value")]
        step = F.struct(
            F.array_append("b.path", F.col("__pos")).alias("path"), F.array_append("b.trail", F.col("__dst")).alias("trail"), *folded
        )
        # A path back to one of its own nodes is never the least one.
        reached = (
            (frontier if carry is None else frontier.withColumn("value", F.col("b.value"))).join(links, on)
            .filter(~F.array_contains("b.trail", F.col("__dst")))
            .select(doc, F.col("__dst").alias("node"), step.alias("c"))
            .groupBy(doc, "node")
            .agg(F.min("c").alias("c"))
        )
        known = layers.groupBy(doc, "node").agg(F.min("b.path").alias("known"))
        better = F.col("known").isNull() | (F.col("c.path") < F.col("known"))
        frontier = cut(reached.join(known, [doc, "node"], "left").filter(better).select(doc, "node", F.col("c").alias("b")))
        if frontier.isEmpty():
            break
        layers = layers.unionByName(frontier)
    best = layers.groupBy(doc, "node").agg(F.min("b").alias("b"))
    carried = [] if carry is None else ["b.value"]
    out = best.select(doc, "node", "b.path", "b.trail", (F.size("b.path") - 1).alias("depth"), *carried)
    if max_depth is None:
        return out
    parents = links.select(F.col("__doc").alias(doc), F.col("__src").alias("node"), F.lit(True).alias("__more")).distinct()
    capped = (F.col("depth") >= max_depth) & F.coalesce("__more", F.lit(False))
    return out.join(parents, [doc, "node"], "left").select(*out.columns, capped.alias("depth_capped"))


def further(edges: DataFrame, doc: str) -> Column:
    """The columns of an edge beyond its ends and place, as one struct named ``edge``."""
    more = [F.col(c) for c in edges.columns if c not in (doc, "src", "dst", "pos")]
    return F.struct(*more or [F.lit(None).cast("string").alias("none")]).alias("edge")


def tree_walk(edges: DataFrame, roots: DataFrame, doc: str = "doc_id", carry: str | None = None, start: str = "CAST(NULL AS STRING)") -> DataFrame:
    """``graph_walk`` where each node has one parent: one recursive query in place of a loop of joins.

    Each level of the tree is one step, and a node is expanded once; in a graph with several ways to a node each way would be a row. A way back to one of its own nodes
    is not taken. ``carry`` and ``start`` as in ``graph_walk``; without them there is no ``value``. The result is written to the checkpoint folder, so later steps do not repeat the recursion.
    """
    spark = edges.sparkSession
    name = f"w{uuid.uuid4().hex}"
    edges.select(F.col(doc).alias("doc"), "src", "dst", F.col("pos").cast("int").alias("pos"), further(edges, doc)).createOrReplaceTempView(f"{name}_edges")
    roots.withColumn("__doc", F.col(doc)).createOrReplaceTempView(f"{name}_roots")
    query = f"""WITH RECURSIVE walk AS (
        SELECT __doc AS doc, node, array(CAST(pos AS INT)) AS path, array(node) AS trail, {start} AS value FROM {name}_roots
        UNION ALL
        SELECT walk.doc, e.dst, array_append(path, e.pos), array_append(trail, e.dst), {carry or "value"}
        FROM walk JOIN {name}_edges e ON walk.doc <=> e.doc AND walk.node = e.src WHERE NOT array_contains(trail, e.dst))
      SELECT doc AS `{doc}`, node, path, trail, size(path) - 1 AS depth{", value" if carry else ""} FROM walk"""
    limits = {f"spark.sql.cteRecursion{k}Limit": "-1" for k in ("Level", "Row")}  # the tree ends the recursion
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        return cut(spark.sql(query))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for part in ("edges", "roots"):
            spark.catalog.dropTempView(f"{name}_{part}")


def preorder(walk: DataFrame, doc: str = "doc_id", name: str = "rank") -> DataFrame:
    """Position of each node in reading order.

    The positions of one document are numbered within it; a document's nodes come from one file.
    """
    return walk.withColumn(name, F.row_number().over(W.partitionBy(doc).orderBy("path")))


def tree_edges(tree: DataFrame, doc: str, node: str = "idx", parent: str = "parent_idx") -> tuple[DataFrame, DataFrame]:
    """Edges and roots of a table of nodes with their parents; children keep the node order."""
    edges = tree.filter(F.col(parent).isNotNull()).select(
        doc, F.col(parent).alias("src"), F.col(node).alias("dst"), F.col(node).alias("pos")
    )
    roots = tree.filter(F.col(parent).isNull()).select(doc, F.col(node).alias("node"), F.col(node).alias("pos"))
    return edges, roots


def chain_places(links: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Head and place of each node in chains of links ``doc, src, dst``: ``doc, node, head, place``.

    Every node looks twice as far back in each round, so a chain of n links takes log2(n) rounds. Nodes in a ring have
    no head and are left out; of several links to one node the one from the smallest node counts.
    """
    back = links.groupBy(doc, F.col("dst").alias("node")).agg(F.min("src").alias("to"))
    nodes = links.select(doc, F.col("src").alias("node")).union(links.select(doc, "dst")).distinct()
    state = cut(nodes.join(back, [doc, "node"], "left").select(doc, "node", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("bigint").alias("place"), F.coalesce("to", "node").alias("head")))
    size, seen = state.count(), 1
    while seen <= size and not state.filter(F.col("to").isNotNull()).isEmpty():
        far = state.select(doc, F.col("node").alias("to"), F.col("to").alias("__to"), F.col("place").alias("__place"), F.col("head").alias("__head"))
        moved = F.col("to").isNotNull()
        state = cut(
            state.join(far, [doc, "to"], "left").select(
                doc, "node", F.col("__to").alias("to"), (F.col("place") + F.when(moved, F.col("__place")).otherwise(0)).alias("place"), F.when(moved, F.col("__head")).otherwise(F.col("head")).alias("head")
            )
        )
        seen *= 2
    return state.filter(F.col("to").isNull()).select(doc, "node", "head", "place")


def linked_order(nodes: DataFrame, node: str, first: str | None, following: str, doc: str = "doc_id", max_depth: int | None = None) -> DataFrame:
    """Reading order by first-child and next-sibling links; the roots are the nodes nobody links to.

    Chains of siblings become places under one parent, so the walk is as deep as the tree and not as long as its chains.
    """
    every = nodes.select(doc, F.col(node).alias("node"))
    firsts = nodes.select(doc, F.col(node).alias("parent"), F.col(first).alias("head")).filter(F.col("head").isNotNull()) if first is not None else None
    links = nodes.filter(F.col(following).isNotNull()).select(doc, F.col(node).alias("src"), F.col(following).alias("dst"))
    if firsts is not None:  # a first child begins its chain
        links = links.join(firsts.select(doc, F.col("head").alias("dst")), [doc, "dst"], "left_anti").select(doc, "src", "dst")
    chained = chain_places(links, doc)
    linked = links.select(doc, F.col("src").alias("node")).union(links.select(doc, "dst"))
    alone = every.join(linked, [doc, "node"], "left_anti").select(doc, "node", F.col("node").alias("head"), F.lit(0).cast("bigint").alias("place"))
    placed = cut(chained.unionByName(alone))
    if firsts is None:
        under, top = None, placed
    else:
        under = placed.join(firsts.groupBy(doc, "head").agg(F.min("parent").alias("parent")), [doc, "head"])
        top = placed.join(firsts.select(doc, "head").distinct(), [doc, "head"], "left_anti")
    roots = numbered(top.select(doc, "head", "place", "node"), [doc], ["head", "place"], "pos").select(doc, "node", "pos")
    edges = (
        under.select(doc, F.col("parent").alias("src"), F.col("node").alias("dst"), F.col("place").alias("pos"))
        if under is not None
        else roots.select(doc, F.col("node").alias("src"), F.col("node").alias("dst"), "pos").limit(0)
    )
    return preorder(graph_walk(edges, roots, max_depth, doc), doc)


def ancestors(walk: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pairs ``doc, ancestor, descendant, distance`` of a walk."""
    return walk.select(
        doc, F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("trail", F.lit(1), F.col("depth"))).alias("at", "ancestor")
    ).select(doc, "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def subtree_flags(walk: DataFrame, nodes: DataFrame, flag: str, doc: str = "doc_id", node: str = "node") -> DataFrame:
    """Does the flag hold for a node and everything below it?"""
    flags = walk.join(nodes.select(doc, F.col(node).alias("node"), F.col(flag).alias("flag")), [doc, "node"])
    return (
        flags.select(doc, F.explode("trail").alias("node"), "flag")
        .groupBy(doc, "node")
        .agg(F.bool_and("flag").alias("all_below"), (F.count("*") - 1).alias("descendants"))
    )


def inherit_context(edges: DataFrame, roots: DataFrame, nodes: DataFrame, value: str, doc: str = "doc_id", node: str = "node", tree: bool = True) -> DataFrame:
    """Each node's own value, else that of the nearest container that has one: ``doc, node, inherited``.

    The value goes down with the walk; ``tree`` says that each node has one parent.
    """
    own = nodes.select(F.col(doc).alias("__doc"), F.col(node).alias("__node"), F.col(value).alias("own"))

    def given(table: DataFrame, at: str) -> DataFrame:
        return table.join(own, F.col(doc).eqNullSafe(F.col("__doc")) & (F.col(at) == F.col("__node")), "left").drop("__doc", "__node")

    links, tops = given(edges.select(doc, "src", "dst", "pos"), "dst"), given(roots.select(doc, "node", "pos"), "node")
    walk = tree_walk if tree else graph_walk
    return walk(links, tops, doc=doc, carry="coalesce(edge.own, value)", start="own").select(doc, "node", F.col("value").alias("inherited"))


def asset_closure(refs: DataFrame, files: DataFrame, doc: str = "page_id", max_depth: int | None = None) -> DataFrame:
    """Files reached from the references of a document through style sheets and scripts: ``doc, path, depth``.

    The walk ends when a round finds no new file; ``max_depth`` ends it earlier. A round parses only the files that the last one reached.

    ``refs``: ``doc, path`` (absolute); ``files``: ``path, content``. Each path is listed once, files that do not exist
    only as the last step.
    """
    code = files.filter(F.col("path").rlike(r"(?i)\.(?:css|m?js)$"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)

    def links(reached: DataFrame) -> DataFrame:
        there = code.join(reached.select(F.col("node").alias("path")).distinct(), "path", "left_semi")
        found = there.select("path", F.explode(F.transform(H.asset_refs(F.col("content")), H.local_ref)).alias("ref"))
        target = F.when(F.col("ref").startswith("/"), F.col("ref")).otherwise(F.concat(folder, F.lit("/"), F.col("ref")))
        return found.filter(F.col("ref").isNotNull()).select(F.col("path").alias("node"), F.concat(F.lit("/"), clamped_path(target)).alias("dst"))

    # The same file graph serves every document: the walk runs once, over one row per starting path.
    starts = refs.select("path").distinct().select(F.col("path").alias("doc_id"), F.col("path").alias("node"), F.lit(0).alias("pos"))
    reach = cut(starts.select("doc_id", "node", F.lit(0).alias("depth")))
    frontier = reach
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        new = (
            frontier.join(links(frontier), "node")
            .select("doc_id", F.col("dst").alias("node"))
            .distinct()
            .join(reach, ["doc_id", "node"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = cut(new)
        if frontier.isEmpty():
            break
        reach = reach.unionByName(frontier)
    paths = reach.select(F.col("doc_id").alias("start"), F.col("node").alias("reached"), "depth")
    return (
        refs.join(paths, F.col("path") == F.col("start"))
        .groupBy(doc, F.col("reached").alias("path"))
        .agg(F.min("depth").alias("depth"))
    )


# The roles a list item may hold.
ITEM_ROLE, BODY_ROLE, LEGAL_ROLES = "LI", "LBody", ("Lbl", "LBody")


def wrap_illegal_children(nodes: DataFrame, edges: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Children of list items that are neither label nor body move under a new body node.

    ``nodes``: ``doc, id, role``; ``edges``: ``doc, src, dst, pos``. New ids follow the largest of the document.
    Items without such children stay untouched.
    """
    items = nodes.filter(F.col("role") == ITEM_ROLE).select(doc, F.col("id").alias("src"))
    legal = nodes.filter(F.col("role").isin(*LEGAL_ROLES)).select(doc, F.col("id").alias("dst"))
    illegal = edges.join(items, [doc, "src"], "left_semi").join(legal, [doc, "dst"], "left_anti")
    touched = illegal.groupBy(doc, "src").agg(F.min("pos").alias("pos"))
    last = nodes.groupBy(doc).agg(F.max("id").alias("last"))
    bodies = cut(
        numbered(touched, [doc], ["src"])
        .join(last, doc)
        .select(doc, "src", "pos", (F.col("last") + F.col("rn")).alias("body"))
    )
    moved = illegal.join(bodies.select(doc, "src", "body"), [doc, "src"]).select(doc, F.col("body").alias("src"), "dst", "pos")
    kept = edges.join(illegal.select(doc, "src", "dst"), [doc, "src", "dst"], "left_anti").select(doc, "src", "dst", "pos")
    inserted = bodies.select(doc, "src", F.col("body").alias("dst"), "pos")
    new_nodes = bodies.select(doc, F.col("body").alias("id"), F.lit(BODY_ROLE).alias("role"))
    return (
        nodes.select(doc, "id", "role").unionByName(new_nodes),
        kept.unionByName(moved).unionByName(inserted),
    )


def tree_table(walk: DataFrame, nodes: DataFrame, doc: str = "doc_id", node: str = "node", role: str = "role", descr: str | None = None) -> DataFrame:
    """One row per node in reading order: ``doc, node, depth, role, kids`` with kids as ``role x count``, and ``descr`` if there is one."""
    given = F.lit(None).cast("string") if descr is None else F.col(descr)
    named = walk.join(nodes.select(doc, F.col(node).alias("node"), F.col(role).alias("role"), given.alias("descr")), [doc, "node"])
    counts = (
        named.filter(F.col("depth") > 0)
        .select(doc, F.try_element_at("trail", F.lit(-2)).alias("node"), F.col("role").alias("kid"))
        .groupBy(doc, "node", "kid")
        .agg(F.count("*").alias("n"))
        .groupBy(doc, "node")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kid", "n"))), lambda k: F.concat(k["kid"], F.lit("x"), k["n"].cast("string"))), " ").alias("kids"))
    )
    return named.join(counts, [doc, "node"], "left").select(doc, "node", "path", "depth", "role", F.coalesce("kids", F.lit("")).alias("kids"), "descr")
