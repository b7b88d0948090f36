"""Graph operators over edge tables (src, dst, link_type, link_source): bounded traversals as chains of equi-joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomline.session import cut_lineage, remove_folder, shared_folder

#: Nodes of a frontier up to which they are broadcast; beyond, a hop is a shuffled join.
BROADCAST_NODES = 100_000


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges to follow from ``src``: out, in, or both ways."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return {"out": lambda: edges, "in": lambda: back, "both": lambda: edges.unionByName(back)}[direction]()


@contextmanager
def kept(step: DataFrame) -> Iterator[DataFrame]:
    """The edges as a table in the shared folder while a walk lasts: edges that are joins themselves aren't made anew for each hop.

    What the walk returns must not read them any more.
    """
    spark = step.sparkSession
    path = f"{shared_folder(spark)}/edges-{uuid.uuid4().hex}"
    step.write.parquet(path)
    try:
        yield spark.read.schema(step.schema).parquet(path)
    finally:
        remove_folder(spark, path)


def few(nodes: DataFrame) -> DataFrame:
    """Checkpointed nodes, to be broadcast if they are few: then no hop shuffles the edges."""
    return F.broadcast(nodes) if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else nodes


def bfs(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "out", frontier_cap: int | None = None) -> DataFrame:
    """(node, depth) of every node within ``depth`` hops; roots at 0. A cap limits each hop to its first nodes by name.

    A hop joins the edges with the frontier and leaves out what was seen; each frontier is checkpointed, so that no hop is
    walked twice.
    """
    seen = frontier = cut_lineage(roots.select(F.col("node"), F.lit(0).alias("depth")).distinct())
    with kept(edges.select("src", "dst")) as own:
        step = oriented(own, direction)
        for d in range(1, depth + 1):
            found = step.join(few(frontier.select(F.col("node").alias("src"))), "src").select(F.col("dst").alias("node")).distinct()
            frontier = found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
            if frontier_cap is not None:
                frontier = frontier.orderBy("node").limit(frontier_cap)
            frontier = cut_lineage(frontier)
            seen = seen.unionByName(frontier)
    return seen


def traverse(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """The nodes of ``bfs`` with their number of outgoing links."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    return bfs(edges, roots, depth, direction).join(out, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def paths(edges: DataFrame, root: str, depth: int, link_type: str | None = None, direction: str = "out") -> DataFrame:
    """(src, dst, link_type, depth) of every step of simple paths from the root; a path never visits a node twice."""
    own = edges if link_type is None else edges.filter(F.col("link_type") == link_type)
    with kept(own.select("src", "dst", "link_type")) as all_of:
        step = oriented(all_of, direction)
        at = out = cut_lineage(step.filter(F.col("src") == root).withColumn("depth", F.lit(1)).withColumn("path", F.array("src", "dst")).filter("src <> dst"))
        for d in range(2, depth + 1):
            ahead = step.join(few(at.select(F.col("dst").alias("src"), "path")), "src").filter(~F.array_contains("path", F.col("dst")))
            at = cut_lineage(ahead.select("src", "dst", "link_type", F.lit(d).alias("depth"), F.concat("path", F.array("dst")).alias("path")))
            out = out.unionByName(at)
    return out.select("src", "dst", "link_type", "depth").distinct()


def fanout(edges: DataFrame, seeds: DataFrame, depth: int = 2, types: Sequence[str] | None = None, direction: str = "both", mentions: bool = False) -> DataFrame:
    """Per reached node: smallest hop, number of distinct edges that reach it, sorted types; seeds are left out."""
    e = edges if types is None else edges.filter(F.col("link_type").isin(*types))
    if not mentions:
        e = e.filter(~F.col("link_source").eqNullSafe("mentions"))
    at = cut_lineage(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    reached = None
    with kept(e.select("src", "dst", "link_type", F.xxhash64("src", "dst", "link_type", F.coalesce("link_source", F.lit(""))).alias("edge"))) as own:
        step = oriented(own, direction)
        frontier = at
        for d in range(1, depth + 1):
            hop = cut_lineage(step.join(few(frontier.select(F.col("node").alias("src"))), "src").select(F.col("dst").alias("node"), "link_type", "edge", F.lit(d).alias("hop")))
            reached = hop if reached is None else reached.unionByName(hop)
            frontier = cut_lineage(hop.select("node", "hop").distinct().join(at.select("node"), "node", "left_anti"))
            at = at.unionByName(frontier)
    return (
        reached.join(seeds.select("node"), "node", "left_anti")
        .groupBy("node")
        .agg(F.min("hop").alias("hop"), F.countDistinct("edge").alias("edge_count"), F.array_join(F.sort_array(F.collect_set("link_type")), ",").alias("types"))
    )


#: Hops of a fan-out with paths at most.
MOST_HOPS = 3


def fanout_paths(
    edges: DataFrame, seeds: DataFrame, depth: int = 2, types: Sequence[str] | None = None, direction: str = "both", mentions: bool = False, most: int = 50, live: DataFrame | None = None, chunks: DataFrame | None = None
) -> DataFrame:
    """The nearest and best linked nodes of ``fanout`` with a shortest path from a seed, and each page's first chunk.

    (node, hop, edge_count, types, path, chunk_id). Each node first reached in a hop keeps a pointer to the least of the nodes it was
    reached from, a row a node; paths are put together from the pointers for the ``most`` returned nodes alone. ``live``:
    the nodes that may be walked, all by default. ``chunks``: (node, ordinal, chunk_id). Ties go to the smaller name.
    """
    e = edges if types is None else edges.filter(F.col("link_type").isin(*types))
    if not mentions:
        e = e.filter(~F.col("link_source").eqNullSafe("mentions"))
    if live is not None:
        for end in ("src", "dst"):
            e = e.join(live.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    start = cut_lineage(seeds.select("node").distinct())
    seen, frontier = start, start
    reached, pointers = None, None
    with kept(e.select("src", "dst", "link_type", F.xxhash64("src", "dst", "link_type", F.coalesce("link_source", F.lit(""))).alias("edge"))) as own:
        step = oriented(own, direction)
        for d in range(1, min(depth, MOST_HOPS) + 1):
            hop = cut_lineage(step.join(few(frontier.select(F.col("node").alias("src"))), "src").select(F.col("src").alias("parent"), F.col("dst").alias("node"), "link_type", "edge", F.lit(d).alias("hop")))
            reached = hop if reached is None else reached.unionByName(hop)
            new = cut_lineage(hop.groupBy("node").agg(F.min("parent").alias("parent")).join(seen, "node", "left_anti"))
            pointers = new if pointers is None else pointers.unionByName(new)
            frontier = new.select("node")
            seen = seen.unionByName(frontier)
    counted = reached.join(start, "node", "left_anti").groupBy("node").agg(F.min("hop").alias("hop"), F.countDistinct("edge").alias("edge_count"), F.array_join(F.sort_array(F.collect_set("link_type")), ",").alias("types"))
    out = counted.orderBy("hop", F.desc("edge_count"), "node").limit(most).withColumn("path", F.array("node")).withColumn("at", F.col("node"))
    steps = pointers.select(F.col("node").alias("at"), "parent")
    for _ in range(min(depth, MOST_HOPS)):
        out = out.join(steps, "at", "left").withColumn("path", F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), "path"))).withColumn("at", F.col("parent")).drop("parent")
    out = out.drop("at")
    if chunks is None:
        return out.withColumn("chunk_id", F.lit(None).cast("long"))
    first = chunks.join(F.broadcast(out.select("node")), "node", "left_semi").groupBy("node").agg(F.min_by("chunk_id", F.struct("ordinal", "chunk_id")).alias("chunk_id"))
    return out.join(first, "node", "left")


def meeting(edges: DataFrame, a: DataFrame, b: DataFrame, hops: int = 2, cap: int = 1000, mentions: bool = False) -> DataFrame:
    """(node, hop_a, hop_b, hops): nodes between two seeds, found from both sides at once.

    Each side walks half the way, with at most ``cap`` nodes a hop; where the walks meet, the sum of hops is the length of a
    way between the seeds. Seeds themselves are left out.
    """
    e = edges if mentions else edges.filter(~F.col("link_source").eqNullSafe("mentions"))
    both = connects(*(bfs(e, s, hops, "both", cap).withColumnRenamed("depth", "hop") for s in (a, b)))
    return both.join(a.select("node").unionByName(b.select("node")), "node", "left_anti")


def connects(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that both fan-outs reach, nearest first by the sum of hops."""
    x, y = a.select("node", F.col("hop").alias("hop_a")), b.select("node", F.col("hop").alias("hop_b"))
    return x.join(y, "node").withColumn("hops", F.col("hop_a") + F.col("hop_b"))


def backlink_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Inbound links of every node, zeros kept; links found as mere mentions don't count, links without a source do."""
    n = edges.filter(~F.col("link_source").eqNullSafe("mentions")).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(n, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Within a set (node, source_id): distinct linking nodes of the set, and distinct other sources among them."""
    s = nodes.select(F.col("node").alias("src"), F.col("source_id").alias("src_source"))
    d = nodes.select(F.col("node").alias("dst"), F.col("source_id").alias("dst_source"))
    inside = edges.filter("src <> dst").join(s, "src").join(d, "dst")
    return inside.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("hits"), F.countDistinct(F.when(F.col("src_source") != F.col("dst_source"), F.col("src_source"))).alias("cross_hits"))


def orphans(nodes: DataFrame, edges: DataFrame, exempt: Column | None = None) -> DataFrame:
    """Nodes that no live link points at, but for those where that is no finding."""
    out = nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return out if exempt is None else out.filter(~exempt)


def most_connected(edges: DataFrame, n: int) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(n)


def dead_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti")


def backlink_gaps(edges: DataFrame) -> DataFrame:
    """Pairs where one links to the other but not back."""
    e = edges.select("src", "dst").distinct()
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")


def callers(resolved: DataFrame, unresolved: DataFrame, symbol: str, column: str = "to_symbol") -> DataFrame:
    """Edges into (or, by ``from_symbol``, out of) a symbol, resolved and unresolved ones alike."""
    return resolved.unionByName(unresolved, allowMissingColumns=True).filter(F.col(column) == symbol)


def code_walk(edges: DataFrame, symbol: str, depth: int, most: int = 200) -> DataFrame:
    """Callees within ``depth`` (node, depth, confidence, sink, cycle, cut, truncated), the nearest ``most`` of them.

    Confidence is clamp(1 / (1 + 0.3 d), 0.05, 1); a sink calls nothing; ``cycle``: it calls itself or a node on its way from the
    root, each node's way leading over the least of those that reached it first; ``cut``: it has callees beyond the last hop
    that the walk didn't see; ``truncated``: the walk has more nodes than are returned.
    """
    e = cut_lineage(edges.select(F.col("from_symbol").alias("src"), F.col("to_symbol").alias("dst")).distinct())
    start = e.sparkSession.createDataFrame([(symbol, [symbol])], "node string, way array<string>")
    seen = frontier = start.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        hop = frontier.select(F.col("node").alias("src"), "way").join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.min_by("way", "src").alias("way"))
        frontier = cut_lineage(hop.join(seen.select("node"), "node", "left_anti").select("node", F.concat("way", F.array("node")).alias("way"), F.lit(d).alias("depth")))
        seen = seen.unionByName(frontier)
    total = seen.count()
    found = seen.orderBy("depth", "node").limit(most)
    calls = found.select("node", "way").join(e.withColumnRenamed("src", "node"), "node").join(seen.select(F.col("node").alias("dst"), F.lit(True).alias("met")), "dst", "left")
    flags = calls.groupBy("node").agg(F.bool_or(F.array_contains("way", F.col("dst"))).alias("cycle"), F.bool_or(F.col("met").isNull()).alias("cut"))
    conf = F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1 / (1 + 0.3 * F.col("depth"))))
    out = found.join(flags, "node", "left")
    return out.select("node", "depth", conf.alias("confidence"), F.col("cycle").isNull().alias("sink"), F.coalesce("cycle", F.lit(False)).alias("cycle"), F.coalesce("cut", F.lit(False)).alias("cut"), F.lit(total > most).alias("truncated"))


#: Neighbours of a chunk that a hop takes, hops at most, and chunks of a symbol that become anchors.
NEIGHBOURS, EXPAND_HOPS, NEAR_MOST = 50, 2, 50


def expand_anchors(anchors: DataFrame, edges: DataFrame, hops: int = EXPAND_HOPS, near: DataFrame | None = None) -> DataFrame:
    """(chunk, score, hop, source) of anchors (chunk, score) and the chunks around them over code edges (src, dst), both ways.

    A hop takes the first ``NEIGHBOURS`` of each chunk, by number, and gives them its score over 1 + hop; a chunk that
    several reach takes the best. ``near``: chunks (chunk) of a symbol asked for, anchors too, with the best anchor's score
    (1 without anchors); of these the first ``NEAR_MOST``.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    seen = anchors.groupBy("chunk").agg(F.max("score").alias("score")).withColumn("hop", F.lit(0))
    if near is not None:
        best = F.coalesce(anchors.agg(F.max("score")).scalar(), F.lit(1.0))
        more = near.select("chunk").distinct().orderBy("chunk").limit(NEAR_MOST).join(seen.select("chunk"), "chunk", "left_anti")
        seen = seen.unionByName(more.select("chunk", best.alias("score"), F.lit(0).alias("hop")))
    seen = frontier = cut_lineage(seen)
    for hop in range(1, min(hops, EXPAND_HOPS) + 1):
        met = frontier.select(F.col("chunk").alias("src"), "score").join(both, "src")
        first = met.withColumn("n", F.row_number().over(W.partitionBy("src").orderBy("dst"))).filter(F.col("n") <= NEIGHBOURS)
        new = first.groupBy(F.col("dst").alias("chunk")).agg((F.max("score") / (1 + hop)).alias("score")).join(seen.select("chunk"), "chunk", "left_anti")
        frontier = cut_lineage(new.withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen.withColumn("source", F.when(F.col("hop") == 0, "anchor").otherwise("neighbor"))


def resolve(names: DataFrame, exact: DataFrame, fuzzy: DataFrame, prefix: DataFrame, fallback: Column) -> DataFrame:
    """The first of four ways that finds a slug for each name: exact, fuzzy (best score of 0.4 or more), prefix (most links), made up."""
    best = fuzzy.filter("score >= 0.4").withColumn("__n", F.row_number().over(W.partitionBy("name").orderBy(F.desc("score"), "slug"))).filter("__n = 1").select("name", F.col("slug").alias("f"))
    pre = prefix.withColumn("__n", F.row_number().over(W.partitionBy("name").orderBy(F.desc("links"), "slug"))).filter("__n = 1").select("name", F.col("slug").alias("p"))
    out = names.join(exact.select("name", F.col("slug").alias("e")), "name", "left").join(best, "name", "left").join(pre, "name", "left")
    how = F.when(F.col("e").isNotNull(), "exact").when(F.col("f").isNotNull(), "fuzzy").when(F.col("p").isNotNull(), "prefix").otherwise("new")
    return out.select("name", F.coalesce("e", "f", "p", fallback).alias("slug"), how.alias("how"))
