"""Queries over joins and graph operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomline.functions import text as T
from fathomline.operators import graph as G
from fathomline.operators.components import connected_components
from fathomline.plans.catalog import query
from fathomline.session import cut_lineage, table
from fathomline.sources import views
from fathomline.sources.views import with_views


@query("j1_chunk_page_source", f"{with_views('chunks', 'sources')} SELECT chunk_id, c.page_id, s.id AS source_id FROM chunks_v c JOIN documents d ON d.doc_id = c.page_id JOIN sources_v s ON s.id = d.source WHERE NOT s.archived")
def chunk_page_source(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("source_id"))
    live = views.sources(spark, sf).filter("not archived").select(F.col("id").alias("source_id"))
    return views.chunks(spark, sf).select("chunk_id", "page_id").join(d, "page_id").join(live, "source_id").select("chunk_id", "page_id", "source_id")


@query("j2_results_pages", f"{with_views('pages')} SELECT p.page_id, p.updated_at FROM pages_v p JOIN (SELECT source AS source_id, lang || '/' || doc_id AS slug FROM documents WHERE n_chars > 3000) r ON r.source_id = p.source_id AND r.slug = p.slug")
def results_pages(spark, sf):
    p = views.pages(spark, sf)
    return p.select("page_id", "source_id", "slug", "updated_at").join(p.filter("n_chars > 3000").select("source_id", "slug"), ["source_id", "slug"]).select("page_id", "updated_at")


@query("j3_alias_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def alias_semi(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("j4_pages_usage", "SELECT c_custkey, count(o_orderkey) AS uses, count(o_orderkey) FILTER (WHERE o_totalprice > 200000) AS big FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def pages_usage(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("uses"), F.count(F.when(F.col("o_totalprice") > 200000, 1)).alias("big"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("big", F.lit(0)).alias("big"))


@query("j5_misrouted_pages", "SELECT doc_id AS slug FROM documents WHERE source = 'src0' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def misrouted_pages(spark, sf):
    d = table(spark, sf, "documents").filter("source = 'src0'").select(F.col("doc_id").alias("slug"))
    return d.join(table(spark, sf, "labels").select(F.col("doc_id").alias("slug")), "slug", "left_anti")


_NODES = "n AS (SELECT 'customers/' || c_custkey AS node FROM customer UNION ALL SELECT 'suppliers/' || s_suppkey FROM supplier UNION ALL SELECT 'nations/' || n_nationkey FROM nation)"


def _nodes(spark, sf):
    name = lambda t, p, k: table(spark, sf, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("node"))
    return name("customer", "customers/", "c_custkey").union(name("supplier", "suppliers/", "s_suppkey")).union(name("nation", "nations/", "n_nationkey"))


@query("j6_orphans", f"{with_views('links', more=_NODES)} SELECT node FROM n WHERE node NOT IN (SELECT dst FROM links_v) AND node NOT LIKE 'customers/1%'")
def orphans(spark, sf):
    return G.orphans(_nodes(spark, sf), views.links(spark, sf), F.col("node").startswith("customers/1"))


@query("j7_not_extracted", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM part WHERE substr(md5(p_partkey::VARCHAR), 1, 2) = substr(md5(doc_id::VARCHAR), 1, 2) AND p_size > 48)")
def not_extracted(spark, sf):
    key = lambda c: F.substring(F.md5(F.col(c).cast("string").cast("binary")), 1, 2).alias("k")
    p = table(spark, sf, "part").filter("p_size > 48").select(key("p_partkey"))
    return table(spark, sf, "documents").select("doc_id", key("doc_id")).join(p, "k", "left_anti").select("doc_id")


@query("j8_dangling", "SELECT l.doc_id FROM labels l LEFT JOIN events e ON e.event_id = l.doc_id * 20 WHERE e.event_id IS NULL")
def dangling(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("k"))
    return table(spark, sf, "labels").select("doc_id", (F.col("doc_id") * 20).alias("k")).join(e, "k", "left_anti").select("doc_id")


@query("j9_takes_domains", f"{with_views('takes')} SELECT domain, p_brand, count(*) AS n FROM takes_v JOIN part ON p_partkey = page_id JOIN supplier ON s_suppkey = page_id % 100 WHERE s_acctbal > 0 GROUP BY ALL")
def takes_domains(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), "p_brand")
    s = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k"))
    t = views.takes(spark, sf).select("domain", "page_id", (F.col("page_id") % 100).alias("k"))
    return t.join(p, "page_id").join(s, "k").groupBy("domain", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j10_cache_validity",
    "WITH r AS (SELECT l_orderkey AS entry, l_partkey AS page, p_size AS now, max(p.p_size + (l_quantity > 49)::INT) AS gen FROM lineitem LEFT JOIN part p ON p_partkey = l_partkey GROUP BY ALL) SELECT entry, bool_and(now IS NOT NULL AND now = gen) AS valid FROM r GROUP BY entry",
)
def cache_validity(spark, sf):
    """An entry holds a JSON object page -> generation; it is valid while every page is there with that generation."""
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("page"), F.col("p_size").alias("now"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").cast("string").alias("page"), (F.col("l_quantity") > 49).cast("int").alias("late"))
    stored = li.join(part, "page", "left").groupBy("entry", "page").agg(F.max(F.col("now") + F.col("late")).alias("gen"))
    entries = stored.groupBy("entry").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("page", "gen")))).alias("pages"))
    each = entries.select("entry", F.explode(F.from_json("pages", "map<string,int>")).alias("page", "then"))
    return each.join(part, "page", "left").groupBy("entry").agg(F.bool_and(F.col("now").isNotNull() & F.col("now").eqNullSafe(F.col("then"))).alias("valid"))


@query("j11_drift_candidates", f"{with_views('takes')}, e AS (SELECT user_id AS page_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1) SELECT id, n, weight FROM takes_v JOIN e USING (page_id) WHERE active AND quality IS NULL AND weight BETWEEN 0.3 AND 0.85 ORDER BY n DESC, weight DESC, id LIMIT 200")
def drift_candidates(spark, sf):
    e = table(spark, sf, "events").filter("ts >= timestamp '2024-01-20'").groupBy(F.col("user_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))
    t = views.takes(spark, sf).filter("active and quality is null and weight between 0.3 and 0.85")
    return t.join(e, "page_id").orderBy(F.desc("n"), F.desc("weight"), "id").limit(200).select("id", "n", "weight")


@query("j12_asof", f"{with_views('facts')} SELECT entity, metric, id, value FROM facts_v WHERE valid_from <= TIMESTAMP '2024-01-15' AND (expired_at IS NULL OR expired_at > TIMESTAMP '2024-01-15') QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY valid_from DESC, id DESC) = 1")
def asof(spark, sf):
    at = F.to_timestamp(F.lit("2024-01-15"))
    f = views.facts(spark, sf).filter((F.col("valid_from") <= at) & (F.col("expired_at").isNull() | (F.col("expired_at") > at)))
    w = W.partitionBy("entity", "metric").orderBy(F.desc("valid_from"), F.desc("id"))
    return f.withColumn("n", F.row_number().over(w)).filter("n = 1").select("entity", "metric", "id", "value")


@query("j12_asof_join", "SELECT c.event_id, max(v.ts) AS last_view FROM events c LEFT JOIN events v ON v.user_id = c.user_id AND v.event_type = 'view' AND v.ts <= c.ts WHERE c.event_type = 'purchase' GROUP BY c.event_id")
def asof_join(spark, sf):
    """General as-of join: one sort by key and time, last seen value carried forward; no range join."""
    e = table(spark, sf, "events").filter("event_type in ('purchase', 'view')")
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1)).rowsBetween(W.unboundedPreceding, 0)
    return e.withColumn("last_view", F.last(F.when(F.col("event_type") == "view", F.col("ts")), ignorenulls=True).over(w)).filter("event_type = 'purchase'").select("event_id", "last_view")


@query("j13_cross_slug_pairs", "WITH r AS (SELECT o_orderkey AS id, o_custkey AS slug, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30) SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.rank < b.rank AND a.slug <> b.slug")
def cross_slug_pairs(spark, sf):
    """Pairs of a top-k list: at most 30 rows on either side."""
    r = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("slug"), "o_totalprice")
    r = r.withColumn("rank", F.row_number().over(W.orderBy(F.desc("o_totalprice"), "id")))
    a, b = r.select(F.col("id").alias("a"), F.col("slug").alias("sa"), F.col("rank").alias("ra")), r.select(F.col("id").alias("b"), F.col("slug").alias("sb"), F.col("rank").alias("rb"))
    return a.join(F.broadcast(b), (F.col("ra") < F.col("rb")) & (F.col("sa") != F.col("sb"))).select("a", "b")


@query("j14_chunk_takes", f"{with_views('chunks', 'takes')} SELECT chunk_id, id AS take_id FROM chunks_v c JOIN takes_v t ON t.page_id = c.page_id WHERE active AND quality IS NULL AND weight = 1.0")
def chunk_takes(spark, sf):
    t = views.takes(spark, sf).filter("active and quality is null and weight = 1.0").select("page_id", F.col("id").alias("take_id"))
    return views.chunks(spark, sf).select("chunk_id", "page_id").join(t, "page_id").select("chunk_id", "take_id")


#: Names up to which their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_NAMES = 100_000


def mentions(docs, names, longest: int):
    """(doc_id, target, position) of names in texts: n-grams joined by equality, then the longest entry first at each
    place, no overlaps, a target once a document."""
    words = docs.select("doc_id", T.tokens(F.col("text")).alias("w"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("w", i, n), " ").alias("gram")))).otherwise(F.array().cast("array<struct<at:int,n:int,gram:string>>"))))
    names = F.broadcast(names) if names.count() <= BROADCAST_NAMES else names
    hits = words.select("doc_id", F.explode(grams).alias("g")).select("doc_id", "g.at", "g.n", "g.gram").join(names, "gram")
    # a document's hits stand one after another in one partition: they stream, and only its targets are held
    dealt = hits.select("doc_id", "at", "n", "target").repartition("doc_id").sortWithinPartitions("doc_id", "at", F.desc("n"), "target")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(_longest_first, f"doc_id {kind}, target string, at int")


def _longest_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, at, n, target) in order: those taken. What is held between batches is the last document's."""
    doc, free, seen = None, 0, set()
    for batch in batches:
        docs, targets = (batch.column(c).dictionary_encode("encode") for c in (0, 3))
        names = targets.dictionary.to_pylist()
        codes = docs.indices.to_numpy().tolist()
        here, keep = None, []
        for i, (d, at, n, t) in enumerate(zip(codes, *(c.to_numpy().tolist() for c in (batch.column(1), batch.column(2), targets.indices)), strict=True)):
            if d != here:
                here, value = d, docs.dictionary[d].as_py()
                if i or value != doc:
                    doc, free, seen = value, 0, set()
            if at >= free:
                free = at + n
                if names[t] not in seen:
                    seen.add(names[t])
                    keep.append(i)
        out = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([out.column(0), out.column(3), out.column(1)], names=["doc_id", "target", "at"])


@query("j15_mentions")
def gazetteer(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    names = table(spark, sf, "benchmark").select(F.array_join(F.slice(T.tokens(F.col("text")), 1, 3), " ").alias("gram"), F.concat(F.lit("b/"), F.col("item_id").cast("string")).alias("target"))
    one = table(spark, sf, "benchmark").select(F.array_join(F.slice(T.tokens(F.col("text")), 1, 1), " ").alias("gram"), F.concat(F.lit("w/"), F.col("item_id").cast("string")).alias("target"))
    return mentions(d, names.union(one).groupBy("gram").agg(F.min("target").alias("target")), 3)


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda w: list_transform(range(1, (length(w) + 2)::BIGINT), lambda i: substr('  ' || w || ' ', i::BIGINT, 3)))))"


@query(
    "j16_fuzzy_titles",
    f"""WITH q AS (SELECT DISTINCT p_name AS title, {_TRI.format(c='p_name')} AS t FROM part), k AS (SELECT DISTINCT replace(p_name, 'e', 'a') AS name, {_TRI.format(c="replace(p_name, 'e', 'a')")} AS t FROM part),
s AS (SELECT name, title, len(list_intersect(q.t, k.t))::DOUBLE / len(list_distinct(q.t || k.t)) AS score FROM q, k WHERE len(list_intersect(q.t, k.t)) > 0)
SELECT name, title, round(score, 6) AS score FROM s WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, title) = 1""",
)
def fuzzy_titles(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("title")).distinct()
    k = table(spark, sf, "part").select(F.replace("p_name", F.lit("e"), F.lit("a")).alias("name")).distinct()
    s = similar_names(k, p, 0.4)
    w = W.partitionBy("name").orderBy(F.desc("score"), "title")
    return s.withColumn("n", F.row_number().over(w)).filter("n = 1").select("name", "title", F.round("score", 6).alias("score"))


#: Trigrams up to which their table of frequencies is broadcast.
BROADCAST_TRIGRAMS = 1_000_000


def similar_names(names, titles, least: float):
    """(name, title, score) of all pairs whose sets of trigrams have a similarity of ``least`` or more.

    Sets are put in one order, rarest trigram first. Two sets of that similarity share one of the first
    size - ceil(least * size) + 1 of either, so only those are joined: the frequent trigrams, which nearly all names have,
    meet no other. Candidates are then compared whole.
    """
    n, t = names.select("name", T.trigrams(F.col("name")).alias("u")), titles.select("title", T.trigrams(F.col("title")).alias("t"))
    each = n.select(F.explode("u").alias("g")).union(t.select(F.explode("t")))
    often = each.groupBy("g").agg(F.count(F.lit(1)).alias("often"))
    often = cut_lineage(often)
    often = F.broadcast(often) if often.count() <= BROADCAST_TRIGRAMS else often

    def heads(d, key, grams):
        ordered = d.select(key, grams, F.explode(grams).alias("g")).join(often, "g").groupBy(key, grams).agg(F.sort_array(F.collect_list(F.struct("often", "g"))).alias("x"))
        size = F.size("x")
        return ordered.select(key, grams, F.explode(F.slice("x", F.lit(1), (size - F.ceil(least * size) + 1).cast("int"))["g"]).alias("g"))

    pairs = heads(n, "name", "u").join(heads(t, "title", "t"), "g").select("name", "title", "u", "t").distinct()
    return pairs.withColumn("score", T.set_similarity(F.col("u"), F.col("t"))).filter(F.col("score") >= least).select("name", "title", "score")


@query("j17_full_outer", "SELECT coalesce(c.k, s.k) AS nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.k = s.k")
def full_outer(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "nation", "full_outer").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("j18_meeting_timeline", f"{with_views('links')} SELECT DISTINCT l.src AS attendee, o.o_orderdate::DATE AS day, 'meeting' AS kind FROM links_v l JOIN orders o ON 'customers/' || o.o_custkey = l.src WHERE l.link_type = 'buys_from' AND o.o_orderpriority = '1-URGENT' UNION SELECT l.dst, o.o_orderdate::DATE, 'mention' FROM links_v l JOIN orders o ON 'customers/' || o.o_custkey = l.src WHERE l.link_source = 'mentions' AND o.o_orderpriority = '1-URGENT'")
def meeting_timeline(spark, sf):
    m = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("customers/"), F.col("o_custkey").cast("string")).alias("src"), F.to_date("o_orderdate").alias("day"))
    j = views.links(spark, sf).filter("link_type = 'buys_from'").join(m, "src")
    return j.select(F.col("src").alias("attendee"), "day", F.lit("meeting").alias("kind")).union(j.filter("link_source = 'mentions'").select("dst", "day", F.lit("mention"))).distinct()


# --- graph -----------------------------------------------------------------------------------------------------------

_BFS = "b AS (SELECT 'regions/2' AS node, 0 AS depth UNION SELECT l.src, b.depth + 1 FROM b JOIN links_v l ON l.dst = b.node WHERE b.depth < 2)"


@query("g1_traverse", f"{with_views('links', more=_BFS)}, m AS (SELECT node, min(depth) AS depth FROM b GROUP BY node) SELECT m.node, depth, count(l.src) AS n_links FROM m LEFT JOIN links_v l ON l.src = m.node GROUP BY ALL")
def traverse(spark, sf):
    return G.traverse(views.links(spark, sf), spark.createDataFrame([("regions/2",)], "node string"), 2, "in")


@query("g1_traverse_capped", f"{with_views('links')}, a AS (SELECT DISTINCT src AS node FROM links_v WHERE dst = 'regions/2' ORDER BY 1 LIMIT 3), c AS (SELECT DISTINCT src AS node FROM links_v WHERE dst IN (SELECT node FROM a) AND src NOT IN (SELECT node FROM a) ORDER BY 1 LIMIT 3) SELECT 'regions/2' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM a UNION ALL SELECT node, 2 FROM c")
def traverse_capped(spark, sf):
    return G.bfs(views.links(spark, sf), spark.createDataFrame([("regions/2",)], "node string"), 2, "in", frontier_cap=3)


_PATHS = "p AS (SELECT src, dst, link_type, 1 AS depth, [src, dst] AS path FROM links_v WHERE src = 'customers/7' UNION ALL SELECT l.src, l.dst, l.link_type, p.depth + 1, p.path || [l.dst] FROM p JOIN links_v l ON l.src = p.dst WHERE p.depth < 4 AND NOT list_contains(p.path, l.dst))"


@query("g2_paths", f"{with_views('links', more=_PATHS)} SELECT DISTINCT src, dst, link_type, depth FROM p")
def traverse_paths(spark, sf):
    return G.paths(views.links(spark, sf), "customers/7", 4)


_STEP = "st AS (SELECT src, dst, link_type, src || '>' || dst || link_type || coalesce(link_source, '') AS edge FROM links_v WHERE link_source IS DISTINCT FROM 'mentions' UNION ALL SELECT dst, src, link_type, src || '>' || dst || link_type || coalesce(link_source, '') FROM links_v WHERE link_source IS DISTINCT FROM 'mentions')"


def _fan(seed: str, name: str) -> str:
    return f"""{name}1 AS (SELECT dst AS node, link_type, edge, 1 AS hop FROM st WHERE src = '{seed}'), {name}2 AS (SELECT DISTINCT s.dst AS node, s.link_type, s.edge, 2 AS hop FROM st s JOIN {name}1 f ON s.src = f.node WHERE f.node <> '{seed}'),
{name} AS (SELECT node, min(hop) AS hop, count(DISTINCT edge) AS edge_count, array_to_string(list_sort(list(DISTINCT link_type)), ',') AS types FROM (SELECT * FROM {name}1 UNION ALL SELECT * FROM {name}2) WHERE node <> '{seed}' GROUP BY node)"""


@query("g3_fanout", f"{with_views('links', more=_STEP)}, {_fan('suppliers/3', 'f')} SELECT * FROM f")
def fanout(spark, sf):
    return G.fanout(views.links(spark, sf), spark.createDataFrame([("suppliers/3",)], "node string"), 2)


_HOP2 = "(SELECT s.dst AS node, min(s.src) AS parent FROM st s JOIN (SELECT DISTINCT node FROM f1) f ON s.src = f.node WHERE f.node <> 'suppliers/3' GROUP BY s.dst)"


@query(
    "g3_fanout_paths",
    f"""{with_views('links', more=_STEP)}, {_fan('suppliers/3', 'f')}, h AS {_HOP2}, b AS (SELECT * FROM f ORDER BY hop, edge_count DESC, node LIMIT 50)
SELECT b.node, hop, edge_count, types, array_to_string(CASE hop WHEN 1 THEN ['suppliers/3', b.node] ELSE ['suppliers/3', h.parent, b.node] END, ' ') AS path, c.chunk_id
FROM b LEFT JOIN h ON h.node = b.node LEFT JOIN (SELECT 'customers/' || o_custkey AS node, min(o_orderkey) AS chunk_id FROM orders GROUP BY ALL) c ON c.node = b.node""",
)
def fanout_paths(spark, sf):
    """The fifty nearest and best linked nodes around a supplier, with a shortest path and their first chunk (a customer's first order)."""
    chunks = table(spark, sf, "orders").select(F.concat(F.lit("customers/"), F.col("o_custkey").cast("string")).alias("node"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("chunk_id"))
    out = G.fanout_paths(views.links(spark, sf), spark.createDataFrame([("suppliers/3",)], "node string"), 2, chunks=chunks)
    return out.select("node", "hop", "edge_count", "types", F.array_join("path", " ").alias("path"), "chunk_id")


@query("g4_connects", f"{with_views('links', more=_STEP)}, {_fan('suppliers/3', 'f')}, {_fan('suppliers/5', 'g')} SELECT f.node, f.hop AS hop_a, g.hop AS hop_b, f.hop + g.hop AS hops FROM f JOIN g ON f.node = g.node WHERE f.node NOT IN ('suppliers/3', 'suppliers/5')")
def connects(spark, sf):
    seed = lambda s: spark.createDataFrame([(s,)], "node string")
    e = views.links(spark, sf)
    return G.connects(G.fanout(e, seed("suppliers/3"), 2), G.fanout(e, seed("suppliers/5"), 2)).filter("node not in ('suppliers/3', 'suppliers/5')")


@query("g5_backlink_counts", f"{with_views('links', more=_NODES)} SELECT node, count(dst) AS n FROM n LEFT JOIN links_v ON dst = node AND link_source IS DISTINCT FROM 'mentions' GROUP BY node")
def backlink_counts(spark, sf):
    return G.backlink_counts(_nodes(spark, sf), views.links(spark, sf))


_SET = "k AS (SELECT node, CASE WHEN node LIKE 'customers/%' THEN 'crm' WHEN node LIKE 'suppliers/%' THEN 'erp' ELSE 'geo' END AS source_id FROM n)"


@query("g6_adjacency", f"{with_views('links', more=_NODES)}, {_SET} SELECT dst AS node, count(DISTINCT src) AS hits, count(DISTINCT CASE WHEN a.source_id <> b.source_id THEN a.source_id END) AS cross_hits FROM links_v JOIN k a ON a.node = src JOIN k b ON b.node = dst WHERE src <> dst GROUP BY dst")
def adjacency(spark, sf):
    kind = F.when(F.col("node").startswith("customers/"), "crm").when(F.col("node").startswith("suppliers/"), "erp").otherwise("geo")
    return G.adjacency(_nodes(spark, sf).withColumn("source_id", kind), views.links(spark, sf))


@query("g7_scoped_links", f"{with_views('links')} SELECT src, dst, link_type, CASE WHEN link_source <> 'mentions' THEN link_source END AS origin FROM links_v WHERE dst = 'suppliers/3'")
def scoped_links(spark, sf):
    return views.links(spark, sf).filter("dst = 'suppliers/3'").select("src", "dst", "link_type", F.when(F.col("link_source") != "mentions", F.col("link_source")).alias("origin"))


@query("g7_link_sources", f"{with_views('links')} SELECT link_type, link_source, count(*) AS n FROM links_v GROUP BY ALL")
def link_sources(spark, sf):
    return views.links(spark, sf).groupBy("link_type", "link_source").agg(F.count(F.lit(1)).alias("n"))


@query("g8_foreign_edges", f"{with_views('links')} SELECT count(*) FILTER (WHERE src = 'nations/4') AS outgoing, count(*) FILTER (WHERE dst = 'nations/4') AS incoming FROM links_v WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1)")
def foreign_edges(spark, sf):
    part = lambda c: F.split(c, "/")[0]
    e = views.links(spark, sf).filter(part("src") != part("dst"))
    return e.agg(F.count(F.when(F.col("src") == "nations/4", 1)).alias("outgoing"), F.count(F.when(F.col("dst") == "nations/4", 1)).alias("incoming"))


_CODE = "r AS (SELECT 'f' || (p_partkey % 60) AS from_symbol, 'f' || ((p_partkey * 7 + 3) % 97) AS to_symbol, p_partkey AS to_chunk_id FROM part WHERE p_size <= 40), u AS (SELECT 'f' || (p_partkey % 50) AS from_symbol, 'f' || (p_size) AS to_symbol, NULL::BIGINT AS to_chunk_id FROM part WHERE p_size > 40)"


def _code(spark, sf):
    p = table(spark, sf, "part")
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    k = F.col("p_partkey")
    return p.filter("p_size <= 40").select(name(k % 60).alias("from_symbol"), name((k * 7 + 3) % 97).alias("to_symbol"), k.alias("to_chunk_id")), p.filter("p_size > 40").select(name(k % 50).alias("from_symbol"), name(F.col("p_size")).alias("to_symbol"))


@query("g9_callers", f"WITH {_CODE} SELECT from_symbol, to_symbol, to_chunk_id FROM (SELECT * FROM r UNION ALL SELECT * FROM u) WHERE to_symbol = 'f10'")
def callers(spark, sf):
    return G.callers(*_code(spark, sf), "f10")


@query("g9_callees", f"WITH {_CODE} SELECT from_symbol, to_symbol, to_chunk_id FROM (SELECT * FROM r UNION ALL SELECT * FROM u) WHERE from_symbol = 'f10'")
def callees(spark, sf):
    return G.callers(*_code(spark, sf), "f10", "from_symbol")


@query("g10_edges_by_chunk", f"WITH {_CODE} SELECT 'in' AS side, from_symbol, to_symbol FROM r WHERE to_chunk_id IN (5, 9) UNION ALL SELECT 'out', from_symbol, to_symbol FROM r WHERE from_symbol = 'f5'")
def edges_by_chunk(spark, sf):
    r, _ = _code(spark, sf)
    return r.filter("to_chunk_id in (5, 9)").select(F.lit("in").alias("side"), "from_symbol", "to_symbol").union(r.filter("from_symbol = 'f5'").select(F.lit("out"), "from_symbol", "to_symbol"))


@query(
    "g11_code_walk",
    f"""WITH {_CODE}, e AS (SELECT DISTINCT from_symbol AS src, to_symbol AS dst FROM r), n0 AS (SELECT 'f10' AS node, ['f10'] AS way),
n1 AS (SELECT dst AS node, list_append(arg_min(way, src), dst) AS way FROM e JOIN n0 ON src = node WHERE dst <> 'f10' GROUP BY dst),
n2 AS (SELECT dst AS node, list_append(arg_min(way, src), dst) AS way FROM e JOIN n1 ON src = node WHERE dst NOT IN (SELECT node FROM n0 UNION ALL SELECT node FROM n1) GROUP BY dst),
n3 AS (SELECT dst AS node, list_append(arg_min(way, src), dst) AS way FROM e JOIN n2 ON src = node WHERE dst NOT IN (SELECT node FROM n0 UNION ALL SELECT node FROM n1 UNION ALL SELECT node FROM n2) GROUP BY dst),
a AS (SELECT *, 0 AS depth FROM n0 UNION ALL SELECT *, 1 FROM n1 UNION ALL SELECT *, 2 FROM n2 UNION ALL SELECT *, 3 FROM n3), b AS (SELECT * FROM a ORDER BY depth, node LIMIT 40),
f AS (SELECT b.node, bool_or(list_contains(way, dst)) AS cycle, bool_or(dst NOT IN (SELECT node FROM a)) AS cut FROM b JOIN e ON src = b.node GROUP BY b.node)
SELECT b.node, depth, round(greatest(0.05, least(1.0, 1 / (1 + 0.3 * depth)))::DOUBLE, 6) AS confidence, f.node IS NULL AS sink, coalesce(cycle, false) AS cycle, coalesce(cut, false) AS cut, (SELECT count(*) FROM a) > 40 AS truncated FROM b LEFT JOIN f ON f.node = b.node""",
)
def code_walk(spark, sf):
    r, _ = _code(spark, sf)
    return G.code_walk(r, "f10", 3, most=40).withColumn("confidence", F.round("confidence", 6))


@query("g12_descendants", "WITH RECURSIVE t AS (SELECT 1 AS id, 0 AS depth UNION ALL SELECT p_partkey, depth + 1 FROM t JOIN part ON p_partkey // 3 = id AND p_partkey > 2 WHERE depth < 100) SELECT id, depth FROM t")
def descendants(spark, sf):
    table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("k")).createOrReplaceTempView("job_tree")
    return spark.sql("WITH RECURSIVE t MAX RECURSION LEVEL 100 AS (SELECT 1 AS id, 0 AS depth UNION ALL SELECT k, depth + 1 FROM t JOIN job_tree ON k div 3 = id AND k > 2 WHERE depth < 99) SELECT id, depth FROM t")


@query("g13_most_connected", f"{with_views('links')} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM links_v UNION ALL SELECT dst FROM links_v) GROUP BY node ORDER BY degree DESC, node LIMIT 15")
def most_connected(spark, sf):
    return G.most_connected(views.links(spark, sf), 15)


@query("g13_dead_links", f"{with_views('links', more=_NODES)} SELECT src, dst, link_type, link_source FROM links_v WHERE dst NOT IN (SELECT node FROM n)")
def dead_links(spark, sf):
    return G.dead_links(views.links(spark, sf), _nodes(spark, sf)).select("src", "dst", "link_type", "link_source")


@query("g14_backlink_gaps", "WITH e AS (SELECT DISTINCT o_custkey % 200 AS src, (o_orderkey // 3) % 200 AS dst FROM orders) SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.src = e.dst AND b.dst = e.src)")
def backlink_gaps(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 200).alias("src"), (F.floor(F.col("o_orderkey") / 3) % 200).alias("dst"))
    return G.backlink_gaps(o)


@query(
    "g15_resolve_cascade",
    f"""WITH pn AS (SELECT p_name AS title, min(p_partkey) AS k, count(*) AS links, {_TRI.format(c='p_name')} AS t FROM part GROUP BY p_name),
q AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN replace(p_name, 'e', 'x') WHEN p_partkey % 4 = 2 THEN split_part(p_name, ' ', 1) ELSE 'zz' || p_size END AS name FROM part),
f AS (SELECT name, title, len(list_intersect({_TRI.format(c='name')}, t))::DOUBLE / len(list_distinct({_TRI.format(c='name')} || t)) AS score FROM q, pn),
b AS (SELECT name, title FROM f WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, title) = 1),
p AS (SELECT name, title FROM q JOIN pn ON starts_with(title, name || ' ') QUALIFY row_number() OVER (PARTITION BY name ORDER BY links DESC, title) = 1)
SELECT q.name, coalesce(pn.title, b.title, p.title, 'people/' || q.name) AS slug, CASE WHEN pn.title IS NOT NULL THEN 'exact' WHEN b.title IS NOT NULL THEN 'fuzzy' WHEN p.title IS NOT NULL THEN 'prefix' ELSE 'new' END AS how FROM q LEFT JOIN pn ON pn.title = q.name LEFT JOIN b ON b.name = q.name LEFT JOIN p ON p.name = q.name""",
)
def resolve_cascade(spark, sf):
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    names = part.select(F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.replace("p_name", F.lit("e"), F.lit("x"))).when(k % 4 == 2, F.split("p_name", " ")[0]).otherwise(F.concat(F.lit("zz"), F.col("p_size").cast("string"))).alias("name")).distinct()
    pages = part.groupBy(F.col("p_name").alias("slug")).agg(F.count(F.lit(1)).alias("links"))
    p, q = pages.withColumn("t", T.trigrams(F.col("slug"))), names.withColumn("u", T.trigrams(F.col("name")))
    shared = p.withColumn("g", F.explode("t")).join(q.withColumn("g", F.explode("u")), "g").groupBy("name", "slug").agg(F.count(F.lit(1)).alias("both"), F.first(F.size("t")).alias("a"), F.first(F.size("u")).alias("b"))
    fuzzy = shared.select("name", "slug", (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("score"))
    prefix = names.join(pages.withColumn("name", F.split("slug", " ")[0]), "name").filter(F.col("slug") != F.col("name")).select("name", "slug", "links")
    exact = names.join(pages.select(F.col("slug").alias("name"), F.col("slug")), "name").select("name", "slug")
    return G.resolve(names, exact, fuzzy, prefix, F.concat(F.lit("people/"), F.col("name")))


@query("g16_alias_resolution", "SELECT c_custkey AS id, coalesce(s.s_name, c_name) AS name FROM customer LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0) s ON s_suppkey = c_custkey")
def alias_resolution(spark, sf):
    s = table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    return table(spark, sf, "customer").join(s, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.coalesce("s_name", "c_name").alias("name"))


@query(
    "g17_alias_closure",
    "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey - p_size AS b FROM part WHERE p_size > 35), s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), w AS (SELECT x AS node, x AS reach FROM s UNION SELECT w.node, s.y FROM w JOIN s ON s.x = w.reach) SELECT node, min(reach) AS component FROM w GROUP BY node",
)
def alias_closure(spark, sf):
    p = table(spark, sf, "part").filter("p_size > 35")
    return connected_components(p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - F.col("p_size")).alias("b")))


_BOTH = "e AS (SELECT p_partkey % 40 AS src, p_partkey AS dst FROM part WHERE p_partkey % 40 <> p_partkey UNION SELECT p_partkey, p_partkey % 40 FROM part WHERE p_partkey % 40 <> p_partkey UNION SELECT p_partkey, p_partkey * 7 % 301 FROM part WHERE p_size > 25 AND p_partkey <> p_partkey * 7 % 301 UNION SELECT p_partkey * 7 % 301, p_partkey FROM part WHERE p_size > 25 AND p_partkey <> p_partkey * 7 % 301)"


@query(
    "r11_two_pass_expansion",
    f"""WITH {_BOTH}, a AS (SELECT chunk, max(score) AS score FROM (VALUES (3, 0.9::DOUBLE), (47, 0.7::DOUBLE), (110, 0.4::DOUBLE), (3, 0.1::DOUBLE)) AS t(chunk, score) GROUP BY chunk),
s0 AS (SELECT * FROM a UNION ALL SELECT p_partkey, (SELECT max(score) FROM a) FROM (SELECT p_partkey FROM part WHERE p_size = 7 ORDER BY 1 LIMIT 50) WHERE p_partkey NOT IN (SELECT chunk FROM a)),
s1 AS (SELECT dst AS chunk, max(score) / 2 AS score FROM (SELECT dst, score FROM s0 JOIN e ON src = chunk QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 50) WHERE dst NOT IN (SELECT chunk FROM s0) GROUP BY dst),
s2 AS (SELECT dst AS chunk, max(score) / 3 AS score FROM (SELECT dst, score FROM s1 JOIN e ON src = chunk QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 50) WHERE dst NOT IN (SELECT chunk FROM s0 UNION ALL SELECT chunk FROM s1) GROUP BY dst)
SELECT chunk, round(score, 6) AS score, 0 AS hop, 'anchor' AS source FROM s0 UNION ALL SELECT chunk, round(score, 6), 1, 'neighbor' FROM s1 UNION ALL SELECT chunk, round(score, 6), 2, 'neighbor' FROM s2""",
)
def two_pass_expansion(spark, sf):
    """Chunks around three anchors and around those of a symbol, over two kinds of code edges."""
    k = F.col("p_partkey")
    part = table(spark, sf, "part")
    e = part.select((k % 40).alias("src"), k.alias("dst")).unionByName(part.filter("p_size > 25").select(k.alias("src"), (k * 7 % 301).alias("dst")))
    anchors = spark.createDataFrame([(3, 0.9), (47, 0.7), (110, 0.4), (3, 0.1)], "chunk long, score double")
    out = G.expand_anchors(anchors, e, near=part.filter("p_size = 7").select(k.alias("chunk")))
    return out.withColumn("score", F.round("score", 6))


@query("r10_relational_arm", f"{with_views('links', more=_STEP)}, {_fan('nations/4', 'f')} SELECT node, hop, edge_count, row_number() OVER (ORDER BY hop, edge_count DESC, node) AS rank FROM f WHERE types LIKE '%located_in%' QUALIFY row_number() OVER (ORDER BY hop, edge_count DESC, node) <= 40")
def relational_arm(spark, sf):
    """"who is located in ...": parsed on the driver to a seed and a type, fanned out, then ranked for fusion."""
    f = G.fanout(views.links(spark, sf), spark.createDataFrame([("nations/4",)], "node string"), 2).filter(F.col("types").contains("located_in"))
    best = f.orderBy("hop", F.desc("edge_count"), "node").limit(40)
    return best.select("node", "hop", "edge_count", F.row_number().over(W.orderBy("hop", F.desc("edge_count"), "node")).alias("rank"))


@query("s8_slug_paths", "SELECT page_id, lower(regexp_replace(regexp_replace(url, '^https?://', ''), '[^a-zA-Z0-9/]+', '-', 'g')) AS slug FROM pages WHERE NOT contains(url, '/de/')")
def slug_paths(spark, sf):
    slug = F.lower(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[^a-zA-Z0-9/]+", "-"))
    return table(spark, sf, "pages").filter(~F.contains("url", F.lit("/de/"))).select("page_id", slug.alias("slug"))


