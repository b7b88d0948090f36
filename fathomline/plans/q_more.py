"""Queries over the remaining small operators: link fields, parser scores, bounded queues, compiled searches."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomline.functions import chunkers as C
from fathomline.functions import text as T
from fathomline.operators import retrieval as R
from fathomline.operators import clusters, scope
from fathomline.plans import search
from fathomline.plans.catalog import query
from fathomline.plans.q_ingest import BOUNDARIES_SQL
from fathomline.session import ensure_checkpoint_dir, table
from fathomline.sources import documents as D
from fathomline.sources import plugins, views
from fathomline.sources.views import with_views
from fathomline.streaming import ingest as I
from fathomline.streaming.supervise import RestartPolicy


@query("p8_detail_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate < TIMESTAMP '1996-01-01'")
def detail_filter(spark, sf):
    c = table(spark, sf, "lineitem").withColumn("chunk_source", F.when(F.col("l_linestatus") == "F", "compiled_truth").otherwise("timeline"))
    return c.filter("chunk_source = 'compiled_truth' and l_shipdate < timestamp '1996-01-01'").select("l_orderkey", "l_linenumber")


# Front-matter fields that stand for links: (link type, whether the page is the link's target).
LINK_FIELDS = {"company": ("works_at", False), "companies": ("works_at", False), "founded": ("founded", False), "investors": ("invested_in", True), "attendees": ("attended", True), "source": ("source", False)}


@query("f12_frontmatter_links", "WITH f AS (SELECT p_partkey, unnest([{'k': 'company', 'v': p_brand}, {'k': 'investors', 'v': p_type}, {'k': 'color', 'v': p_name}]) AS e FROM part) SELECT CASE WHEN e.k = 'investors' THEN e.v ELSE 'p' || p_partkey END AS src, CASE WHEN e.k = 'investors' THEN 'p' || p_partkey ELSE e.v END AS dst, CASE e.k WHEN 'company' THEN 'works_at' ELSE 'invested_in' END AS link_type FROM f WHERE e.k <> 'color'")
def frontmatter_links(spark, sf):
    fields = F.create_map(F.lit("company"), F.col("p_brand"), F.lit("investors"), F.col("p_type"), F.lit("color"), F.col("p_name"))
    rules = spark.createDataFrame([(k, t, back) for k, (t, back) in LINK_FIELDS.items()], "field string, link_type string, back boolean")
    page = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    each = table(spark, sf, "part").select(page.alias("page"), F.explode(fields).alias("field", "target")).join(F.broadcast(rules), "field")
    return each.select(F.when(F.col("back"), F.col("target")).otherwise(F.col("page")).alias("src"), F.when(F.col("back"), F.col("page")).otherwise(F.col("target")).alias("dst"), "link_type")


@query("a32_code_retrieval", "WITH w AS (SELECT l_orderkey AS q, count(DISTINCT l_partkey) FILTER (WHERE l_quantity > 20) AS rel, count(DISTINCT l_partkey) FILTER (WHERE l_linenumber <= 3) AS got, count(DISTINCT l_partkey) FILTER (WHERE l_quantity > 20 AND l_linenumber <= 3) AS hit FROM lineitem GROUP BY 1) SELECT q, round(hit::DOUBLE / nullif(got, 0), 6) AS precision, round(hit::DOUBLE / nullif(rel, 0), 6) AS recall FROM w")
def code_retrieval(spark, sf):
    rel, got = F.col("l_quantity") > 20, F.col("l_linenumber") <= 3
    n = lambda c: F.countDistinct(F.when(c, F.col("l_partkey")))
    w = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(n(rel).alias("rel"), n(got).alias("got"), n(rel & got).alias("hit"))
    return w.select("q", F.round(F.col("hit") / F.nullif("got", F.lit(0)), 6).alias("precision"), F.round(F.col("hit") / F.nullif("rel", F.lit(0)), 6).alias("recall"))


_HEARD = "SELECT conv_id, count(*) AS m, count(*) FILTER (WHERE (conv_id * 31 + turn) % 17 <> 0) AS g, count(DISTINCT role) AS p, count(DISTINCT role) FILTER (WHERE (conv_id * 31 + turn) % 17 <> 0) AS s FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"


@query("a38_parser_scores", f"SELECT round((sum(least(g, m)) / sum(m))::DOUBLE, 6) AS message_recall, round((sum(least(s, p)) / sum(p))::DOUBLE, 6) AS participant_recall, sum(least(g, m)) / sum(m) >= 0.9 AND sum(least(s, p)) = sum(p) AS passes FROM ({_HEARD})")
def parser_scores(spark, sf):
    """Messages and speakers that the chat parser finds in exports made of the conversations, some of whose lines have lost their heads."""
    c = table(spark, sf, "conversations").filter("text is not null")
    lost = (F.col("conv_id") * 31 + F.col("turn")) % 17 == 0
    line = F.when(lost, F.concat(F.lit("  "), "text")).otherwise(F.concat(F.lit("[2024-01-01] "), "role", F.lit(": "), "text"))
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"), F.count(F.lit(1)).alias("messages"), F.countDistinct("role").alias("people"))
    found = D.chats(whole, "conv_id", "body").groupBy("conv_id").agg(F.count(F.lit(1)).alias("got"), F.countDistinct("speaker").alias("seen"))
    each = whole.join(found, "conv_id", "left").fillna(0, ["got", "seen"])
    s = each.agg((F.sum(F.least("got", "messages")) / F.sum("messages")).alias("m"), (F.sum(F.least("seen", "people")) / F.sum("people")).alias("p"))
    return s.select(F.round("m", 6).alias("message_recall"), F.round("p", 6).alias("participant_recall"), ((F.col("m") >= 0.9) & (F.col("p") == 1)).alias("passes"))


@query("t6_bounded_queue", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def bounded_queue(spark, sf):
    """The newest ten a session; older ones are dropped first."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("n", F.row_number().over(w)).filter("n <= 10").select("user_id", "event_id")


@query("o5_binary_order", f"{with_views('pages')} SELECT slug FROM pages_v ORDER BY encode(slug), page_id LIMIT 40")
def binary_order(spark, sf):
    return views.pages(spark, sf).orderBy(F.col("slug").cast("binary"), "page_id").limit(40).select("slug")


def _corpus(spark, sf, **more):
    return search.Corpus(views.pages(spark, sf), **more)


@query("r16_compiled_search")
def compiled_search(spark, sf):
    """A whole search from question to page list: two expansions, a vector, postings, salience, a reranker, a token budget."""
    e = views.chunks(spark, sf).withColumn("page_id", F.col("chunk_id"))
    embed = lambda q: e.filter("chunk_id = 0").select("embedding").first()[0]
    plan = search.compile_search("the and", dt.datetime(2024, 2, 15), limit=10, expand=lambda q: ["of the", "and; that"], embed=embed, budget=20000, salience="on", recency="on", floor_ratio=0.1)
    p = views.pages(spark, sf)
    postings = R.inverted_index(p, ["page_id"], {"A": F.col("title"), "B": F.col("compiled_truth")})
    salience = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").cast("double").alias("salience"))
    return search.run_search(plan, _corpus(spark, sf, chunks=e, postings=postings, salience=salience), rerank=lambda t: len(set(t.split())) / max(1, len(t.split())))


_NODES = """p AS (SELECT n_nationkey AS page_id, 'nations/' || n_nationkey AS slug, n_name AS title, 'nation' AS type FROM nation UNION ALL SELECT 1000 + c_custkey, 'customers/' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 100000000 + s_suppkey, 'suppliers/' || s_suppkey, s_name, 'supplier' FROM supplier)"""


def _nodes(spark, sf):
    """The nodes of the links as pages."""

    def of(name, key, title, first, kind):
        d = table(spark, sf, name)
        return d.select((F.lit(first) + F.col(key)).cast("long").alias("page_id"), F.lit("main").alias("source_id"), F.concat(F.lit(f"{kind}s/"), F.col(key).cast("string")).alias("slug"), F.lit(kind).alias("type"), F.col(title).alias("title"), F.col(title).alias("compiled_truth"), *[F.lit(None).cast("timestamp").alias(c) for c in ("deleted_at", "effective_date", "updated_at", "created_at")])

    return of("nation", "n_nationkey", "n_name", 0, "nation").unionByName(of("customer", "c_custkey", "c_name", 1000, "customer")).unionByName(of("supplier", "s_suppkey", "s_name", 100000000, "supplier"))


def _relational(kind: str, seed: str, where: str = "TRUE") -> str:
    """The twin of a relation question of one hop over the links' nodes."""
    return f"""{with_views('links', more=_NODES)},
e AS (SELECT src, count(*) AS edges FROM (SELECT DISTINCT src, dst, link_source FROM links_v WHERE link_type = '{kind}' AND link_source IS DISTINCT FROM 'mentions' AND dst = (SELECT slug FROM p WHERE title = '{seed}')) GROUP BY src),
f AS (SELECT p.*, row_number() OVER (ORDER BY edges DESC, page_id) - 1 AS r FROM e JOIN p ON p.slug = e.src QUALIFY row_number() OVER (ORDER BY edges DESC, page_id) <= 100),
s AS (SELECT *, (1.0::DOUBLE / (60 + r)) / (1.0::DOUBLE / 60) AS base FROM f),
n AS (SELECT dst, count(*) AS n FROM links_v WHERE link_source IS DISTINCT FROM 'mentions' GROUP BY 1),
b AS (SELECT s.*, base * CASE WHEN coalesce(n, 0) > 0 THEN 1 + 0.05 * ln(1 + n) ELSE 1 END AS sc FROM s LEFT JOIN n ON n.dst = s.slug),
j AS (SELECT l.dst, count(DISTINCT l.src) AS hits FROM links_v l JOIN b x ON x.slug = l.src JOIN b y ON y.slug = l.dst WHERE l.src <> l.dst GROUP BY 1),
g AS (SELECT b.*, sc * CASE WHEN row_number() OVER (ORDER BY sc DESC, slug) <= 20 AND coalesce(hits, 0) >= 2 THEN 1.05 ELSE 1 END AS score FROM b LEFT JOIN j ON j.dst = b.slug),
d AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, page_id) AS nth, count(*) OVER () AS n FROM g)
SELECT page_id, slug, title, round(score, 6) AS score, CASE WHEN base >= 0.85 THEN 'strong' WHEN base >= 0.6 THEN 'solid' ELSE 'weak' END AS evidence FROM d WHERE nth <= greatest(1, ceil(0.6 * n)) QUALIFY row_number() OVER (ORDER BY score DESC, page_id) <= 50"""


def _ask(spark, sf, question, **options):
    plan = search.compile_search(question, dt.datetime(2024, 2, 15), limit=50, **options)
    found = search.run_search(plan, search.Corpus(_nodes(spark, sf), links=views.links(spark, sf)))
    return found.select("page_id", "slug", "title", F.round("score", 6).alias("score"), "evidence")


@query("r16_relational_search", _relational("located_in", "NATION_6"))
def relational_search(spark, sf):
    """A relation question: its seed is found by title, its links are one list of the fusion, and links boost the rest."""
    return _ask(spark, sf, "What is located in Nation_6?")


def _fails(*_):
    raise RuntimeError("no model here")


@query("x5_pluggable_functions", _relational("located_in", "NATION_2"))
def pluggable_functions(spark, sf):
    """Expansion and embedding functions that fail leave the search as it is without them."""
    return _ask(spark, sf, "What is located in the Nation_2?", expand=_fails, embed=_fails)


@query("x8_relation_verbs", _relational("buys_from", "Supplier#000000003"))
def relation_verbs(spark, sf):
    """A relation verb that a schema adds to the built-in ones."""
    verbs = search.verb_relations({"buys from|is a customer of": ("buys_from", "in")}, {"buys_from", "located_in", "part_of"})
    return _ask(spark, sf, "Who buys from Supplier#000000003?", relations=verbs)


def _folder(spark, name: str) -> str:
    """A new folder in the shared place."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@query("s13_objects", "SELECT sha256(n_name || chr(10)) AS sha256, length(n_name) + 1 AS size FROM nation")
def objects(spark, sf):
    """Objects put into a store by Spark's writers and listed from it, whatever file system its path names."""
    path = _folder(spark, "objects")
    table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    return plugins.objects(spark, f"{path}/*/*.txt").select("sha256", F.col("size").cast("long").alias("size"))


@query("s14_qrels", "SELECT 'q' || l_orderkey AS query, 'p' || l_partkey AS doc, max(l_quantity)::DOUBLE AS grade FROM lineitem GROUP BY ALL")
def qrels(spark, sf):
    """Graded judgements written as NDJSON and read again."""
    path = _folder(spark, "qrels")
    each = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").cast("double").alias("grade"))
    grades = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), "grade")))
    D.write_ndjson(each.groupBy("l_orderkey").agg(grades.alias("grades")).select(F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("query"), "grades"), path)
    return D.read_qrels(spark, path)


@query("s14_baseline", "SELECT 'q' || l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, 'p' || l_partkey AS slug FROM lineitem")
def baseline(spark, sf):
    """Result lists written as an NDJSON baseline and read again with their ranks."""
    path = _folder(spark, "baseline")
    each = F.struct((-F.col("l_extendedprice")).alias("a"), F.col("l_linenumber").alias("b"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("slug"))
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(each))["slug"].alias("slugs"))
    D.write_ndjson(lists.select(F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("query"), "slugs"), path)
    return D.read_baseline(spark, path)


@query("k7_markdown_export", "SELECT 'nations__' || n_nationkey AS slug, 'nation' AS type, n_name AS title, n_name AS body FROM nation")
def markdown_export(spark, sf):
    """Pages written as markdown files and read again."""
    path = _folder(spark, "export")
    D.export_markdown(_nodes(spark, sf).filter("type = 'nation'"), path)
    m = D.split_markdown(F.col("text"))
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), "slug")
    return files.select("slug", m["frontmatter"]["type"].alias("type"), m["frontmatter"]["title"].alias("title"), m["compiled_truth"].alias("body"))


@query(
    "p5_date_windows",
    """WITH w(name, a, b) AS (VALUES ('7d', TIMESTAMP '2024-02-08 12:00:00', NULL), ('2w', TIMESTAMP '2024-02-01 12:00:00', NULL), ('1y', TIMESTAMP '2023-02-15 12:00:00', NULL),
('day', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20 23:59:59.999999'), ('moment', TIMESTAMP '2024-01-10 06:30:00', TIMESTAMP '2024-01-10 18:00:00'))
SELECT name, count(ts) AS n FROM w LEFT JOIN events ON ts >= a AND (b IS NULL OR ts <= b) GROUP BY name""",
)
def date_windows(spark, sf):
    """Counts of events within bounds as users write them: relative, a day, a moment with its offset."""
    now = dt.datetime(2024, 2, 15, 12)
    bounds = {"7d": ("7d", None), "2w": ("2w", None), "1y": ("1y", None), "day": ("2024-01-10", "2024-01-20"), "moment": ("2024-01-10T06:30:00Z", "2024-01-10T20:00:00+02:00")}
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    counts = []
    for name, (since, until) in bounds.items():
        a, b = scope.date_window(since, until, now)
        inside = F.col("ts") >= F.to_timestamp(F.lit(a.isoformat(sep=" ")))
        if b is not None:
            inside = inside & (F.col("ts") <= F.to_timestamp(F.lit(b.isoformat(sep=" "))))
        counts.append(F.struct(F.lit(name).alias("name"), F.count(F.when(inside, 1)).alias("n")))
    return e.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.name", "x.n")


@query("t16_watched_folder", "SELECT sha256(n_name || chr(10)) AS content_hash, 'file' AS source_kind FROM nation UNION ALL SELECT sha256(r_name || chr(10)), 'inbox' FROM region UNION ALL SELECT sha256('lesson: ' || n_name || chr(10) || 'from ' || n_name), 'learning' FROM nation")
def watched_folder(spark, sf):
    """Files in a watched folder, an inbox and a file of learnings, each taken in by a stream until it has what is there."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    files, inbox, lines = (_folder(spark, x) for x in ("watched", "inbox", "learnings"))
    nation.select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(files)
    region.select("r_regionkey", F.col("r_name").alias("value")).write.partitionBy("r_regionkey").text(inbox)
    nation.select(F.lit("lesson").alias("type"), F.col("n_name").alias("key"), F.concat(F.lit("from "), "n_name").alias("insight"), F.lit(0.5).alias("confidence")).write.json(lines)
    streams = [I.watch_folder(spark, f"{files}/*"), I.inbox_folder(spark, f"{inbox}/*", _folder(spark, "done")), I.learnings(spark, lines).drop("confidence")]
    found = [I.drained(s, _folder(spark, "stream")).select("content_hash", "source_kind") for s in streams]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("s9_code_import", "SELECT p_partkey, unnest(['C', 'C.m' || p_partkey, 'f']) AS symbol FROM part")
def code_import(spark, sf):
    code = F.concat(F.lit("class C:\n    def m"), F.col("p_partkey").cast("string"), F.lit("(self):\n        return f(1)\n\ndef f(x):\n    return x\n"))
    p = table(spark, sf, "part").select("p_partkey", code.alias("code"))
    return C.exploded(p, "p_partkey", "code", lambda t: [x["symbol"] for x in C.code_chunks(t)]).select("p_partkey", F.col("chunk_text").alias("symbol"))


@query("x2_semantic_chunks", f"WITH {BOUNDARIES_SQL} SELECT p.label AS page_id, p.vec_id AS chunk_id, count(q.place) AS part FROM p LEFT JOIN q ON q.label = p.label AND q.place <= p.i GROUP BY ALL")
def semantic_chunks(spark, sf):
    """Each label's sequence of vectors cut at its semantic boundaries."""
    return clusters.semantic_parts(views.chunks(spark, sf), ["page_id"], "chunk_id", "embedding")


@query("x7_named_aggregates", f"{with_views('takes')} SELECT domain, round(avg((weight - (quality = 'correct')::INT) ** 2) FILTER (WHERE quality IN ('correct', 'incorrect')), 6) AS scalar_brier, round(avg((quality = 'correct')::INT) FILTER (WHERE quality IN ('correct', 'incorrect')), 6) AS count_accuracy FROM takes_v GROUP BY domain")
def named_aggregates(spark, sf):
    names = ["scalar_brier", "count_accuracy"]
    return plugins.aggregate_by_name(views.takes(spark, sf), ["domain"], names).withColumns({n: F.round(n, 6) for n in names})


@query("x6_plugin_source", "SELECT user_id AS id, 'person-' || user_id || '/' || event_type AS slug, count(*) AS n FROM events GROUP BY ALL")
def plugin_source(spark, sf):
    """Events resolved to pages by a plug-in that is named, as a caller's own would be."""
    e = table(spark, sf, "events").select("user_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("name"))
    return plugins.resolved(e, "name", "fathomline.plans.q_more:slugs_of").groupBy(F.col("user_id").alias("id"), F.col("resolved").alias("slug")).agg(F.count(F.lit(1)).alias("n"))


def slugs_of(names: list[str]) -> list[str]:
    return ["person-{}/{}".format(*x.split("|")) for x in names]


@query("f3_slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & Co. (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slugify(F.concat("p_name", F.lit(" & Co. ("), "p_brand", F.lit(")"))).alias("slug"))


@query("f8_safe_truncate", "SELECT doc_id, substr(text, 1, 100) AS head, true AS well_formed FROM documents")
def safe_truncate(spark, sf):
    """Texts are UTF-8 and cut at code points, so a cut text is always well formed."""
    head = F.substring("text", 1, 100)
    return table(spark, sf, "documents").select("doc_id", head.alias("head"), F.is_valid_utf8(head).alias("well_formed"))


@query("r7_effective_k", "SELECT event_type, CASE WHEN w > 0 THEN 60 / w ELSE 60 END AS k FROM (SELECT event_type, CASE event_type WHEN 'view' THEN 1.2 WHEN 'click' THEN 0.0 ELSE 0.8 END::DOUBLE AS w FROM events GROUP BY event_type)")
def effective_k(spark, sf):
    weights = {"view": 1.2, "click": 0.0}
    w = F.lit(R.effective_k(60.0, 0.8))
    for name, value in weights.items():
        w = F.when(F.col("event_type") == name, R.effective_k(60.0, value)).otherwise(w)
    return table(spark, sf, "events").select("event_type").distinct().select("event_type", w.alias("k"))


@query("t5_restart_delays", "SELECT DISTINCT l_linenumber AS crash, least(60.0, power(2.0, l_linenumber - 1)) AS delay FROM lineitem")
def restart_delays(spark, sf):
    policy = RestartPolicy()
    found = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("crash")).distinct()
    return found.withColumn("delay", F.least(F.lit(policy.longest), F.lit(policy.first) * F.pow(F.lit(2.0), F.col("crash") - 1)))
