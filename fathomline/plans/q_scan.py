"""Queries over scans, predicates, writes, sorts and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomline.operators import scope, writes
from fathomline.plans.catalog import query
from fathomline.session import table
from fathomline.sources import views
from fathomline.sources.views import with_views

NOW = dt.datetime(2024, 2, 15)
FACTORS = {"en/": 1.5, "en/1": 1.2, "en/12": 0.8, "de/": 1.1, "fr/9": 0.3}
_CASE = "CASE WHEN slug LIKE 'en/12%' THEN 0.8 WHEN slug LIKE 'en/1%' THEN 1.2 WHEN slug LIKE 'fr/9%' THEN 0.3 WHEN slug LIKE 'de/%' THEN 1.1 WHEN slug LIKE 'en/%' THEN 1.5 ELSE 1.0 END"
_VISIBLE = "deleted_at IS NULL AND coalesce(json_extract(frontmatter, '$.quarantine') IS NULL, true) AND source_id NOT IN (SELECT id FROM sources_v WHERE archived)"


@query("s1_get_page", f"{with_views('pages')} SELECT page_id, source_id, slug, title, n_chars FROM pages_v WHERE source_id = 'src7' AND slug IN ('en/7', 'fr/27', 'de/47', 'en/67') AND deleted_at IS NULL")
def get_page(spark, sf):
    p = views.pages(spark, sf)
    return p.filter((F.col("source_id") == "src7") & F.col("slug").isin("en/7", "fr/27", "de/47", "en/67") & F.col("deleted_at").isNull()).select("page_id", "source_id", "slug", "title", "n_chars")


@query(
    "s2_list_pages",
    f"{with_views('pages')} SELECT page_id, slug, type, updated_at FROM pages_v WHERE deleted_at IS NULL AND type = 'en' AND slug LIKE 'en/1%' AND updated_at > TIMESTAMP '2024-01-05' AND page_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY updated_at DESC, page_id LIMIT 50 OFFSET 10",
)
def list_pages(spark, sf):
    tagged = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("page_id"))
    p = views.pages(spark, sf).filter("deleted_at is null and type = 'en' and startswith(slug, 'en/1') and updated_at > timestamp '2024-01-05'")
    return p.join(tagged, "page_id", "left_semi").orderBy(F.col("updated_at").desc(), "page_id").offset(10).limit(50).select("page_id", "slug", "type", "updated_at")


@query("s3_all_refs", f"{with_views('pages')} SELECT DISTINCT source_id, slug FROM pages_v WHERE deleted_at IS NULL")
def all_refs(spark, sf):
    return views.pages(spark, sf).filter("deleted_at is null").select("source_id", "slug").distinct()


@query("s3_all_sources", f"{with_views('sources')} SELECT id, n_pages, archived FROM sources_v")
def all_sources(spark, sf):
    return views.sources(spark, sf).select("id", "n_pages", "archived")


@query("s4_resolve_paths", f"{with_views('pages')} SELECT 'notes/' || slug || '.md' AS path, slug, page_id FROM pages_v JOIN (SELECT 'notes/en/' || event_id || '.md' AS path FROM events WHERE event_type = 'click') w ON w.path = 'notes/' || slug || '.md'")
def resolve_paths(spark, sf):
    wanted = table(spark, sf, "events").filter("event_type = 'click'").select(F.concat(F.lit("notes/en/"), F.col("event_id").cast("string"), F.lit(".md")).alias("path"))
    return views.pages(spark, sf).select("slug", "page_id", F.concat(F.lit("notes/"), "slug", F.lit(".md")).alias("path")).join(wanted, "path")


@query("s12_conversation_pages", "SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def conversation_pages(spark, sf):
    c = table(spark, sf, "conversations")
    line = F.concat("role", F.lit(": "), "text")
    turns = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(turns, lambda x: x["line"]), "\n").alias("body"))


@query("s17_raw_sql", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer WHERE c_acctbal > 1000 GROUP BY c_mktsegment")
def raw_sql(spark, sf):
    return spark.sql("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM {c} WHERE c_acctbal > :least GROUP BY c_mktsegment", args={"least": 1000}, c=table(spark, sf, "customer"))


@query("p1_source_factor", f"{with_views('pages')} SELECT page_id, slug, {_CASE}::DOUBLE AS factor FROM pages_v")
def source_factor(spark, sf):
    return views.pages(spark, sf).select("page_id", "slug", scope.prefix_case(F.col("slug"), FACTORS).alias("factor"))


@query("p2_hard_exclude", f"{with_views('pages')} SELECT page_id, slug FROM pages_v WHERE NOT slug LIKE 'de/%' AND NOT slug LIKE 'en/4%'")
def hard_exclude(spark, sf):
    return scope.hard_exclude(views.pages(spark, sf), prefixes=("de/", "en/4", "fr/"), include=("fr/",)).select("page_id", "slug")


@query("p3_visible_pages", f"{with_views('pages', 'sources')} SELECT page_id, source_id, slug FROM pages_v WHERE {_VISIBLE}")
def visible_pages(spark, sf):
    return scope.visible(views.pages(spark, sf), views.sources(spark, sf)).select("page_id", "source_id", "slug")


@query("p4_quarantine_flags", f"{with_views('pages')} SELECT page_id, coalesce(json_extract(frontmatter, '$.quarantine') IS NOT NULL, false) AS quarantined, coalesce(json_extract(frontmatter, '$.tags') IS NOT NULL, false) AS tagged FROM pages_v")
def quarantine_flags(spark, sf):
    f = F.col("frontmatter")
    return views.pages(spark, sf).select("page_id", scope.has_key(f, "quarantine").alias("quarantined"), scope.has_key(f, "tags").alias("tagged"))


@query(
    "p6_date_window",
    f"{with_views('pages')} SELECT page_id, coalesce(effective_date, updated_at, created_at) AS d FROM pages_v WHERE coalesce(effective_date, updated_at, created_at) >= TIMESTAMP '2024-01-16' AND coalesce(effective_date, updated_at, created_at) <= TIMESTAMP '2024-02-03 23:59:59.999999'",
)
def date_window(spark, sf):
    since, until = scope.date_window("30d", "2024-02-03", NOW)
    return scope.in_window(views.pages(spark, sf), since, until).select("page_id", scope.page_date().alias("d"))


_P7 = """p AS (SELECT doc_id, lang || '/' || doc_id AS slug, CASE doc_id % 5 WHEN 0 THEN '2023-0' || (1 + doc_id % 9) || '-11' WHEN 1 THEN '1980-01-01' WHEN 2 THEN 'soon' END AS ev,
 CASE WHEN doc_id % 4 = 1 THEN '2022-05-0' || (1 + doc_id % 9) END AS da, CASE WHEN doc_id % 7 = 2 THEN '2021-12-25' END AS pu, CASE WHEN doc_id % 3 = 0 THEN '2020-02-0' || (1 + doc_id % 9) || '-note.md' ELSE 'note.md' END AS fn,
 TIMESTAMP '2024-01-01' + to_hours(doc_id) AS up FROM documents),
v AS (SELECT doc_id, slug, CASE WHEN try_cast(ev AS TIMESTAMP) >= TIMESTAMP '1990-01-01' AND try_cast(ev AS TIMESTAMP) <= TIMESTAMP '2025-02-14' THEN try_cast(ev AS TIMESTAMP) END AS ev, da::TIMESTAMP AS da, pu::TIMESTAMP AS pu,
 try_cast(nullif(regexp_extract(fn, '^(\\d{4}-\\d{2}-\\d{2})', 1), '') AS TIMESTAMP) AS fn, up FROM p)"""


@query(
    "p7_effective_date",
    f"WITH {_P7} SELECT doc_id, CASE WHEN slug LIKE 'de/%' THEN coalesce(fn, ev, da, pu, up) ELSE coalesce(ev, da, pu, fn, up) END AS d, CASE WHEN slug LIKE 'de/%' AND fn IS NOT NULL THEN 'filename' WHEN ev IS NOT NULL THEN 'event_date' WHEN da IS NOT NULL THEN 'date' WHEN pu IS NOT NULL THEN 'published' WHEN fn IS NOT NULL THEN 'filename' ELSE 'fallback' END AS label FROM v",
)
def effective_dates(spark, sf):
    i = F.col("doc_id")
    day = (1 + i % 9).cast("string")
    d = table(spark, sf, "documents").select(
        "doc_id",
        F.concat_ws("/", "lang", i.cast("string")).alias("slug"),
        F.when(i % 5 == 0, F.concat(F.lit("2023-0"), day, F.lit("-11"))).when(i % 5 == 1, "1980-01-01").when(i % 5 == 2, "soon").alias("ev"),
        F.when(i % 4 == 1, F.concat(F.lit("2022-05-0"), day)).alias("da"),
        F.when(i % 7 == 2, "2021-12-25").alias("pu"),
        F.when(i % 3 == 0, F.concat(F.lit("2020-02-0"), day, F.lit("-note.md"))).otherwise("note.md").alias("fn"),
        F.timestamp_add("HOUR", i.cast("int"), F.to_timestamp(F.lit(views.EPOCH))).alias("up"),
    )
    date, label = scope.effective_date(F.col("ev"), F.col("da"), F.col("pu"), F.col("fn"), F.col("up"), F.col("up"), NOW, F.col("slug").startswith("de/"))
    return d.select("doc_id", date.alias("d"), label.alias("label"))


@query("p9_type_filter", f"{with_views('pages')} SELECT page_id, type FROM pages_v WHERE type IN ('fr', 'es') AND n_chars BETWEEN 500 AND 2000")
def type_filter(spark, sf):
    return views.pages(spark, sf).filter(F.col("type").isin("fr", "es") & F.col("n_chars").between(500, 2000)).select("page_id", "type")


_SLUGS = "s AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '_index' WHEN 1 THEN 'people/' || doc_id || '/log' WHEN 2 THEN 'notes/raw/' || doc_id WHEN 3 THEN 'scripts/' || doc_id WHEN 4 THEN 'thoughts/' || doc_id WHEN 5 THEN '' ELSE lang || '/' || doc_id END AS slug FROM documents)"


def _slugs(spark, sf):
    i = F.col("doc_id")
    t = i.cast("string")
    slug = F.when(i % 9 == 0, "_index").when(i % 9 == 1, F.concat(F.lit("people/"), t, F.lit("/log"))).when(i % 9 == 2, F.concat(F.lit("notes/raw/"), t)).when(i % 9 == 3, F.concat(F.lit("scripts/"), t)).when(i % 9 == 4, F.concat(F.lit("thoughts/"), t)).when(i % 9 == 5, "").otherwise(F.concat_ws("/", "lang", t))
    return table(spark, sf, "documents").select("doc_id", slug.alias("slug"))


@query("p10_orphan_exempt", f"WITH {_SLUGS} SELECT doc_id, slug IN ('_atlas', '_index', '_stats', '_orphans', '_scratch', 'claude') OR slug LIKE '%/\\_index' ESCAPE '\\' OR slug LIKE '%/log' OR contains(slug, '/raw/') OR slug LIKE 'output/%' OR slug LIKE 'dashboards/%' OR slug LIKE 'scripts/%' OR slug LIKE 'templates/%' OR split_part(slug, '/', 1) IN ('scratch', 'thoughts', 'catalog', 'entities') AS exempt FROM s")
def orphan_exempt(spark, sf):
    return _slugs(spark, sf).select("doc_id", scope.orphan_exempt(F.col("slug")).alias("exempt"))


@query("p11_domain", f"WITH {_SLUGS} SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 4 = 0 THEN '  ops ' WHEN doc_id % 4 = 1 THEN '  ' END), ''), nullif(split_part(slug, '/', 1), ''), 'root') AS domain FROM s")
def domains(spark, sf):
    declared = F.when(F.col("doc_id") % 4 == 0, "  ops ").when(F.col("doc_id") % 4 == 1, "  ")
    return _slugs(spark, sf).select("doc_id", scope.domain_of(declared, F.col("slug")).alias("domain"))


@query("p12_thin_bodies", "SELECT doc_id FROM documents WHERE length(trim(coalesce(text, ''))) < 200")
def thin_bodies(spark, sf):
    return table(spark, sf, "documents").filter(scope.thin_body(F.col("text"), 200)).select("doc_id")


@query("p13_literal_search", "SELECT doc_id FROM documents WHERE contains(text, '%%%') AND contains(text, '***')")
def literal_search(spark, sf):
    a, b = scope.like_escaped("%%%"), scope.like_escaped("***")
    return table(spark, sf, "documents").filter(F.col("text").like(f"%{a}%") & F.col("text").like(f"%{b}%")).select("doc_id")


@query(
    "p14_prose_share",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '```[^`]*```', ' ', 'g'), '`[^`\n]*`', ' ', 'g') AS c FROM pages),
b AS (SELECT page_id, length(regexp_replace(c, '\s+', '', 'g')) AS total, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', ' ', 'g'), '(?m)^[#>*+-]+', ' ', 'g'), '\|', ' ', 'g'), '[*_~]', ' ', 'g'), '\s+', '', 'g')) AS prose FROM a)
SELECT page_id, prose AS prose_chars, total AS total_chars, round(least(1.0, greatest(0.0, (total - prose)::DOUBLE / total)), 6) AS markup_ratio FROM b""",
)
def prose_share(spark, sf):
    prose, total, ratio = scope.prose_share(F.col("html"))
    return table(spark, sf, "pages").select("page_id", prose.alias("prose_chars"), total.alias("total_chars"), F.round(ratio, 6).alias("markup_ratio"))


@query("p15_stale_rows", "SELECT vec_id FROM embeddings WHERE vec_id % 10 = 0 OR (CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN 'm1' ELSE 'm2' END) IS DISTINCT FROM 'm2'")
def stale_rows(spark, sf):
    i = F.col("vec_id")
    return table(spark, sf, "embeddings").filter(scope.stale(F.when(i % 10 != 0, F.col("embedding")), F.when(i % 3 == 1, "m1").when(i % 3 == 2, "m2"), "m2")).select("vec_id")


@query(
    "k1_upsert",
    """WITH o AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'crm' END AS via, c_acctbal AS v FROM customer WHERE c_acctbal > 0), n AS (SELECT c_custkey AS id, upper(c_name) AS name, 'web' AS via, -c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, coalesce(o.via, n.via) AS via, round(CASE WHEN n.id IS NOT NULL THEN n.v ELSE o.v END, 2) AS v FROM o FULL JOIN n ON o.id = n.id""",
)
def upserted(spark, sf):
    c = table(spark, sf, "customer")
    old = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "crm").alias("via"), F.col("c_acctbal").alias("v"))
    new = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.lit("web").alias("via"), (-F.col("c_acctbal")).alias("v"))
    return writes.upsert(old, new, ["id"], first_write_wins=["via"]).withColumn("v", F.round("v", 2))


@query("k2_replace_set", "SELECT l_orderkey AS owner, l_linenumber AS k, l_quantity AS q FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_orderkey, 100, 1.0 FROM orders WHERE o_orderstatus = 'F'")
def replaced_set(spark, sf):
    li = table(spark, sf, "lineitem")
    old = li.select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("q"))
    new = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("owner"), F.lit(100).alias("k"), F.lit(1.0).alias("q"))
    return writes.replace_set(old, new, "owner")


@query("k3_insert_links", f"{with_views('links')} SELECT DISTINCT src, dst, link_type, link_source FROM links_v n WHERE link_type = 'buys_from' AND NOT EXISTS (SELECT 1 FROM links_v o WHERE o.link_type = 'buys_from' AND o.link_source = 'mentions' AND o.src = n.src AND o.dst = n.dst AND o.link_source IS NOT DISTINCT FROM n.link_source)")
def insert_links(spark, sf):
    e = views.links(spark, sf).filter("link_type = 'buys_from'")
    return writes.insert_ignore(e.filter("link_source = 'mentions'"), e, ["src", "dst", "link_type", "link_source"])


@query("k4_soft_delete_purge", f"{with_views('pages')} SELECT page_id, coalesce(deleted_at, CASE WHEN type = 'fr' THEN TIMESTAMP '2024-03-01' END) AS deleted_at FROM pages_v WHERE coalesce(deleted_at, CASE WHEN type = 'fr' THEN TIMESTAMP '2024-03-01' END) IS NULL OR coalesce(deleted_at, TIMESTAMP '2024-03-01') >= TIMESTAMP '2024-02-01'")
def soft_delete_purge(spark, sf):
    p = views.pages(spark, sf)
    gone = writes.soft_delete(p, p.filter("type = 'fr'"), ["page_id"], F.to_timestamp(F.lit("2024-03-01")))
    return writes.purge(gone, F.to_timestamp(F.lit("2024-02-01"))).select("page_id", "deleted_at")


@query("k5_additive_rollup", "SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n, sum((props::JSON->>'k')::BIGINT)::BIGINT AS k FROM events GROUP BY ALL")
def additive_rollup(spark, sf):
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_type", F.lit(1).cast("long").alias("n"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    whole = lambda c: e.filter(c).groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    return writes.add_counts(whole("n = 1 and k < 50"), whole("k >= 50"), ["day", "event_type"])


@query("k6_latest_version", "SELECT user_id, event_id AS version, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_version(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("version"), "ts", "value")
    return writes.latest_version(e, "user_id", "ts")


@query("k8_rewrite_links", f"{with_views('links')} SELECT src, CASE WHEN dst LIKE 'nations/%' THEN 'countries/' || substr(dst, 9) ELSE dst END AS dst, link_type, link_source FROM links_v")
def rewrite_links(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("nations/"), F.col("n_nationkey").cast("string")).alias("old"), F.concat(F.lit("countries/"), F.col("n_nationkey").cast("string")).alias("new"))
    return writes.rename(views.links(spark, sf), F.broadcast(n), "dst")


@query("k9_dedup_repair", "SELECT min(event_id) AS event_id, user_id, ts::DATE AS day, event_type FROM events GROUP BY user_id, ts::DATE, event_type")
def dedup_repair(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type")
    return writes.keep_smallest_id(e, ["user_id", "day", "event_type"], "event_id")


@query("k10_set_json_field", f"{with_views('pages')} SELECT page_id, CASE WHEN page_id % 29 = 0 THEN '{{\"kind\":\"alias\"}}' ELSE '{{\"k\":\"' || (page_id % 7) || '\",\"kind\":\"alias\"}}' END AS meta FROM pages_v WHERE type = 'de'")
def set_json_field(spark, sf):
    p = views.pages(spark, sf).filter("type = 'de'")
    meta = F.when(F.col("page_id") % 29 == 0, F.lit(None)).otherwise(F.to_json(F.struct((F.col("page_id") % 7).cast("string").alias("k"), F.lit("old").alias("kind"))))
    return writes.set_field(p.select("page_id", meta.alias("meta")), "meta", "kind", "alias")


@query(
    "s7_manifest_diff",
    """WITH o AS (SELECT 'f/' || p_partkey AS path, md5(p_name || p_partkey) AS hash FROM part WHERE p_size <> 3),
n AS (SELECT CASE WHEN p_size BETWEEN 5 AND 9 THEN 'g/' ELSE 'f/' END || p_partkey AS path, CASE WHEN p_size > 45 THEN 'new' ELSE md5(p_name || p_partkey) END AS hash FROM part WHERE p_size <> 1)
SELECT 'modified' AS change, n.path, NULL AS old_path FROM o JOIN n USING (path) WHERE o.hash <> n.hash
UNION ALL SELECT CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'renamed' END, coalesce(n.path, o.path), CASE WHEN n.path IS NOT NULL THEN o.path END
FROM (SELECT * FROM o WHERE path NOT IN (SELECT path FROM n)) o FULL JOIN (SELECT * FROM n WHERE path NOT IN (SELECT path FROM o)) n ON o.hash = n.hash""",
)
def manifest_diff(spark, sf):
    p = table(spark, sf, "part")
    t = F.col("p_partkey").cast("string")
    digest = F.md5(F.concat("p_name", t).cast("binary"))
    old = p.filter("p_size <> 3").select(F.concat(F.lit("f/"), t).alias("path"), digest.alias("hash"))
    new = p.filter("p_size <> 1").select(F.concat(F.when(F.col("p_size").between(5, 9), "g/").otherwise("f/"), t).alias("path"), F.when(F.col("p_size") > 45, "new").otherwise(digest).alias("hash"))
    return writes.manifest_diff(old, new)


@query("o1_whitelisted_order", f"{with_views('pages')} SELECT page_id, slug FROM pages_v ORDER BY updated_at DESC, page_id LIMIT 100")
def whitelisted_order(spark, sf):
    sorts = {"updated_desc": [F.desc("updated_at"), F.asc("page_id")], "slug": [F.asc("slug")]}
    return views.pages(spark, sf).orderBy(*sorts["updated_desc"]).limit(100).select("page_id", "slug")


@query("o2_case_order", "SELECT p_partkey, p_type FROM part ORDER BY CASE WHEN p_type LIKE 'PROMO%' THEN 0 WHEN p_type LIKE 'SMALL%' THEN 1 ELSE 2 END, p_name, p_partkey LIMIT 40")
def case_order(spark, sf):
    kind = F.when(F.col("p_type").startswith("PROMO"), 0).when(F.col("p_type").startswith("SMALL"), 1).otherwise(2)
    return table(spark, sf, "part").orderBy(kind, "p_name", "p_partkey").limit(40).select("p_partkey", "p_type")


@query("o3_nulls_last", f"{with_views('pages')} SELECT page_id, effective_date FROM pages_v ORDER BY effective_date ASC NULLS LAST, page_id LIMIT 500")
def nulls_last(spark, sf):
    return views.pages(spark, sf).orderBy(F.asc_nulls_last("effective_date"), "page_id").limit(500).select("page_id", "effective_date")


@query("o4_next_job", f"{with_views('jobs')} SELECT id, priority, created_at FROM jobs_v WHERE status = 'waiting' ORDER BY priority, created_at, id LIMIT 1")
def next_job(spark, sf):
    return views.jobs(spark, sf).filter("status = 'waiting'").orderBy("priority", "created_at", "id").limit(1).select("id", "priority", "created_at")


@query("o6_newest_paths", f"{with_views('pages')} SELECT slug FROM pages_v ORDER BY slug DESC LIMIT 60")
def newest_paths(spark, sf):
    return views.pages(spark, sf).select("slug").orderBy(F.desc("slug")).limit(60)


@query("u1_union_all", "SELECT c_nationkey AS nation, 'c' AS kind, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 's', count(*) FROM supplier GROUP BY 1")
def union_all(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.lit("c").alias("kind"), F.count(F.lit(1)).alias("n"))
    return c.unionByName(table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.lit("s").alias("kind"), F.count(F.lit(1)).alias("n")))


@query("u2_union_distinct", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def union_distinct(spark, sf):
    return table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf, "supplier").filter("s_acctbal < 0").select("s_nationkey")).dropDuplicates()


@query("u3_intersect", "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 300000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersected(spark, sf):
    return table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("id")).intersect(table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey"))


@query("u4_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def excepted(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")), "id", "left_anti").distinct()


@query("u5_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_pairs(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("w1_distinct_on", "SELECT DISTINCT ON (label) label, vec_id, round(embedding[1]::DOUBLE, 6) AS e0 FROM embeddings ORDER BY label, embedding[1]::DOUBLE DESC, vec_id")
def distinct_on(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("e0", F.col("embedding")[0].cast("double"))
    w = W.partitionBy("label").orderBy(F.desc("e0"), "vec_id")
    return e.withColumn("n", F.row_number().over(w)).filter("n = 1").select("label", "vec_id", F.round("e0", 6).alias("e0"))
