"""Queries over aggregates, windows and time series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomline.functions import text as T
from fathomline.functions import vector as V
from fathomline.operators import analytics as A
from fathomline.operators import clusters, ontology, ordered, scope
from fathomline.plans.catalog import query
from fathomline.session import bounded_batches, table
from fathomline.sources import views
from fathomline.sources.views import with_views


def _r(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("a1_count_by_key", f"{with_views('jobs')} SELECT status, priority, count(*) AS n FROM jobs_v GROUP BY ALL")
def count_by_key(spark, sf):
    return views.jobs(spark, sf).groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("a2_conditional_aggregates", f"{with_views('jobs')} SELECT queue, count(*) FILTER (WHERE status = 'completed') AS done, round(avg(cost) FILTER (WHERE status = 'completed'), 4) AS mean_cost, max(created_at) FILTER (WHERE status = 'waiting') AS last_waiting FROM jobs_v GROUP BY queue")
def conditional_aggregates(spark, sf):
    j = views.jobs(spark, sf)
    done = F.col("status") == "completed"
    return j.groupBy("queue").agg(F.count(F.when(done, 1)).alias("done"), F.round(F.avg(F.when(done, F.col("cost"))), 4).alias("mean_cost"), F.max(F.when(F.col("status") == "waiting", F.col("created_at"))).alias("last_waiting"))


@query("a3_json_group", "SELECT (props::JSON->>'k')::INT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_group(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("a4_having_buckets", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 15")
def having_buckets(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).filter("n >= 15")


@query("a5_prefix_clusters", "SELECT split_part(p_name, ' ', 1) AS prefix, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types FROM part GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10")
def prefix_clusters(spark, sf):
    p = table(spark, sf, "part").groupBy(F.regexp_extract("p_name", "^([^ ]*)", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"))
    return p.orderBy(F.desc("n"), "prefix").limit(10)


@query("a6_type_coverage", f"{with_views('pages')} SELECT source_id, nullif(CASE WHEN page_id % 6 = 0 THEN '' ELSE type END, '') AS type, count(*) AS n FROM pages_v GROUP BY ALL")
def type_coverage(spark, sf):
    return views.pages(spark, sf).groupBy("source_id", F.nullif(F.when(F.col("page_id") % 6 == 0, "").otherwise(F.col("type")), F.lit("")).alias("type")).agg(F.count(F.lit(1)).alias("n")).orderBy("source_id", F.asc_nulls_last("type"))


@query("a7_embed_coverage", "SELECT source, count(*) AS chunks, count(vec_id) AS embedded, round(count(vec_id)::DOUBLE / count(*), 6) AS coverage FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source")
def embed_coverage(spark, sf):
    d = table(spark, sf, "documents").select("source", F.col("doc_id").alias("vec_id"))
    e = table(spark, sf, "embeddings").select("vec_id", F.lit(True).alias("has"))
    return d.join(e, "vec_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.count("has").alias("embedded"), F.round(F.count("has") / F.count(F.lit(1)), 6).alias("coverage"))


@query("a8_stats", "SELECT (SELECT count(*) FROM documents) AS pages, (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(*) FROM lineitem) AS takes, (SELECT array_to_string(list_sort(list(lang || '=' || n)), ',') FROM (SELECT lang, count(*)::VARCHAR AS n FROM documents GROUP BY lang)) AS by_type")
def stats(spark, sf):
    one = lambda name, t: table(spark, sf, t).agg(F.count(F.lit(1)).alias(name)).withColumn("k", F.lit(1))
    by = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.sort_array(F.collect_list(F.concat("lang", F.lit("="), F.col("n").cast("string")))), ",").alias("by_type")).withColumn("k", F.lit(1))
    return one("pages", "documents").join(one("chunks", "embeddings"), "k").join(one("takes", "lineitem"), "k").join(by, "k").drop("k")


@query(
    "a9_health",
    f"""{with_views('links')}, p AS (SELECT 35 * count(vec_id)::DOUBLE / count(*) AS embed FROM documents LEFT JOIN embeddings ON vec_id = doc_id), l AS (SELECT 25 * count(DISTINCT dst)::DOUBLE / (SELECT count(*) + 0 FROM supplier) AS linked FROM links_v WHERE dst LIKE 'suppliers/%'), t AS (SELECT 15 * count(*) FILTER (WHERE doc_id % 3 = 0)::DOUBLE / count(*) AS dated FROM documents)
SELECT round(embed, 4) AS embed, round(linked, 4) AS linked, round(dated, 4) AS dated, round(embed + linked + dated + 25, 4) AS score FROM p, l, t""",
)
def health(spark, sf):
    """0 to 100: 35 for embeddings, 25 for links, 15 for dates, and 15 + 10 for orphans and dead links (none here)."""
    k = F.lit(1).alias("k")
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has")), "doc_id", "left")
    p = d.agg((35 * F.count("has") / F.count(F.lit(1))).alias("embed"), (15 * F.count(F.when(F.col("doc_id") % 3 == 0, 1)) / F.count(F.lit(1))).alias("dated")).select("*", k)
    n = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n")).select("*", k)
    ln = views.links(spark, sf).filter("startswith(dst, 'suppliers/')").agg(F.countDistinct("dst").alias("d")).select("*", k)
    out = p.join(n, "k").join(ln, "k").withColumn("linked", 25 * F.col("d") / F.col("n"))
    return out.select(F.round("embed", 4).alias("embed"), F.round("linked", 4).alias("linked"), F.round("dated", 4).alias("dated"), F.round(F.col("embed") + F.col("linked") + F.col("dated") + 25, 4).alias("score"))


_CARD = "count(*) AS total, count(quality) AS resolved, count(*) FILTER (WHERE quality = 'correct') AS correct, count(*) FILTER (WHERE quality = 'incorrect') AS incorrect, count(*) FILTER (WHERE quality = 'partial') AS partial, round(count(*) FILTER (WHERE quality = 'correct')::DOUBLE / nullif(count(*) FILTER (WHERE quality IN ('correct', 'incorrect')), 0), 6) AS accuracy, round(avg((weight - (quality = 'correct')::INT) ** 2) FILTER (WHERE quality IN ('correct', 'incorrect')), 6) AS brier, round(count(*) FILTER (WHERE quality = 'partial')::DOUBLE / nullif(count(quality), 0), 6) AS partial_rate"


@query("a10_scorecard", f"{with_views('takes')} SELECT holder, {_CARD} FROM takes_v WHERE holder IN ('h0', 'h2', 'h5') GROUP BY holder")
def scorecard(spark, sf):
    return _r(A.scorecard(views.takes(spark, sf), ["holder"], ["h0", "h2", "h5"]), "accuracy", "brier", "partial_rate")


@query("a11_calibration_curve", f"{with_views('takes')} SELECT least(floor(weight / 0.1 + 1e-9), 9)::INT AS bin, count(*) AS n, round(avg((quality = 'correct')::INT), 6) AS observed, round(avg(weight), 6) AS predicted FROM takes_v WHERE quality IN ('correct', 'incorrect') GROUP BY 1")
def calibration_curve(spark, sf):
    return _r(A.calibration_curve(views.takes(spark, sf)), "observed", "predicted")


@query("a12_brier_by_domain", f"{with_views('takes')} SELECT domain, p_brand, round(avg((weight - (quality = 'correct')::INT) ** 2), 6) AS brier, count(*) AS n FROM takes_v JOIN part ON p_partkey = page_id WHERE quality IN ('correct', 'incorrect') GROUP BY ALL")
def brier_by_domain(spark, sf):
    t = views.takes(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), "p_brand"), "page_id")
    o = A.binary_outcome()
    return t.filter(o.isNotNull()).groupBy("domain", "p_brand").agg(F.round(F.avg(F.pow(F.col("weight") - o, F.lit(2))), 6).alias("brier"), F.count(F.lit(1)).alias("n"))


@query("a13_conviction_brier", f"{with_views('takes')} SELECT domain, round(sum((weight - (quality = 'correct')::INT) ** 2 * abs(weight - 0.5) * 2) / nullif(sum(abs(weight - 0.5) * 2), 0), 6) AS brier, count(*) AS n FROM takes_v WHERE quality IN ('correct', 'incorrect') GROUP BY domain")
def conviction_brier(spark, sf):
    return _r(A.conviction_brier(views.takes(spark, sf), ["domain"]), "brier")


@query("a14_count_accuracy", f"{with_views('takes')} SELECT domain, sum((quality = 'correct')::INT)::BIGINT AS hits, count(*) AS n, round(sum((quality = 'correct')::INT)::DOUBLE / count(*), 6) AS accuracy FROM takes_v WHERE quality IN ('correct', 'incorrect') AND weight >= 0.5 GROUP BY domain")
def count_accuracy(spark, sf):
    o = A.binary_outcome()
    return views.takes(spark, sf).filter(o.isNotNull() & (F.col("weight") >= 0.5)).groupBy("domain").agg(F.sum(o).cast("long").alias("hits"), F.count(F.lit(1)).alias("n"), F.round(F.avg(o), 6).alias("accuracy"))


@query("a15_tier_pivot", f"{with_views('takes')} SELECT holder, count(*) FILTER (WHERE weight >= 0.8) AS \"T1\", count(*) FILTER (WHERE weight >= 0.5 AND weight < 0.8) AS \"T2\", count(*) FILTER (WHERE weight >= 0.2 AND weight < 0.5) AS \"T3\", count(*) FILTER (WHERE weight < 0.2) AS \"T4\" FROM takes_v GROUP BY holder")
def tier_pivot(spark, sf):
    t = views.takes(spark, sf).withColumn("tier", F.coalesce(A.tier(F.col("weight"), {"T1": 0.8, "T2": 0.5, "T3": 0.2}), F.lit("T4")))
    return t.groupBy("holder").pivot("tier", ["T1", "T2", "T3", "T4"]).agg(F.count(F.lit(1))).na.fill(0)


@query("a16_forecast", f"{with_views('takes')}, c AS (SELECT holder, domain, count(*) AS n, avg((weight - (quality = 'correct')::INT) ** 2) AS b FROM takes_v WHERE quality IN ('correct', 'incorrect') GROUP BY ALL) SELECT id, round(CASE WHEN n >= 5 THEN b END, 6) AS forecast FROM takes_v LEFT JOIN c USING (holder, domain) WHERE quality IS NULL")
def forecast(spark, sf):
    return A.forecast(views.takes(spark, sf), ["holder", "domain"]).select("id", F.round("forecast", 6).alias("forecast"))


@query("a17_telemetry", "SELECT event_type AS mode, count(*) AS calls, round(count(*) FILTER (WHERE value > 50)::DOUBLE / count(*), 6) AS hit_rate, round(avg(value), 6) AS mean_value, round(avg((props::JSON->>'k')::INT), 6) AS mean_k FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1")
def telemetry(spark, sf):
    e = table(spark, sf, "events").filter("ts >= timestamp '2024-01-16'")
    return e.groupBy(F.col("event_type").alias("mode")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.count(F.when(F.col("value") > 50, 1)) / F.count(F.lit(1)), 6).alias("hit_rate"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.avg(F.get_json_object("props", "$.k").cast("int")), 6).alias("mean_k"))


@query("a18_week_rollup", "SELECT event_type, count(*) AS n, max(ts) AS last FROM events WHERE ts >= TIMESTAMP '2024-01-23' GROUP BY 1")
def week_rollup(spark, sf):
    return table(spark, sf, "events").filter("ts >= timestamp '2024-01-23'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


@query("a19_usage_precision", "SELECT event_type AS arm, user_id % 3 AS channel, count(*) AS shown, count(*) FILTER (WHERE value > 20) AS used, round(count(*) FILTER (WHERE value > 20)::DOUBLE / count(*), 3) AS precision FROM events GROUP BY ALL")
def usage_precision(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 3).alias("channel")).agg(F.count(F.lit(1)).alias("shown"), F.count(F.when(F.col("value") > 20, 1)).alias("used"), F.round(F.count(F.when(F.col("value") > 20, 1)) / F.count(F.lit(1)), 3).alias("precision"))


@query(
    "a20_anomalies",
    """WITH c AS (SELECT user_id AS cohort, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT cohort, day::DATE AS day FROM (SELECT DISTINCT cohort FROM c), generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY) AS g(day)),
f AS (SELECT d.cohort, d.day, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (cohort, day)), b AS (SELECT cohort, avg(n) AS mean, coalesce(stddev_samp(n), 0) AS sd FROM f WHERE day < DATE '2024-01-28' GROUP BY cohort)
SELECT cohort, n AS today, round(mean, 6) AS mean, round(CASE WHEN sd > 0 THEN (n - mean) / sd ELSE n - mean END, 6) AS sigma FROM f JOIN b USING (cohort) WHERE day = DATE '2024-01-28' AND n > mean + CASE WHEN sd > 0 THEN 1.5 * sd ELSE 1 END ORDER BY CASE WHEN sd > 0 THEN (n - mean) / sd ELSE n - mean END DESC, cohort LIMIT 20""",
)
def anomalies(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    a = A.anomalies(A.daily_cohorts(e, "user_id", "day"), F.to_date(F.lit("2024-01-28")), sigma=1.5)
    return a.select("cohort", "today", F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"))


@query(
    "a21_emotional_weight",
    f"{with_views('takes')}, t AS (SELECT page_id, count(*) AS n, avg(least(1, greatest(0, weight))) AS w, count(*) FILTER (WHERE holder = 'h1')::DOUBLE / count(*) AS s FROM takes_v WHERE active GROUP BY 1) SELECT doc_id, round(least(1.0, greatest(0.0, CASE WHEN toxic = 1 THEN 0.5 ELSE 0 END + least(0.3, 0.1 * coalesce(n, 0)) + 0.1 * coalesce(w, 0) + 0.1 * coalesce(s, 0)))::DOUBLE, 6) AS weight FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN t ON page_id = doc_id",
)
def emotional_weights(spark, sf):
    """Claims and tags are summed apart, then joined: never claims times tags."""
    t = views.takes(spark, sf).filter("active").groupBy(F.col("page_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("weight")))).alias("w"), (F.count(F.when(F.col("holder") == "h1", 1)) / F.count(F.lit(1))).alias("s"))
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left").join(t, "doc_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return d.select("doc_id", F.round(A.emotional_weight(F.col("toxic") == 1, z("n"), z("w"), z("s")), 6).alias("weight"))


@query("a22_recent_salience", f"{with_views('pages', 'takes')}, t AS (SELECT page_id, count(*) AS n FROM takes_v WHERE active GROUP BY 1) SELECT p.page_id, round(5 * (p.page_id % 10 / 10.0) + ln(1 + coalesce(n, 0)) + 1 / (1 + greatest(0, date_diff('day', updated_at::DATE, DATE '2024-02-15'))), 6) AS salience FROM pages_v p LEFT JOIN t USING (page_id) WHERE updated_at >= TIMESTAMP '2024-02-01' AND updated_at <= TIMESTAMP '2024-02-15' AND slug LIKE 'en/%' ORDER BY salience DESC, p.page_id LIMIT 50")
def recent_salience(spark, sf):
    t = views.takes(spark, sf).filter("active").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    p = views.pages(spark, sf).filter("updated_at between timestamp '2024-02-01' and timestamp '2024-02-15' and startswith(slug, 'en/')")
    days = F.datediff(F.lit("2024-02-15").cast("date"), F.to_date("updated_at"))
    s = F.round(A.salience(F.col("page_id") % 10 / 10, F.coalesce("n", F.lit(0)), days), 6)
    return p.join(t, "page_id", "left").select("page_id", s.alias("salience")).orderBy(F.desc("salience"), "page_id").limit(50)


@query("a23_enrich_candidates", f"{with_views('links')} SELECT doc_id, count(l_orderkey) AS inbound FROM documents LEFT JOIN lineitem ON l_partkey = doc_id AND l_quantity > 25 WHERE length(trim(text)) < 400 AND lang IN ('en', 'de') GROUP BY doc_id ORDER BY inbound DESC, doc_id LIMIT 100")
def enrich_candidates(spark, sf):
    n = table(spark, sf, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    d = table(spark, sf, "documents").filter(scope.thin_body(F.col("text"), 400) & F.col("lang").isin("en", "de")).select("doc_id")
    return d.join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("inbound")).orderBy(F.desc("inbound"), "doc_id").limit(100)


@query("a24_facts_health", f"{with_views('facts')} SELECT count(*) AS total, count(*) FILTER (WHERE expired_at IS NULL) AS live, count(DISTINCT entity) AS entities, count(*) FILTER (WHERE valid_from >= TIMESTAMP '2024-01-29') AS today FROM facts_v")
def facts_health(spark, sf):
    return views.facts(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("expired_at").isNull(), 1)).alias("live"), F.countDistinct("entity").alias("entities"), F.count(F.when(F.col("valid_from") >= F.lit("2024-01-29").cast("timestamp"), 1)).alias("today"))


@query("a24_top_entities", f"{with_views('facts')} SELECT entity, count(*) AS n FROM facts_v WHERE expired_at IS NULL GROUP BY 1 ORDER BY n DESC, entity LIMIT 5")
def top_entities(spark, sf):
    return views.facts(spark, sf).filter("expired_at is null").groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(5)


@query("a25_dimension_stats", f"{with_views('facts')} SELECT metric AS dimension, count(DISTINCT entity) AS entities, count(*) AS observations FROM facts_v GROUP BY 1")
def dimension_stats(spark, sf):
    return views.facts(spark, sf).groupBy(F.col("metric").alias("dimension")).agg(F.countDistinct("entity").alias("entities"), F.count(F.lit(1)).alias("observations"))


@query("a26_conflicts", f"{with_views('facts')} SELECT entity, metric, count(DISTINCT floor(value)) AS n_values, count(DISTINCT id % 4) AS n_sources FROM facts_v WHERE expired_at IS NULL AND valid_from >= TIMESTAMP '2024-01-29' GROUP BY ALL HAVING count(DISTINCT floor(value)) >= 2 AND count(DISTINCT id % 4) >= 2")
def conflicts(spark, sf):
    f = views.facts(spark, sf).filter("expired_at is null and valid_from >= timestamp '2024-01-29'")
    return f.groupBy("entity", "metric").agg(F.countDistinct(F.floor("value")).alias("n_values"), F.countDistinct(F.col("id") % 4).alias("n_sources")).filter("n_values >= 2 and n_sources >= 2")


@query("a27_founder_scorecard", f"{with_views('facts')}, c AS (SELECT entity, metric, value, lag(value) OVER (PARTITION BY entity, metric ORDER BY valid_from, id) AS old FROM facts_v) SELECT entity, count(*) FILTER (WHERE abs(value - old) / old >= 0.05) AS changes, count(*) FILTER (WHERE abs(value - old) / old < 0.01) AS flat, count(*) FILTER (WHERE value < 0.5 * old) AS red_flags FROM c WHERE old > 0 GROUP BY entity")
def founder_scorecard(spark, sf):
    w = W.partitionBy("entity", "metric").orderBy("valid_from", "id")
    c = views.facts(spark, sf).withColumn("old", F.lag("value").over(w)).filter("old > 0")
    move = F.abs(F.col("value") - F.col("old")) / F.col("old")
    return c.groupBy("entity").agg(F.count(F.when(move >= 0.05, 1)).alias("changes"), F.count(F.when(move < 0.01, 1)).alias("flat"), F.count(F.when(F.col("value") < 0.5 * F.col("old"), 1)).alias("red_flags"))


_QR = "ra AS (SELECT user_id AS query, event_id % 40 AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY ts, event_id) = 1), rk AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY rank) AS rank FROM ra), qr AS (SELECT user_id AS query, event_id % 40 AS doc, max(1 + event_id % 3) AS grade FROM events WHERE event_type = 'purchase' GROUP BY ALL)"


@query("a28_retrieval_metrics", f"WITH {_QR}, h AS (SELECT qr.query, qr.doc, grade, rank, row_number() OVER (PARTITION BY qr.query ORDER BY grade DESC, qr.doc) AS pos FROM qr LEFT JOIN rk ON rk.query = qr.query AND rk.doc = qr.doc) SELECT query, round(count(*) FILTER (WHERE rank <= 5) / 5.0, 6)::DOUBLE AS p_at_k, round(count(*) FILTER (WHERE rank <= 5)::DOUBLE / count(*), 6) AS r_at_k, round(coalesce(1.0 / min(rank), 0), 6)::DOUBLE AS mrr, round(coalesce(sum(grade / log2(rank + 1)) FILTER (WHERE rank <= 5), 0) / sum(grade / log2(pos + 1)) FILTER (WHERE pos <= 5), 6) AS ndcg FROM h GROUP BY query")
def retrieval_metrics(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("query"), (F.col("event_id") % 40).alias("doc"), "ts", "event_id", "event_type")
    v = e.filter("event_type = 'view'")
    first = v.withColumn("n", F.row_number().over(W.partitionBy("query", "doc").orderBy("ts", "event_id"))).filter("n = 1")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("ts", "event_id"))).select("query", "doc", "rank")
    qrels = e.filter("event_type = 'purchase'").groupBy("query", "doc").agg(F.max(1 + F.col("event_id") % 3).alias("grade"))
    return _r(A.retrieval_metrics(ranked, qrels, 5), "p_at_k", "r_at_k", "mrr", "ndcg")


@query("a29_family_bench", "SELECT event_type AS family, count(*) AS n, round(avg((event_id % 5 = 0)::INT), 6) AS hit1, round(avg((event_id % 5 < 3)::INT), 6) AS hit3, round(avg(1.0 / (1 + event_id % 5)), 6) AS mrr FROM events GROUP BY 1")
def family_bench(spark, sf):
    r = F.col("event_id") % 5
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("family")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((r == 0).cast("int")), 6).alias("hit1"), F.round(F.avg((r < 3).cast("int")), 6).alias("hit3"), F.round(F.avg(1 / (1 + r)), 6).alias("mrr"))


@query("a30_gate", "SELECT round(avg((event_id % 9 > 0)::INT), 6) AS top1, round(avg((event_id % 9 > 1)::INT), 6) AS recall, avg((event_id % 9 > 0)::INT) >= 0.8 AND avg((event_id % 9 > 1)::INT) >= 0.85 AS passes FROM events")
def gate(spark, sf):
    r = F.col("event_id") % 9
    g = table(spark, sf, "events").agg(F.avg((r > 0).cast("int")).alias("a"), F.avg((r > 1).cast("int")).alias("b"))
    return g.select(F.round("a", 6).alias("top1"), F.round("b", 6).alias("recall"), ((F.col("a") >= 0.8) & (F.col("b") >= 0.85)).alias("passes"))


@query("a31_replay_stability", "WITH l AS (SELECT l_orderkey AS q, list(DISTINCT l_partkey) FILTER (WHERE l_linenumber <= 3) AS a, list(DISTINCT l_partkey) FILTER (WHERE l_linenumber >= 2) AS b FROM lineitem GROUP BY 1), m AS (SELECT q, coalesce(a, []) AS a, coalesce(b, []) AS b FROM l) SELECT q, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 1 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) END, 6) AS jaccard FROM m")
def replay_stability(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy(F.col("l_orderkey").alias("q")).agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_partkey"))).alias("a"), F.collect_set(F.when(F.col("l_linenumber") >= 2, F.col("l_partkey"))).alias("b"))
    return g.select("q", F.round(A.replay_stability(F.col("a"), F.col("b"))[0], 6).alias("jaccard"))


@query("a33_wilson", "WITH c AS (SELECT event_type AS k, count(*) FILTER (WHERE value > 30)::DOUBLE AS h, count(*)::DOUBLE AS n FROM events GROUP BY 1), z AS (SELECT *, 1.959963984540054 AS z, h / n AS p FROM c) SELECT k, round((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM z")
def wilson(spark, sf):
    c = table(spark, sf, "events").groupBy(F.col("event_type").alias("k")).agg(F.count(F.when(F.col("value") > 30, 1)).alias("h"), F.count(F.lit(1)).alias("n"))
    lo, hi = A.wilson(F.col("h"), F.col("n"))
    return c.select("k", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


@query("a34_hot_pages", "WITH p AS (SELECT c_nationkey AS page, o_orderkey % 3 AS sev FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT s_nationkey, l_orderkey % 3 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 1) SELECT page, count(*) AS appearances, max(sev) AS worst FROM p GROUP BY page ORDER BY worst DESC, appearances DESC, page LIMIT 10")
def hot_pages(spark, sf):
    a = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select(F.col("c_nationkey").alias("page"), (F.col("o_orderkey") % 3).alias("sev"))
    b = table(spark, sf, "lineitem").filter("l_linenumber = 1").join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").select("s_nationkey", F.col("l_orderkey") % 3)
    return a.union(b).groupBy("page").agg(F.count(F.lit(1)).alias("appearances"), F.max("sev").alias("worst")).orderBy(F.desc("worst"), F.desc("appearances"), "page").limit(10)


@query("a35_tier_breakdown", f"{with_views('pages')}, f AS (SELECT page_id, CASE WHEN slug LIKE 'en/%' THEN 1.2 WHEN slug LIKE 'de/%' THEN 0.8 ELSE 1.0 END AS x FROM pages_v) SELECT CASE WHEN x > 1.05 THEN 'curated' WHEN x < 0.95 THEN 'bulk' ELSE 'neutral' END AS tier, count(*) AS n FROM f GROUP BY 1")
def tier_breakdown(spark, sf):
    x = scope.prefix_case(F.col("slug"), {"en/": 1.2, "de/": 0.8})
    return views.pages(spark, sf).groupBy(F.when(x > 1.05, "curated").when(x < 0.95, "bulk").otherwise("neutral").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("a36_trend", "SELECT ts::DATE AS day, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY 1")
def trend(spark, sf):
    return table(spark, sf, "events").filter("ts >= timestamp '2024-01-11'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("a37_tracker_totals", "SELECT o_orderpriority, round(sum(replace(replace('$' || format('{:,.2f}', o_totalprice), '$', ''), ',', '')::DOUBLE), 2) AS total FROM orders GROUP BY 1")
def tracker_totals(spark, sf):
    money = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.sum(F.regexp_replace(money, r"[$,]", "").cast("double")), 2).alias("total"))


@query("a39_string_agg", "SELECT conv_id, string_agg(role, ' > ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def string_agg(spark, sf):
    x = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(x, lambda r: r["role"]), " > ").alias("roles"))


@query("a40_backlog", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY lang")
def backlog(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf, "documents").join(e, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("a41_preference", "SELECT event_type AS arm, count(*) FILTER (WHERE event_id % 3 = 0) AS wins, count(*) FILTER (WHERE event_id % 3 = 1) AS losses, round(count(*) FILTER (WHERE event_id % 3 = 0)::DOUBLE / nullif(count(*) FILTER (WHERE event_id % 3 < 2), 0), 6) AS win_rate FROM events GROUP BY 1")
def preference(spark, sf):
    r = F.col("event_id") % 3
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("arm")).agg(F.count(F.when(r == 0, 1)).alias("wins"), F.count(F.when(r == 1, 1)).alias("losses"), F.round(A.share(F.count(F.when(r == 0, 1)), F.count(F.when(r < 2, 1))), 6).alias("win_rate"))


@query("a42_next_row_numbers", "WITH m AS (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(m, 0) + row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey) AS row_num FROM orders LEFT JOIN m ON l_orderkey = o_orderkey")
def next_row_numbers(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("m"))
    w = W.partitionBy("o_orderkey").orderBy("o_custkey")
    return table(spark, sf, "orders").join(m, "o_orderkey", "left").select("o_orderkey", (F.coalesce("m", F.lit(0)) + F.row_number().over(w)).alias("row_num"))


@query("a43_stats_with_total", "SELECT coalesce(source, '*') AS source, count(*) AS total, count(*) FILTER (WHERE lang = 'en') AS typed, round(count(*) FILTER (WHERE lang = 'en')::DOUBLE / count(*), 4) AS coverage FROM documents GROUP BY ROLLUP (source)")
def stats_with_total(spark, sf):
    r = table(spark, sf, "documents").rollup("source").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("lang") == "en", 1)).alias("typed"), F.grouping_id().alias("g"))
    return r.select(F.when(F.col("g") == 1, "*").otherwise(F.col("source")).alias("source"), "total", "typed", F.round(F.col("typed") / F.col("total"), 4).alias("coverage"))


@query("a44_concept_tiers", "WITH c AS (SELECT unnest(string_split(p_name, ' ') || [p_brand]) AS concept FROM part), n AS (SELECT concept, count(*) AS n FROM c GROUP BY 1) SELECT concept, n, CASE WHEN n >= 10 THEN 'T1' WHEN n >= 5 THEN 'T2' ELSE 'T3' END AS tier FROM n WHERE n >= 2")
def concept_tiers(spark, sf):
    c = table(spark, sf, "part").select(F.explode(F.concat(F.split("p_name", " "), F.array("p_brand"))).alias("concept"))
    return c.groupBy("concept").agg(F.count(F.lit(1)).alias("n")).withColumn("tier", A.tier(F.col("n"), {"T1": 10, "T2": 5, "T3": 2})).filter("tier is not null")


@query("a45_consensus", "SELECT o_orderpriority AS dimension, count(DISTINCT o_custkey) AS raters, round(avg(o_orderkey % 10), 1) AS mean, min(o_orderkey % 10) AS low, max(o_orderkey % 10) AS high, round(avg(o_orderkey % 10), 1) >= 7 AND min(o_orderkey % 10) >= 5 AS passes FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 3")
def consensus(spark, sf):
    return A.consensus(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dimension"), F.col("o_custkey").alias("rater"), (F.col("o_orderkey") % 10).alias("score")), 3)


@query("a46_regression", "WITH r AS (SELECT event_type AS d, ts < TIMESTAMP '2024-01-16' AS old, avg(value) AS v FROM events GROUP BY ALL) SELECT a.d AS dimension, round(b.v - a.v, 6) AS delta, b.v - a.v < -0.5 AS regressed FROM r a JOIN r b ON a.d = b.d AND a.old AND NOT b.old")
def regression(spark, sf):
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    r = table(spark, sf, "events").groupBy(F.col("event_type").alias("dimension")).agg((F.avg(F.when(~early, F.col("value"))) - F.avg(F.when(early, F.col("value")))).alias("delta"))
    return r.select("dimension", F.round("delta", 6).alias("delta"), (F.col("delta") < -0.5).alias("regressed"))


@query("a47_run_trend", "SELECT event_id AS run, ts, value FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 200")
def run_trend(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'signup'").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select(F.col("event_id").alias("run"), "ts", "value")


@query("a48_median", "SELECT user_id, round(coalesce(median(value), 0), 6) AS median FROM events GROUP BY 1")
def median(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.coalesce(F.percentile("value", 0.5), F.lit(0.0)), 6).alias("median"))


@query("a49_weighted_score", "SELECT s_suppkey, round(0.5 * (s_suppkey % 10) / 9 + 0.3 * (s_nationkey / 24.0) + 0.2 * (s_acctbal > 0)::INT, 6)::DOUBLE AS score FROM supplier WHERE 0.5 * (s_suppkey % 10) / 9 + 0.3 * (s_nationkey / 24.0) + 0.2 * (s_acctbal > 0)::INT >= 0.4 AND s_acctbal > -500")
def weighted_score(spark, sf):
    s = 0.5 * (F.col("s_suppkey") % 10) / 9 + 0.3 * F.col("s_nationkey") / 24 + 0.2 * (F.col("s_acctbal") > 0).cast("int")
    return table(spark, sf, "supplier").withColumn("score", s).filter("score >= 0.4 and s_acctbal > -500").select("s_suppkey", F.round("score", 6).alias("score"))


@query("a50_enrichment_tier", "SELECT user_id, CASE WHEN count(*) >= 75 OR list_contains(list(DISTINCT event_type), 'signup') AND count(*) >= 65 THEN 1 WHEN count(*) >= 60 THEN 2 ELSE 3 END AS tier FROM events GROUP BY 1")
def enrichment_tier(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("event_type").alias("s"))
    return g.select("user_id", F.when((F.col("n") >= 75) | (F.array_contains("s", "signup") & (F.col("n") >= 65)), 1).when(F.col("n") >= 60, 2).otherwise(3).alias("tier"))


@query("a51_paired_bootstrap")
def paired_bootstrap(spark, sf):
    return A.paired_bootstrap(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_acctbal") / 1000).alias("a"), (F.col("s_suppkey") % 9).alias("b")))


# --- windows, sequences, time series ---------------------------------------------------------------------------------


@query("w2_stratified_sample", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 1 ELSE 2 END, p_retailprice DESC, p_partkey) <= 4")
def stratified_sample(spark, sf):
    stale = F.when(F.col("p_size") % 3 == 0, 0).when(F.col("p_size") % 3 == 1, 1).otherwise(2)
    w = W.partitionBy("p_brand").orderBy(stale, F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf, "part").withColumn("n", F.row_number().over(w)).filter("n <= 4").select("p_brand", "p_partkey")


@query("w3_trajectory", f"{with_views('facts')} SELECT id, valid_from, value FROM facts_v WHERE entity = 7 AND metric = 'view' AND expired_at IS NULL ORDER BY valid_from, id LIMIT 100")
def trajectory(spark, sf):
    return views.facts(spark, sf).filter("entity = 7 and metric = 'view' and expired_at is null").orderBy("valid_from", "id").limit(100).select("id", "valid_from", "value")


@query("w4_regressions", f"{with_views('facts')} SELECT entity, metric, id, round((old - value) / old, 6) AS drop_share FROM (SELECT *, lag(value) OVER (PARTITION BY entity, metric ORDER BY valid_from, id) AS old FROM facts_v) WHERE old > 0 AND (old - value) / old >= 0.9")
def regressions(spark, sf):
    w = W.partitionBy("entity", "metric").orderBy("valid_from", "id")
    f = views.facts(spark, sf).withColumn("old", F.lag("value").over(w)).filter("old > 0").withColumn("drop_share", (F.col("old") - F.col("value")) / F.col("old"))
    return f.filter("drop_share >= 0.9").select("entity", "metric", "id", F.round("drop_share", 6).alias("drop_share"))


@query("w5_embedding_drift", "WITH c AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) SELECT label, round(least(1.0, greatest(0.0, 1 - avg(list_cosine_similarity(e, p)))), 6) AS drift FROM c GROUP BY label HAVING count(*) >= 3")
def embedding_drift(spark, sf):
    e = views.chunks(spark, sf).withColumn("p", F.lag("embedding").over(W.partitionBy("page_id").orderBy("chunk_id")))
    g = e.groupBy(F.col("page_id").alias("label")).agg(F.avg(F.when(F.col("p").isNotNull(), V.cosine(F.col("embedding"), F.col("p")))).alias("m"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return g.select("label", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("m"))), 6).alias("drift"))


@query("w6_valid_until", f"{with_views('facts')} SELECT id, lead(valid_from) OVER (PARTITION BY entity, metric ORDER BY valid_from, id) AS valid_until FROM facts_v")
def valid_until(spark, sf):
    return views.facts(spark, sf).select("id", F.lead("valid_from").over(W.partitionBy("entity", "metric").orderBy("valid_from", "id")).alias("valid_until"))


_NEAR = "SELECT x.vec_id, list(y.vec_id) AS near FROM embeddings x JOIN embeddings y ON y.label = x.label AND y.vec_id > x.vec_id AND list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.3 GROUP BY x.vec_id"


@query(
    "w7_leader_clusters",
    f"""WITH RECURSIVE a AS ({_NEAR}),
s AS (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id DESC) AS k, coalesce(near, []) AS near FROM embeddings e LEFT JOIN a ON a.vec_id = e.vec_id),
g AS (SELECT label, k, vec_id, [vec_id] AS heads FROM s WHERE k = 1
      UNION ALL SELECT s.label, s.k, s.vec_id, CASE WHEN len(list_intersect(s.near, g.heads)) = 0 THEN list_append(g.heads, s.vec_id) ELSE g.heads END FROM g JOIN s ON s.label = g.label AND s.k = g.k + 1)
SELECT g.label AS page_id, g.vec_id AS chunk_id, coalesce(list_max(list_intersect(s.near, g.heads)), g.vec_id) AS head FROM g JOIN s ON s.label = g.label AND s.k = g.k""",
)
def leader_clusters(spark, sf):
    """Facts join the first cluster, newest facts first, whose head has a cosine of 0.3 or more with them."""
    rows = views.chunks(spark, sf).select(F.col("page_id").alias("bucket"), F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))
    return clusters.leader_clusters(rows, 0.3).select(F.col("bucket").alias("page_id"), F.col("id").alias("chunk_id"), "head")


@query("w8_cluster_takes", f"{with_views('facts')} SELECT entity, arg_max(id, confidence * 100000 - id / 100000.0) AS best, round(avg(value), 4) AS weight, min(valid_from) AS since, count(DISTINCT metric) AS sources FROM facts_v GROUP BY entity")
def cluster_takes(spark, sf):
    return views.facts(spark, sf).groupBy("entity").agg(F.max_by("id", F.col("confidence") * 100000 - F.col("id") / 100000).alias("best"), F.round(F.avg("value"), 4).alias("weight"), F.min("valid_from").alias("since"), F.countDistinct("metric").alias("sources"))


@query("w9_confidence_decay", f"{with_views('facts')} SELECT id, round(CASE WHEN expired_at IS NOT NULL AND expired_at <= TIMESTAMP '2024-02-15' THEN 0 ELSE confidence * exp(-date_diff('day', valid_from::DATE, DATE '2024-02-15')::DOUBLE / CASE metric WHEN 'view' THEN 7 WHEN 'click' THEN 90 ELSE 365 END) END, 6)::DOUBLE AS confidence FROM facts_v")
def confidence_decay(spark, sf):
    h = F.when(F.col("metric") == "view", 7).when(F.col("metric") == "click", 90).otherwise(365)
    now = F.lit("2024-02-15").cast("timestamp")
    age = F.datediff(now.cast("date"), F.to_date("valid_from"))
    return views.facts(spark, sf).select("id", F.round(F.when(F.col("expired_at") <= now, 0.0).otherwise(F.col("confidence") * F.exp(-age / h)), 6).alias("confidence"))


@query("w10_supersessions", f"{with_views('facts')} SELECT id, entity, metric, expired_at FROM facts_v WHERE expired_at IS NOT NULL AND valid_from >= TIMESTAMP '2024-01-20'")
def supersessions(spark, sf):
    return views.facts(spark, sf).filter("expired_at is not null and valid_from >= timestamp '2024-01-20'").select("id", "entity", "metric", "expired_at")


#: Observations told by events: names of dimensions with aliases and an unknown one, values told again, some valid from before they arrive.
_OBSERVED = """SELECT event_id AS id, user_id % 40 AS entity, list_extract(['role', 'role', 'employer', 'relation', 'vibe'], (event_id % 5 + 1)::INT) AS dimension, 'v' || floor(value / 40)::INT AS value, 'm' || event_id % 3 AS source, epoch_us(ts::TIMESTAMP) - CASE WHEN event_id % 4 = 0 THEN 864000000000 ELSE 0 END AS since, epoch_us(ts::TIMESTAMP) AS arrived FROM events"""
_FOLD = f"""WITH RECURSIVE o AS ({_OBSERVED}), e AS (SELECT *, row_number() OVER (PARTITION BY entity, dimension ORDER BY arrived, id) AS n FROM o),
s AS (SELECT DISTINCT entity, dimension, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS action, []::BIGINT[] AS closed, []::STRUCT(v VARCHAR, i BIGINT, f BIGINT, src VARCHAR[])[] AS live FROM o
      UNION ALL SELECT e.entity, e.dimension, e.n, e.id,
        CASE WHEN len(list_filter(live, lambda x: x.v = e.value AND list_contains(x.src, e.source))) > 0 THEN 'noop' WHEN len(list_filter(live, lambda x: x.v = e.value)) > 0 THEN 'corroborated' WHEN len(list_filter(live, lambda x: x.f < e.since)) > 0 THEN 'superseded_prior' ELSE 'inserted' END,
        CASE WHEN len(list_filter(live, lambda x: x.v = e.value)) > 0 THEN [] ELSE list_sort(list_transform(list_filter(live, lambda x: x.f < e.since), lambda x: x.i)) END,
        CASE WHEN len(list_filter(live, lambda x: x.v = e.value)) > 0 THEN list_transform(live, lambda x: CASE WHEN x.v = e.value THEN struct_pack(v := x.v, i := x.i, f := x.f, src := list_append(x.src, e.source)) ELSE x END)
             ELSE list_append(list_filter(live, lambda x: x.f >= e.since), struct_pack(v := e.value, i := e.id, f := e.since, src := [e.source])) END
      FROM s JOIN e ON e.entity = s.entity AND e.dimension = s.dimension AND e.n = s.n + 1)
SELECT id, action, array_to_string(closed, ',') AS closed, CASE WHEN dimension = 'vibe' THEN 'quarantined' ELSE 'active' END AS status FROM s WHERE n > 0"""


@query("w11_ontology_merge", _FOLD)
def ontology_merge(spark, sf):
    """What each observation does to the history of its entity's dimension, in order of arrival."""
    names = F.array(*map(F.lit, ("role", "Job Role", "employer", "rel", "vibe")))
    e = table(spark, sf, "events")
    at = F.col("ts").cast("timestamp")
    told = e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("entity"), F.get(names, (F.col("event_id") % 5).cast("int")).alias("dimension"), F.concat(F.lit("v"), F.floor(F.col("value") / 40).cast("string")).alias("value"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("source"), F.when(F.col("event_id") % 4 == 0, at - F.expr("interval 10 days")).alias("valid_from"), at.alias("arrived"),
    )
    out = ontology.merged(told, ["entity"])
    return out.select("id", "action", F.array_join(F.transform("closed", lambda x: x.cast("string")), ",").alias("closed"), "status")


@query("w12_timeline_reads", "SELECT event_id, date_trunc('week', ts)::DATE AS week, month(ts) = 1 AND day(ts) = 15 AS on_this_day FROM events WHERE date_trunc('week', ts) = TIMESTAMP '2024-01-15'")
def timeline_reads(spark, sf):
    e = table(spark, sf, "events").filter(F.date_trunc("WEEK", "ts") == F.lit("2024-01-15").cast("timestamp"))
    return e.select("event_id", F.date_trunc("WEEK", "ts").cast("date").alias("week"), ((F.month("ts") == 1) & (F.dayofmonth("ts") == 15)).alias("on_this_day"))


@query("w13_last_seen", "SELECT user_id, max(ts::DATE) AS last_seen, greatest(0, date_diff('day', max(ts::DATE), DATE '2024-01-29')) AS days_ago FROM events WHERE ts::DATE <= DATE '2024-01-29' GROUP BY 1")
def last_seen(spark, sf):
    e = table(spark, sf, "events").withColumn("d", F.to_date("ts")).filter("d <= date '2024-01-29'").groupBy("user_id").agg(F.max("d").alias("last_seen"))
    return e.withColumn("days_ago", F.greatest(F.lit(0), F.datediff(F.lit("2024-01-29").cast("date"), "last_seen")))


@query("w14_calendar_windows", "SELECT q::DATE AS quarter, count(o_orderkey) AS n FROM generate_series(DATE '1995-01-01', DATE '2001-07-01', INTERVAL 3 MONTH) AS g(q) LEFT JOIN orders ON date_trunc('quarter', o_orderdate) = q GROUP BY 1")
def calendar_windows(spark, sf):
    quarters = spark.sql("SELECT explode(sequence(date '1995-01-01', date '2001-07-01', interval 3 month)) AS quarter")
    n = table(spark, sf, "orders").groupBy(F.date_trunc("QUARTER", "o_orderdate").cast("date").alias("quarter")).agg(F.count(F.lit(1)).alias("c"))
    return quarters.join(n, "quarter", "left").select("quarter", F.coalesce("c", F.lit(0)).alias("n"))


@query("w16_far_distance", "WITH r AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (1, 2, 3)) SELECT vec_id, round(min((1 - list_cosine_similarity(embedding::DOUBLE[], r.e)) / 2), 6) AS distance FROM embeddings, r WHERE vec_id NOT IN (1, 2, 3) GROUP BY vec_id")
def far_distance(spark, sf):
    """Distance to the nearest of a few reference vectors, which enter the plan as literals."""
    c = views.chunks(spark, sf)
    refs = [r["embedding"] for r in c.filter("chunk_id in (1, 2, 3)").select("embedding").collect()]
    return c.filter("chunk_id not in (1, 2, 3)").select(F.col("chunk_id").alias("vec_id"), F.round(F.least(*[(1 - V.cosine(F.col("embedding"), V.literal(v))) / 2 for v in refs]), 6).alias("distance"))


@query("w17_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, sf):
    return table(spark, sf, "documents").orderBy(F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))), "doc_id").limit(50).select("doc_id")


@query("w18_trajectory_rows", f"{with_views('facts')} SELECT entity, metric, id, value IS DISTINCT FROM old AND old IS NOT NULL AS changed FROM (SELECT *, lag(value) OVER (PARTITION BY entity, metric ORDER BY valid_from, id) AS old, row_number() OVER (PARTITION BY entity, metric ORDER BY valid_from DESC, id DESC) AS n FROM facts_v) WHERE n <= 20")
def trajectory_rows(spark, sf):
    g = ("entity", "metric")
    f = views.facts(spark, sf).withColumn("old", F.lag("value").over(W.partitionBy(*g).orderBy("valid_from", "id"))).withColumn("n", F.row_number().over(W.partitionBy(*g).orderBy(F.desc("valid_from"), F.desc("id"))))
    return f.filter("n <= 20").select(*g, "id", (~F.col("value").eqNullSafe(F.col("old")) & F.col("old").isNotNull()).alias("changed"))


@query("w19_far_set", "WITH r AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (1, 2, 3)), s AS (SELECT label, vec_id, embedding FROM embeddings WHERE vec_id NOT IN (1, 2, 3) QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5) SELECT vec_id FROM s, r GROUP BY vec_id ORDER BY round(min((1 - list_cosine_similarity(embedding::DOUBLE[], r.e)) / 2), 9) DESC, vec_id LIMIT 12")
def far_set(spark, sf):
    c = views.chunks(spark, sf)
    refs = [r["embedding"] for r in c.filter("chunk_id in (1, 2, 3)").select("embedding").collect()]
    s = c.filter("chunk_id not in (1, 2, 3)").withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy("chunk_id"))).filter("n <= 5")
    d = F.round(F.least(*[(1 - V.cosine(F.col("embedding"), V.literal(v))) / 2 for v in refs]), 9)
    return s.withColumn("d", d).orderBy(F.desc("d"), "chunk_id").limit(12).select(F.col("chunk_id").alias("vec_id"))


# --- scalar functions ------------------------------------------------------------------------------------------------

_TOK = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query("f2_tokens", f"SELECT doc_id, len({_TOK}) AS n, array_to_string(list_slice({_TOK}, 1, 5), ' ') AS head FROM documents")
def token_heads(spark, sf):
    t = T.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


@query("f5_edit_distance", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def edit_distance(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey", F.col("n_nationkey").alias("i")), n.select(F.col("n_name").alias("b"), "n_regionkey", F.col("n_nationkey").alias("j"))
    return a.join(b, "n_regionkey").filter("i < j").select("a", "b", F.levenshtein("a", "b").alias("d"))


@query("f6_content_hash", "SELECT doc_id, sha256('[\"' || doc_id || '\",\"' || lang || '\",\"' || source || '\"]') AS h FROM documents")
def content_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("doc_id"), F.col("lang"), F.col("source")).alias("h"))


@query("f7_token_estimate", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("f9_without_code", "SELECT doc_id, length(regexp_replace(regexp_replace(replace(text, ' the ', ' `x` ') || '```a b```', '(?s)```.*?```', ' ', 'g'), '`[^`\\n]*`', ' ', 'g')) AS n FROM documents")
def without_code(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(T.without_code(F.concat(F.replace("text", F.lit(" the "), F.lit(" `x` ")), F.lit("```a b```")))).alias("n"))


_MD = "regexp_replace(html, '<a href=\"([^\"]*)\">([^<]*)</a>', '[\\2](\\1) [[wiki:\\2|x]]', 'g')"


@query("f10_entity_refs", f"WITH m AS (SELECT page_id, {_MD} AS t FROM pages), x AS (SELECT page_id, unnest(regexp_extract_all(t, '\\[([^\\]\\n]+)\\]\\(([^)\\s]+)\\)', 0)) AS r FROM m) SELECT page_id, regexp_extract(r, '^\\[([^\\]]+)\\]', 1) AS text, regexp_extract(r, '\\(([^)]+)\\)$', 1) AS target FROM x")
def entity_refs(spark, sf):
    md = F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', "[$2]($1) [[wiki:$2|x]]")
    return table(spark, sf, "pages").select("page_id", F.explode(T.markdown_links(md)).alias("r")).select("page_id", "r.text", "r.target")


@query("f10_wiki_refs", f"WITH m AS (SELECT page_id, {_MD} AS t FROM pages), x AS (SELECT page_id, unnest(regexp_extract_all(t, '\\[\\[([^\\]|\\n]+)(?:\\|[^\\]\\n]*)?\\]\\]', 1)) AS r FROM m) SELECT page_id, nullif(regexp_extract(r, '^([a-z0-9-]+):', 1), '') AS source, regexp_replace(r, '^[a-z0-9-]+:', '') AS slug FROM x")
def wiki_refs(spark, sf):
    md = F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', "[$2]($1) [[wiki:$2|x]]")
    return table(spark, sf, "pages").select("page_id", F.explode(T.wiki_links(md)).alias("r")).select("page_id", "r.source", "r.slug")


#: (page type, words around the link, page text, folder of the target, the type that a reader would give it).
_LINKS = [
    ("person", "She founded {n} in 2010", "", "companies", "founded"),
    ("person", "He is a co-founder there: {n}", "", "companies", "founded"),
    ("company", "{n} was founded by Ann, who also invested in it", "", "people", "founded"),
    ("person", "an angel who invested in {n} twice", "", "companies", "invested_in"),
    ("person", "her firm led the Series A of {n}", "", "companies", "invested_in"),
    ("person", "he wrote a check for {n}", "", "companies", "invested_in"),
    ("person", "sits on the board of {n}", "", "companies", "mentions"),
    ("person", "sits on the board of {n}", "Bo is a partner at Fir.", "companies", "invested_in"),
    ("person", "sits on the board of {n}", "Bo is a partner at Fir.", "people", "mentions"),
    ("concept", "sits on the board of {n}", "On venture capital.", "companies", "mentions"),
    ("media", "She founded {n} in 2010", "", "companies", "mentions"),
    ("meeting", "She founded {n} in 2010", "", "companies", "attended"),
    ("image", "the office of {n}", "", "companies", "image_of"),
    ("person", "a technical advisor to {n}", "", "companies", "advises"),
    ("person", "has joined the advisory board, {n} says", "", "companies", "advises"),
    ("person", "her notes on {n}", "Di serves as an advisor.", "companies", "advises"),
    ("person", "now CTO of {n}", "", "companies", "works_at"),
    ("person", "a Senior Engineer at {n}", "", "companies", "works_at"),
    ("person", "spent four years at {n}", "", "companies", "works_at"),
    ("person", "her work on the pipeline of {n}", "Cy is a staff engineer at Elm.", "companies", "works_at"),
    ("person", "saw {n} at dinner", "Cy likes tea.", "companies", "mentions"),
    ("person", "they built a small company, {n}, from nothing", "", "companies", "founded"),
    ("company", "{n} is one of its first backers and holds a stake in it", "", "people", "invested_in"),
    ("person", "took part in the last seed round of {n}", "", "companies", "invested_in"),
    ("person", "was financed by {n}", "", "companies", "invested_in"),
    ("person", "consults on storage for {n}", "", "companies", "advises"),
    ("person", "acts as its unpaid adviser: {n}", "", "companies", "advises"),
    ("person", "previously a cook at {n}", "", "companies", "works_at"),
    ("person", "runs the whole research group of {n}", "", "companies", "works_at"),
    ("person", "during her days at {n}", "", "companies", "works_at"),
    ("person", "went past {n} by train", "Ed became the first director of Oak.", "companies", "works_at"),
    ("person", "went past {n} by train", "Flo was for years a trusted adviser.", "companies", "advises"),
    ("person", "went past {n} by train", "Gus backs young firms.", "people", "mentions"),
    ("person", "found a bug in {n}", "", "companies", "mentions"),
    ("company", "the workshop next to {n}", "", "companies", "mentions"),
]


@query("f11_link_types", f"WITH s AS (SELECT * FROM (VALUES {', '.join(f'({i}, ' + repr(x[4]) + ')' for i, x in enumerate(_LINKS))}) AS t(i, kind)) SELECT p_partkey, kind FROM part JOIN s ON p_partkey % {len(_LINKS)} = i")
def link_types(spark, sf):
    """Sentences about parts, whose types a reader has given in the twin."""
    rows = spark.createDataFrame([(i, *x[:4]) for i, x in enumerate(_LINKS)], "i int, page_type string, around string, page_text string, folder string")
    p = table(spark, sf, "part").withColumn("i", (F.col("p_partkey") % len(_LINKS)).cast("int")).join(F.broadcast(rows), "i")
    context = F.replace(F.col("around"), F.lit("{n}"), F.col("p_name"))
    return p.select("p_partkey", T.link_type(context, F.col("page_type"), F.col("page_text"), F.concat("folder", F.lit("/x"))).alias("kind"))


@query("f13_code_refs", "SELECT page_id, unnest(regexp_extract_all('see src/a.py:12 and ' || url || '.html', '\\b((?:[\\w.-]+/)+[\\w.-]+\\.[a-z]{1,4}(?::\\d+)?)', 1)) AS ref FROM pages")
def code_refs(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(T.code_references(F.concat(F.lit("see src/a.py:12 and "), "url", F.lit(".html")))).alias("ref"))


@query("f15_basenames", "SELECT list_last(string_split(url, '/')) AS base, count(*) AS n FROM pages GROUP BY 1")
def basenames(spark, sf):
    return table(spark, sf, "pages").groupBy(T.basename(F.col("url")).alias("base")).agg(F.count(F.lit(1)).alias("n"))


@query("f16_dates", "SELECT event_id, unnest(list_filter(list_transform(regexp_extract_all('due ' || strftime(ts, '%Y-%m-%d') || ' or 2024-13-45', '\\b(\\d{4}-\\d{2}-\\d{2})\\b', 1), lambda x: try_cast(x AS DATE)), lambda d: d IS NOT NULL)) AS day FROM events")
def dates(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(T.dates_in(F.concat(F.lit("due "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" or 2024-13-45")))).alias("day"))


@query("f17_local_day", "SELECT event_id, (ts - INTERVAL 8 HOUR)::DATE AS day FROM events")
def local_day(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "-08:00")).alias("day"))


@query("f18_file_dates", "SELECT event_id, nullif(regexp_extract(CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') || '-note.md' ELSE 'note.md' END, '^(\\d{4}-\\d{2}-\\d{2})', 1), '') AS day FROM events")
def file_dates(spark, sf):
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-note.md"))).otherwise("note.md")
    return table(spark, sf, "events").select("event_id", F.nullif(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("day"))


@query("f19_metric_fields", "SELECT o_orderkey, nullif(regexp_extract('total: $' || o_totalprice || ' due', 'total: \\$([0-9.]+)', 1), '')::DOUBLE AS total FROM orders")
def metric_fields(spark, sf):
    text = F.concat(F.lit("total: $"), F.format_string("%.2f", "o_totalprice"), F.lit(" due"))
    return table(spark, sf, "orders").select("o_orderkey", F.nullif(F.regexp_extract(text, r"total: \$([0-9.]+)", 1), F.lit("")).cast("double").alias("total"))


@query("f20_html_text")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("f21_scrub")
def scrubbed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.scrub(F.col("text")).alias("text"))


@query("f22_pseudonyms", "WITH f AS (SELECT user_id, min(event_id) AS o FROM events GROUP BY 1) SELECT user_id, 'person-' || (1 + (row_number() OVER (ORDER BY o) - 1) % 40) AS pseudonym FROM f")
def pseudonyms(spark, sf):
    """Numbered in order of first appearance, a pool of 40 names in turn."""
    f = table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("o"))
    return ordered.row_number(f, "o").select("user_id", F.concat(F.lit("person-"), (1 + (F.col("n") - 1) % 40).cast("string")).alias("pseudonym"))


@query("f23_weight_grid", "SELECT l_orderkey, l_linenumber, round(floor(least(1.0, greatest(0.0, l_discount * 13)) * 20 + 0.5) / 20, 2)::DOUBLE AS w FROM lineitem")
def weight_grid(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.grid_weight(F.col("l_discount") * 13), 2).alias("w"))


@query("f24_intents", "SELECT event_id, CASE WHEN regexp_matches(lower(q), '\\b(when|last (week|month|year)|yesterday|recent(ly)?|latest|since)\\b') THEN 'temporal' WHEN regexp_matches(lower(q), '\\b(meeting|call|event|conference|dinner)\\b') THEN 'event' WHEN regexp_matches(lower(q), '\\b(who is|who''s|tell me about|profile of)\\b') THEN 'entity' ELSE 'general' END AS intent FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'When did it ' WHEN 1 THEN 'the Dinner with ' WHEN 2 THEN 'Who is ' WHEN 3 THEN 'events of ' ELSE 'x ' END || event_type AS q FROM events)")
def intents(spark, sf):
    r = F.col("event_id") % 5
    q = F.concat(F.when(r == 0, "When did it ").when(r == 1, "the Dinner with ").when(r == 2, "Who is ").when(r == 3, "events of ").otherwise("x "), "event_type")
    return table(spark, sf, "events").select("event_id", T.intent(q).alias("intent"))


#: (question, what a reader takes it for: intent, detail, salience, recency, modality); {n} is an event's type.
_QUESTIONS = [
    ("who is {n}", "entity|low|off|off|text"),
    ("who is {n} today", "entity|low|off|strong|text"),
    ("tell me about the {n}", "entity|low|off|off|text"),
    ("when did the {n} happen", "temporal|high|off|off|text"),
    ("what's new with {n} this week", "general|medium|off|on|text"),
    ("catch me up on {n}", "general|medium|on|on|text"),
    ("prepare for the call on {n}", "event|high|on|on|text"),
    ("latest {n}", "temporal|high|off|on|text"),
    ("explain how {n} works", "general|medium|off|off|text"),
    ("show me the pictures from {n}", "general|medium|off|off|image"),
    ("notes and photos of {n}", "general|medium|off|off|both"),
    ("what does {n} look like right now", "general|medium|off|strong|image"),
    ("what matters in {n}", "general|medium|on|off|text"),
    ("history of {n}", "general|medium|off|off|text"),
    ("{n} errors in the last 3 days", "general|medium|off|on|text"),
]


@query("f24_query_axes", f"SELECT event_id, replace(axes, '{{n}}', event_type) AS axes FROM events JOIN (VALUES {', '.join(f'({i}, ' + repr(x[1]) + ')' for i, x in enumerate(_QUESTIONS))}) AS t(i, axes) ON event_id % {len(_QUESTIONS)} = i")
def query_axes(spark, sf):
    """Questions about events, whose axes a reader has given in the twin."""
    rows = F.broadcast(spark.createDataFrame([(i, q) for i, (q, _) in enumerate(_QUESTIONS)], "i int, q string"))
    e = table(spark, sf, "events").withColumn("i", (F.col("event_id") % len(_QUESTIONS)).cast("int")).join(rows, "i")
    a = T.query_axes(F.replace(F.col("q"), F.lit("{n}"), F.col("event_type")))
    return e.select("event_id", F.concat_ws("|", *(a[c] for c in ("intent", "detail", "salience", "recency", "modality"))).alias("axes"))


@query("f25_json_access", "SELECT event_id, (props::JSON->>'k')::INT AS k, json_type(props, '$.k') IS NOT NULL AS has_k, json_array_length('[' || (props::JSON->>'k') || ',2]') AS n FROM events")
def json_access(spark, sf):
    v = F.parse_json("props")
    k = F.variant_get(v, "$.k", "int")
    return table(spark, sf, "events").select("event_id", k.alias("k"), F.array_contains(F.json_object_keys("props"), "k").alias("has_k"), F.json_array_length(F.concat(F.lit("["), k.cast("string"), F.lit(",2]"))).alias("n"))


@query("f26_math", "SELECT event_id, round(ln(1 + value), 6) AS l, round(exp(-value / 100), 6) AS e, round(sqrt(value), 6) AS s, round(log2(1 + value), 6) AS l2, least(greatest(value, 10), 50) AS c FROM events")
def math_functions(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(F.log(1 + v), 6).alias("l"), F.round(F.exp(-v / 100), 6).alias("e"), F.round(F.sqrt(v), 6).alias("s"), F.round(F.log2(1 + v), 6).alias("l2"), F.least(F.greatest(v, F.lit(10)), F.lit(50)).alias("c"))


@query("f27_arrays", "SELECT l_orderkey, len(list_distinct(list(l_suppkey))) AS n, list_contains(list(l_suppkey), 3) AS has3, array_to_string(list_sort(list_distinct(list(l_returnflag))), '') AS flags FROM lineitem GROUP BY 1")
def arrays(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"), F.collect_set("l_returnflag").alias("f"))
    return g.select("l_orderkey", F.size("s").alias("n"), F.array_contains("s", 3).alias("has3"), F.array_join(F.sort_array("f"), "").alias("flags"))


@query("f29_contextual_prefix", f"{with_views('pages')} SELECT page_id, length(CASE WHEN title = '' THEN '' ELSE title || ' > ' END || type || chr(10) || compiled_truth) AS n FROM pages_v")
def contextual_prefix(spark, sf):
    return views.pages(spark, sf).select("page_id", F.length(T.contextual(F.col("title"), F.col("type"), F.col("compiled_truth"))).alias("n"))


@query("f30_qualified_names", "SELECT p_partkey, array_to_string(list_filter([p_brand, p_type, replace(p_name, ' ', '_')], lambda x: x <> ''), '.') AS symbol FROM part")
def qualified_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(".", "p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit("_"))).alias("symbol"))


@query("f1_aliases")
def aliases(spark, sf):
    """Whole titles and whole texts as aliases and slugs."""
    bounded_batches(spark)
    p = views.pages(spark, sf)
    return p.select("page_id", *[f(F.col(c)).alias(f"{c}_{n}") for c in ("title", "compiled_truth") for n, f in (("alias", T.normalize_alias), ("slug", T.slugify))])


@query("f4_cjk", "SELECT doc_id, 0 AS cjk, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents")
def cjk(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.cjk_count(F.col("text")).alias("cjk"), T.countable_size(F.col("text")).alias("n"))


@query("f28_handles", r"SELECT doc_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '(?:^|\s)(@[A-Za-z0-9_]{2,})', 1), regexp_extract_all(text, '\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)', 1)))) AS candidate FROM documents")
def handles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.handles(F.col("text"))).alias("candidate"))


@query("f31_maps", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_keys, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, max(c * 10) AS most FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS c FROM lineitem) GROUP BY l_orderkey")
def maps(spark, sf):
    """A map built by aggregation, then read: keys, values, an entry, and each value changed."""
    each = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("c"))
    m = each.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "c"))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)
    tens = F.array_max(F.map_values(F.transform_values("m", lambda k, v: v * 10)))
    return m.select("l_orderkey", F.size(F.map_keys("m")).cast("long").alias("n_keys"), total.alias("n"), F.coalesce(F.try_element_at("m", F.lit("R")), F.lit(0)).alias("returned"), F.array_join(F.sort_array(F.map_keys("m")), ",").alias("flags"), tens.alias("most"))
