"""Queries over retrieval, fusion, score modifiers, de-duplication and cut-offs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomline.operators import ordered, payload
from fathomline.operators import ranking as M
from fathomline.operators import retrieval as R
from fathomline.operators import text_index as TI
from fathomline.operators import vector_index as VI
from fathomline.plans.catalog import query
from fathomline.session import cut_lineage, ensure_checkpoint_dir, remove_folder, table
from fathomline.sources import views
from fathomline.sources.views import with_views

_TOK = "list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_BODY, _TITLE = _TOK.format(c="compiled_truth"), _TOK.format(c="title")
_QUERY = 'the and "of the" -stupid inghe or thing'


def _tf(side: str, word: str) -> str:
    return f"len(list_filter({side}, lambda x: x = '{word}'))"


def _fts(words=("the", "and", "of", "inghe", "thing")) -> str:
    sums = " + ".join(f"{w} * {_tf(s, x)}::DOUBLE / ({_tf(s, x)} + 1)" for s, w in (("ti", "1.0::DOUBLE"), ("bo", "0.4::DOUBLE")) for x in words)
    return f"""t AS (SELECT page_id, source_id, slug, type, {_TITLE} AS ti, {_BODY} AS bo FROM pages_v),
f AS (SELECT *, ' ' || array_to_string(ti || bo, ' ') || ' ' AS flat FROM t),
k AS (SELECT page_id, source_id, slug, type, {sums} AS score FROM f WHERE contains(flat, ' the ') AND contains(flat, ' and ') AND contains(flat, ' of the ') AND (contains(flat, ' inghe ') OR contains(flat, ' thing ')) AND NOT contains(flat, ' stupid '))"""


def _keyword(spark, sf):
    return R.keyword_scores(views.pages(spark, sf), _QUERY, ["page_id", "source_id", "slug", "type"], {"A": F.col("title"), "B": F.col("compiled_truth")})


@query("r1_keyword_search", f"{with_views('pages', more=_fts())} SELECT page_id, slug, round(score, 6) AS score FROM k QUALIFY row_number() OVER (ORDER BY round(score, 6) DESC, page_id) <= 20")
def keyword_search(spark, sf):
    return R.top(_keyword(spark, sf).withColumn("score", F.round("score", 6)), 20, F.desc("score"), F.asc("page_id")).select("page_id", "slug", "score")


@query("r2_keyword_all", f"{with_views('pages', more=_fts())} SELECT page_id, round(score, 6) AS score FROM k")
def keyword_all(spark, sf):
    return _keyword(spark, sf).select("page_id", F.round("score", 6).alias("score"))


@query(
    "r3_inverted_index",
    f"{with_views('pages')} SELECT page_id, term, 'A' AS class, count(*) AS tf FROM (SELECT page_id, unnest({_TITLE}) AS term FROM pages_v) GROUP BY ALL UNION ALL SELECT page_id, term, 'B', count(*) FROM (SELECT page_id, unnest({_BODY}) AS term FROM pages_v) GROUP BY ALL",
)
def inverted_index(spark, sf):
    return R.inverted_index(views.pages(spark, sf), ["page_id"], {"A": F.col("title"), "B": F.col("compiled_truth")})


@query("r3_indexed_search", f"{with_views('pages', more=_fts())} SELECT page_id, round(score, 6) AS score FROM k")
def indexed_search(spark, sf):
    """The keyword search over postings that were written to the shared folder: one folder lookup for each term."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4().hex}"
    p = views.pages(spark, sf)
    classes = {"A": F.col("title"), "B": F.col("compiled_truth")}
    blocks = R.posting_blocks(p, ["page_id"], classes)
    R.write_index(blocks, path)
    found = cut_lineage(R.indexed_scores(R.read_index(blocks, path, _QUERY), _QUERY, ["page_id"]))
    remove_folder(spark, path)
    return R.with_phrases(found.join(p.select("page_id", "title", "compiled_truth"), "page_id"), _QUERY, classes).select("page_id", F.round("score", 6).alias("score"))


def _shared(spark):
    """The cluster's shared folder."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _words_of(_):
    return {"A": F.col("title"), "B": F.col("compiled_truth")}


@query("r1_positions", f"{with_views('pages', more=_fts())} SELECT page_id, round(score, 6) AS score FROM k")
def positions_search(spark, sf):
    """The keyword search with its phrase from an index of positions: no text is read once the index is written."""
    p = views.pages(spark, sf)
    index = TI.create(p, f"{_shared(spark)}/words-{uuid.uuid4().hex}", "page_id", _words_of(p))
    found = cut_lineage(TI.scores(spark, index, _QUERY))
    remove_folder(spark, index.path)
    return found.select(F.col("key").alias("page_id"), F.round("score", 6).alias("score"))


@query(
    "r1_nearness",
    f"""{with_views('pages')}, w AS (SELECT page_id, unnest({_TITLE} || {_BODY}) AS term, generate_subscripts({_TITLE} || {_BODY}, 1) AS i FROM pages_v)
SELECT a.page_id, min(abs(a.i - b.i))::INT AS distance FROM w a JOIN w b ON b.page_id = a.page_id WHERE a.term = 'the' AND b.term = 'and' GROUP BY a.page_id""",
)
def nearness(spark, sf):
    """How near two words stand to each other on each page that has both, from positions."""
    p = views.pages(spark, sf)
    rows = TI.postings(p, "page_id", _words_of(p)).filter(F.col("term").isin("the", "and"))
    each = rows.groupBy("key").agg(F.collect_list(F.struct("term", "class", "positions")).alias("terms"))
    return each.select(F.col("key").alias("page_id"), TI.nearest_pair(F.col("terms"), "the", "and").alias("distance")).filter("distance is not null")


@query("r3_updated_index", f"{with_views('pages')}, c AS (SELECT page_id, title, CASE WHEN page_id % 50 = 7 THEN 'the changed and page' ELSE compiled_truth END AS compiled_truth FROM pages_v WHERE page_id % 50 <> 9), t AS (SELECT page_id, {_TITLE} || {_BODY} AS w FROM c) SELECT page_id FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'and')")
def updated_index(spark, sf):
    """A search after a fiftieth of the pages has changed and another has gone: their postings alone are written anew."""
    p = views.pages(spark, sf)
    index = TI.create(p, f"{_shared(spark)}/words-{uuid.uuid4().hex}", "page_id", _words_of(p))
    changed = p.filter("page_id % 50 = 7").withColumn("compiled_truth", F.lit("the changed and page"))
    TI.update(index, changed, "page_id", _words_of(p), deleted=p.filter("page_id % 50 = 9"))
    found = cut_lineage(TI.scores(spark, index, "the and"))
    remove_folder(spark, index.path)
    return found.select(F.col("key").alias("page_id"))


def _vector_of(spark, sf, i=0):
    """One row by key: the query's vector."""
    return [float(x) for x in table(spark, sf, "embeddings").filter(F.col("vec_id") == i).select("embedding").first()[0]]


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {i}))"


@query("r4_vector_search", f"SELECT chunk_id, page_id, round(score, 6) AS score FROM (SELECT vec_id AS chunk_id, label AS page_id, {_COS.format(i=0)} AS score FROM embeddings) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, chunk_id) = 1 ORDER BY score DESC, page_id LIMIT 8")
def vector_search(spark, sf):
    return R.vector_search(views.chunks(spark, sf), _vector_of(spark, sf), 8).withColumn("score", F.round("score", 6))


@query("r5_top_per_page", f"SELECT vec_id AS chunk_id, label AS page_id, round({_COS.format(i=3)}, 6) AS score FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_COS.format(i=3)} DESC, vec_id) <= 3")
def top_per_page(spark, sf):
    s = R.vector_scores(views.chunks(spark, sf), _vector_of(spark, sf, 3)).select("chunk_id", "page_id", "score")
    return R.best_per(s, ["page_id"], [F.desc("score"), F.asc("chunk_id")], 3).withColumn("score", F.round("score", 6))


def _list(spark, sf, i, n=50):
    s = R.vector_scores(views.chunks(spark, sf), _vector_of(spark, sf, i)).select("chunk_id", "score")
    return R.top(s, n, F.desc("score"), F.asc("chunk_id"))


def _lists(*ids, n=50, first=0, ks=(60.0, 120.0)):
    return ", ".join(f"l{i} AS (SELECT vec_id AS chunk_id, {_COS.format(i=i)} AS s FROM embeddings ORDER BY s DESC, chunk_id LIMIT {n}), r{i} AS (SELECT chunk_id, 1.0::DOUBLE / ({k}::DOUBLE + row_number() OVER (ORDER BY s DESC, chunk_id) - 1 + {first}) AS part FROM l{i})" for i, k in zip(ids, ks, strict=False))


@query("r6_rrf", f"WITH {_lists(1, 2)}, u AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2), g AS (SELECT chunk_id, sum(part) AS s FROM u GROUP BY 1) SELECT chunk_id, round(s / (SELECT max(s) FROM g) * CASE WHEN chunk_id % 4 = 0 THEN 2 ELSE 1 END, 6) AS score FROM g")
def rrf(spark, sf):
    out = R.rrf([(_list(spark, sf, 1), 1.0), (_list(spark, sf, 2), 0.5)], ["chunk_id"], boosted=F.col("chunk_id") % 4 == 0)
    return out.select("chunk_id", F.round("score", 6).alias("score"))


@query("r21_take_fusion", f"WITH {_lists(4, 5, first=1, ks=(60.0, 60.0))}, u AS (SELECT * FROM r4 UNION ALL SELECT * FROM r5) SELECT chunk_id, round(sum(part), 8) AS score FROM u GROUP BY 1")
def take_fusion(spark, sf):
    return R.rrf([(_list(spark, sf, 4), 1.0), (_list(spark, sf, 5), 1.0)], ["chunk_id"], first_rank=1, normalize=False).select("chunk_id", F.round("score", 8).alias("score"))


@query("r8_cosine_rescore", f"WITH r AS (SELECT vec_id AS chunk_id, (1000 - vec_id)::DOUBLE AS score FROM embeddings UNION ALL SELECT 100000000, 5.0), c AS (SELECT vec_id, {_COS.format(i=7)} AS cos FROM embeddings) SELECT chunk_id, round(CASE WHEN cos IS NULL THEN score ELSE 0.7 * score / (SELECT max(score) FROM r) + 0.3 * cos END, 6) AS score FROM r LEFT JOIN c ON vec_id = chunk_id")
def cosine_rescore(spark, sf):
    r = views.chunks(spark, sf).select("chunk_id", (1000 - F.col("chunk_id")).cast("double").alias("score"))
    r = r.union(spark.createDataFrame([(100000000, 5.0)], "chunk_id long, score double"))
    return R.rescore(r, views.chunks(spark, sf), _vector_of(spark, sf, 7), "chunk_id").select("chunk_id", F.round("score", 6).alias("score"))


_PAIRS = "SELECT a.label AS bucket, a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label"


def _facts(spark, sf):
    return views.chunks(spark, sf).select(F.col("page_id").alias("bucket"), F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))


@query("r9_cosine_pairs", f"SELECT bucket, id, other, round(sim, 6) AS sim FROM ({_PAIRS} AND a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY bucket, id ORDER BY sim DESC, other) = 1")
def cosine_pairs(spark, sf):
    """Each vector's nearest of all others with its label."""
    f = _facts(spark, sf)
    return R.block_matches(f, f, 1).withColumn("sim", F.round("sim", 6))


_EXACT = "SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sim DESC, b.vec_id) <= 10"


@query("r4_index_recall", f"SELECT count(*) AS wanted, true AS recall_reached, true AS a_fifth_read FROM ({_EXACT})")
def index_recall(spark, sf):
    """The kept index against the exact ten nearest: recall of 0.9 and more, vectors read of a fifth of the rows and less.

    Queries are the rows with an id divisible by 100.
    """
    rows = views.chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))
    queries = rows.filter("id % 100 = 0")
    index = VI.build(rows, f"{_shared(spark)}/vectors-{uuid.uuid4().hex}")
    whole = lambda d: d.withColumn("bucket", F.lit(0))
    exact = R.block_matches(whole(queries), whole(rows), 10).select("id", "other")
    found = VI.search(queries, VI.read(spark, index.path), 10).select("id", "other").withColumn("hit", F.lit(1))
    counted = cut_lineage(exact.join(found, ["id", "other"], "left").agg(F.count(F.lit(1)).alias("wanted"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached")))
    remove_folder(spark, index.path)
    return counted.withColumn("a_fifth_read", F.lit(index.short <= 0.2 * index.rows))


@query("r4_indexed_vectors", f"SELECT vec_id AS chunk_id, round({_COS.format(i=0)}, 6) AS score FROM embeddings ORDER BY {_COS.format(i=0)} DESC, vec_id LIMIT 1")
def indexed_vectors(spark, sf):
    """The nearest row by the kept index: folders of lists, codes, then exact scores of the best coded."""
    rows = views.chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))
    index = VI.build(rows, f"{_shared(spark)}/vectors-{uuid.uuid4().hex}")
    found = cut_lineage(VI.nearest(spark, index, _vector_of(spark, sf), 1))
    remove_folder(spark, index.path)
    return found.select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))


@query("r12_hydrate", f"{with_views('pages')} SELECT page_id, slug, type, n_chars FROM pages_v WHERE page_id IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def hydrate(spark, sf):
    ids = table(spark, sf, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("page_id"))
    return views.pages(spark, sf).join(ids, "page_id", "left_semi").select("page_id", "slug", "type", "n_chars")


@query(
    "r13_alias_hop",
    f"""{with_views('pages', more=_fts())}, r AS (SELECT p.source_id, p.slug, score FROM k JOIN pages_v p ON p.page_id = k.page_id),
h AS (SELECT source_id, slug, row_number() OVER (ORDER BY source_id, slug) - 1 AS i FROM (SELECT DISTINCT source_id, slug FROM pages_v WHERE page_id IN (5, 9, 77) ORDER BY 1, 2 LIMIT 3)),
p AS (SELECT r.source_id, r.slug, CASE WHEN h.slug IS NOT NULL THEN score * 1.10 ELSE score END AS score, h.slug IS NOT NULL AS alias_hit FROM r LEFT JOIN h USING (source_id, slug)),
a AS (SELECT *, 3 AS n FROM h WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.slug = h.slug AND r.source_id = h.source_id))
SELECT source_id, slug, round(score, 6) AS score, alias_hit FROM p UNION ALL SELECT source_id, slug, round((SELECT coalesce(max(score), 0) FROM p) + (n - i) * 1e-6, 6), true FROM a""",
)
def alias_hop(spark, sf):
    """A keyword search whose query is an alias of three pages, found by it or not."""
    r = _keyword(spark, sf).select("source_id", "slug", "score")
    aliases = views.pages(spark, sf).filter("page_id in (5, 9, 77)").select(F.lit("acme").alias("alias_norm"), "source_id", "slug")
    return R.alias_hop(r, aliases, "acme").withColumn("score", F.round("score", 6))


_WORDS = "list_filter(regexp_split_to_array(compiled_truth, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"


def _head(spark, sf, n=100):
    """The best pages of a keyword search, as the steps behind the fusion get them."""
    k = _keyword(spark, sf).select("page_id", F.round("score", 9).alias("score"))
    best = R.top(k, n, F.desc("score"), F.asc("page_id"))
    return best.join(views.pages(spark, sf).select("page_id", "source_id", "slug", "title", "type", F.col("compiled_truth").alias("text")), "page_id")


_HEAD = "h AS (SELECT k.page_id, p.source_id, p.slug, p.title, p.type, compiled_truth, s AS score FROM (SELECT page_id, round(score, 9) AS s FROM k QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, page_id) <= 100) k JOIN pages_v p ON p.page_id = k.page_id)"


@query("r15_rerank", f"{with_views('pages', more=_fts())}, {_HEAD}, o AS (SELECT page_id, row_number() OVER (ORDER BY score DESC, page_id) AS pos, len(list_distinct({_WORDS}))::DOUBLE AS words FROM h) SELECT page_id, CASE WHEN pos <= 30 THEN words END AS rerank_score FROM o QUALIFY row_number() OVER (ORDER BY CASE WHEN pos <= 30 THEN words END DESC NULLS LAST, pos) <= 20")
def rerank(spark, sf):
    """The head of a search, put in another order by a function of the text: its number of different words."""
    return R.rerank(_head(spark, sf), lambda t: float(len(set(re.findall(r"[^ \t\n\r\f]+", t)))), 30, 20, [F.desc("score"), F.asc("page_id")]).select("page_id", "rerank_score")


@query("r17_search_takes", f"{with_views('takes')} SELECT id, page_id, holder, weight FROM takes_v WHERE active AND holder IN ('h1', 'h3') AND domain = 'd2' AND quality = 'correct' AND weight >= 0.9")
def search_takes(spark, sf):
    return views.takes(spark, sf).filter(F.col("active") & F.col("holder").isin("h1", "h3") & (F.col("domain") == "d2") & (F.col("quality") == "correct") & (F.col("weight") >= 0.9)).select("id", "page_id", "holder", "weight")


_BENT = "list_transform(embedding::DOUBLE[], lambda x, i: x * (1 + 0.3::DOUBLE * ((i - 1) % 3 - 1)))"


@query(
    "r18_semantic_cache",
    f"""WITH c AS (SELECT vec_id, embedding, vec_id % 2 AS src, vec_id % 3 AS knobs, TIMESTAMP '2024-03-01' - to_minutes((vec_id % 90)::BIGINT) AS made, 100 + vec_id % 5 AS gen FROM embeddings),
g AS (SELECT c.vec_id, c.vec_id + k AS page_id, (c.vec_id + k) % 7 + CASE WHEN c.vec_id % 4 = 0 AND k = 1 THEN 1 ELSE 0 END AS was FROM c, (VALUES (1), (2)) AS t(k) WHERE c.vec_id % 6 <> 5),
t AS (SELECT g.vec_id FROM g LEFT JOIN part ON p_partkey = page_id GROUP BY g.vec_id HAVING bool_and(p_partkey IS NOT NULL AND p_partkey % 7 = was)),
u AS (SELECT * FROM c WHERE epoch(made) + 3600 > epoch(TIMESTAMP '2024-03-01') AND (gen >= 102 OR vec_id IN (SELECT vec_id FROM t))),
q AS (SELECT vec_id AS id, vec_id % 2 AS src, vec_id % 3 AS knobs, {_BENT} AS v FROM embeddings WHERE vec_id % 100 = 0 OR vec_id % 7 = 0)
SELECT id, u.vec_id AS entry, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS sim, (epoch(TIMESTAMP '2024-03-01') - epoch(made))::BIGINT AS age_seconds FROM q JOIN u ON u.src = q.src AND u.knobs = q.knobs
WHERE list_cosine_similarity(v, embedding::DOUBLE[]) > 0.92 QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_cosine_similarity(v, embedding::DOUBLE[]) DESC, u.vec_id) = 1""",
)
def semantic_cache(spark, sf):
    """Kept answers for questions whose vectors are bent copies of the keys: within time to live, same source and knobs, still true."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))
    i = F.col("i")
    pairs = [F.struct((i + k).alias("k"), ((i + k) % 7 + (F.when(i % 4 == 0, 1).otherwise(0) if k == 1 else F.lit(0))).alias("g")) for k in (1, 2)]
    pages_of = F.map_from_entries(F.when(i % 6 != 5, F.array(*pairs)).otherwise(F.filter(F.array(*pairs), lambda x: F.lit(False))))
    made = F.lit("2024-03-01 00:00:00").cast("timestamp") - F.make_interval(mins=(i % 90).cast("int"))
    cache = e.select(i.alias("entry"), (i % 2).alias("source_id"), (i % 3).alias("knobs"), F.col("v").alias("embedding"), made.alias("created_at"), F.lit(3600).alias("ttl_seconds"), (100 + i % 5).alias("generation"), pages_of.alias("page_generations"))
    bent = F.transform("v", lambda x, n: x * (1 + 0.3 * (n % 3 - 1)))
    asked = e.filter((i % 100 == 0) | (i % 7 == 0)).select(i.alias("id"), (i % 2).alias("source_id"), (i % 3).alias("knobs"), bent.alias("vector"))
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), (F.col("p_partkey") % 7).alias("generation"))
    found = R.cache_hits(asked, cache, pages, 102, "2024-03-01 00:00:00")
    return found.select("id", "entry", F.round("sim", 6).alias("sim"), "age_seconds")


@query("r19_fact_candidates", f"SELECT bucket, id, other, round(sim, 6) AS sim FROM ({_PAIRS} AND a.vec_id <> b.vec_id AND a.vec_id % 100 = 0) QUALIFY row_number() OVER (PARTITION BY bucket, id ORDER BY sim DESC, other) <= 5")
def fact_candidates(spark, sf):
    """The five nearest facts of the bucket to each new fact; the new ones are those with an id divisible by 100."""
    f = _facts(spark, sf)
    return R.block_matches(f.filter("id % 100 = 0"), f, 5).withColumn("sim", F.round("sim", 6))


@query("r20_find_experts", f"WITH m AS (SELECT label AS person, max({_COS.format(i=2)}) AS best, min(vec_id % 400) AS days, count(*) AS sal FROM embeddings GROUP BY label) SELECT person, round(ln(1 + greatest(best, 0)) * greatest(0.1, exp(-days / 180.0)) * (0.5 + 0.5 * sal / (1 + sal)), 6) AS score FROM m ORDER BY score DESC, person LIMIT 10")
def find_experts(spark, sf):
    s = R.vector_scores(views.chunks(spark, sf), _vector_of(spark, sf, 2))
    m = s.groupBy(F.col("page_id").alias("person")).agg(F.max("score").alias("best"), F.min(F.col("chunk_id") % 400).alias("days"), F.count(F.lit(1)).alias("sal"))
    score = F.log1p(F.greatest("best", F.lit(0.0))) * F.greatest(F.lit(0.1), F.exp(-F.col("days") / 180.0)) * (0.5 + 0.5 * F.col("sal") / (1 + F.col("sal")))
    return m.select("person", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "person").limit(10)


@query(
    "r22_entity_pointers",
    """WITH p AS (SELECT 'parts/' || p_brand || '/' || replace(p_name, ' ', '-') AS slug, p_name AS title, p_partkey AS k FROM part), a AS (SELECT 'brand ' || p_brand || ' ' || p_size AS name, 'parts/' || p_brand || '/' || replace(p_name, ' ', '-') AS slug FROM part WHERE p_size < 9),
n AS (SELECT lower(title) AS name FROM p WHERE k % 3 = 0 UNION SELECT replace(title, ' ', '-') FROM p WHERE k % 3 = 1 UNION SELECT name FROM a),
u AS (SELECT name, slug, 'alias' AS arm, 0 AS i, 0.9::DOUBLE AS c FROM a UNION SELECT lower(trim(title)), slug, 'title', 1, 0.8::DOUBLE FROM p UNION SELECT regexp_extract(slug, '[^/]*$'), slug, 'suffix', 2, 0.6::DOUBLE FROM p),
s AS (SELECT DISTINCT slug FROM p JOIN lineitem ON l_partkey = k WHERE l_quantity > 48)
SELECT name, slug, arm, round(least(0.99, c + CASE WHEN slug IN (SELECT slug FROM s) THEN 0.1 ELSE 0 END), 4)::DOUBLE AS confidence FROM u WHERE name IN (SELECT name FROM n)
QUALIFY row_number() OVER (PARTITION BY name ORDER BY least(0.99, c + CASE WHEN slug IN (SELECT slug FROM s) THEN 0.1 ELSE 0 END) DESC, i, slug) = 1""",
)
def entity_pointers(spark, sf):
    """Names of parts, as titles, last parts of slugs or aliases; parts that are ordered in bulk gain."""
    part = table(spark, sf, "part")
    tail = F.replace("p_name", F.lit(" "), F.lit("-"))
    slug = F.concat(F.lit("parts/"), "p_brand", F.lit("/"), tail)
    p = part.select(slug.alias("slug"), F.col("p_name").alias("title"), F.col("p_partkey").alias("k"))
    aliases = part.filter("p_size < 9").select(F.concat_ws(" ", F.lit("brand"), "p_brand", F.col("p_size").cast("string")).alias("alias_norm"), slug.alias("slug"))
    names = p.filter("k % 3 = 0").select(F.lower("title").alias("name")).union(p.filter("k % 3 = 1").select(F.replace("title", F.lit(" "), F.lit("-")))).union(aliases.select("alias_norm"))
    salient = p.join(table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("k")), "k", "left_semi")
    return R.entity_pointers(names, p, aliases, salient).select("name", "slug", "arm", F.round("confidence", 4).alias("confidence"))


# --- score modifiers -------------------------------------------------------------------------------------------------

_BASE = "b AS (SELECT page_id, source_id, slug, type, title, 1.0::DOUBLE / (1 + page_id) AS score FROM pages_v)"


def _base(spark, sf):
    return views.pages(spark, sf).withColumn("score", F.lit(1.0) / (1 + F.col("page_id")))


@query("m1_floor_gate", f"{with_views('pages', more=_BASE)} SELECT page_id, round(CASE WHEN score >= 0.05 THEN score * 1.5 ELSE score END, 6) AS score FROM b")
def floor_gate(spark, sf):
    return M.boost(M.floor_threshold(_base(spark, sf), 0.05), F.lit(1.5)).select("page_id", F.round("score", 6).alias("score"))


@query("m2_backlink_boost", f"{with_views('pages', more=_BASE)}, n AS (SELECT l_partkey AS page_id, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1) SELECT b.page_id, round(score * CASE WHEN coalesce(n, 0) > 0 THEN 1 + 0.05 * ln(1 + n) ELSE 1 END, 6) AS score FROM b LEFT JOIN n USING (page_id)")
def backlink_boost(spark, sf):
    n = table(spark, sf, "lineitem").filter("l_quantity > 30").groupBy(F.col("l_partkey").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))
    j = M.floor_threshold(_base(spark, sf), None).join(n, "page_id", "left")
    return M.boost(j, M.backlink_factor(F.coalesce("n", F.lit(0)))).select("page_id", F.round("score", 6).alias("score"))


@query("m3_salience_boost", f"{with_views('pages', more=_BASE)} SELECT page_id, round(score * (1 + 0.30 * ln(1 + page_id % 9)), 6) AS score FROM b")
def salience_boost(spark, sf):
    return M.boost(M.floor_threshold(_base(spark, sf), None), M.salience_factor(F.col("page_id") % 9, strong=True)).select("page_id", F.round("score", 6).alias("score"))


@query("m4_recency_boost", f"{with_views('pages', more=_BASE)} SELECT page_id, round(score * CASE WHEN slug LIKE 'de/%' THEN 1.0 WHEN slug LIKE 'en/1%' THEN 1 + 1.5 * 30 / (30.0 + page_id) WHEN slug LIKE 'en/%' THEN 1 + 0.5 * 180 / (180.0 + page_id) ELSE 1 + 0.5 * 90 / (90.0 + page_id) END, 6) AS score FROM b")
def recency_boost(spark, sf):
    table_ = {"de/": (0, 0.0), "en/": (180, 0.5), "en/1": (30, 1.5)}
    f = M.recency_factor(F.col("slug"), F.col("page_id").cast("double"), table=table_)
    return M.boost(M.floor_threshold(_base(spark, sf), None), f).select("page_id", F.round("score", 6).alias("score"))


@query("m5_chronicle_boost", f"{with_views('pages', more=_BASE)} SELECT page_id, round(score * CASE WHEN page_id % 3 < 2 THEN 1.25 ELSE 1 END, 6) AS score FROM b")
def chronicle_boost(spark, sf):
    kind = F.when(F.col("page_id") % 3 == 0, "event").when(F.col("page_id") % 3 == 1, "diary").otherwise("note")
    return M.boost(M.floor_threshold(_base(spark, sf), None), M.chronicle_factor(kind, strong=True)).select("page_id", F.round("score", 6).alias("score"))


@query("m6_title_boost", f"{with_views('pages', more=_BASE)} SELECT page_id, round(score * CASE WHEN contains(' ' || array_to_string({_TITLE}, ' ') || ' ', ' the and ') THEN 1.25 ELSE 1 END, 6) AS score FROM b")
def title_boost(spark, sf):
    return M.boost(M.floor_threshold(_base(spark, sf), None), M.title_factor(F.col("title"), F.lit("The, and"))).select("page_id", F.round("score", 6).alias("score"))


@query("m7_graph_signals", f"{with_views('pages', more=_BASE)}, p AS (SELECT *, row_number() OVER (ORDER BY score DESC, slug) AS pos FROM b), q AS (SELECT *, row_number() OVER (PARTITION BY page_id % 6 ORDER BY pos) AS nth FROM p) SELECT page_id, round(score * CASE WHEN pos <= 20 THEN (CASE WHEN page_id % 4 >= 2 THEN 1.05 ELSE 1 END) * (CASE WHEN page_id % 5 >= 2 THEN 1.10 ELSE 1 END) * (CASE WHEN nth > 1 THEN 0.95 ELSE 1 END) ELSE 1 END, 6) AS score FROM q")
def graph_signals(spark, sf):
    i = F.col("page_id")
    return M.graph_signals(_base(spark, sf).withColumn("hits", i % 4).withColumn("cross_hits", i % 5).withColumn("session", i % 6)).select("page_id", F.round("score", 6).alias("score"))


@query("m8_alias_boost", f"{with_views('pages', more=_BASE)} SELECT page_id, round(score * CASE WHEN page_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 1.05 ELSE 1 END, 6) AS score FROM b")
def alias_boost(spark, sf):
    hit = table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("page_id")).distinct().withColumn("hit", F.lit(True))
    j = M.floor_threshold(_base(spark, sf), None).join(hit, "page_id", "left")
    return M.boost(j, F.when(F.col("hit"), 1.05).otherwise(1.0)).select("page_id", F.round("score", 6).alias("score"))


@query("m9_exact_boost", f"{with_views('pages', more=_BASE)} SELECT page_id, round(score * CASE WHEN lower(title) = '42' OR slug LIKE '%/42' THEN 1.25 ELSE 1 END, 6) AS score FROM b")
def exact_boost(spark, sf):
    return M.boost(M.floor_threshold(_base(spark, sf), None), M.exact_factor(F.col("slug"), F.col("title"), " 42 ", "entity")).select("page_id", F.round("score", 6).alias("score"))


@query("m10_score_distribution", "WITH s AS (SELECT list(o_totalprice ORDER BY o_totalprice) AS x, count(*) AS n FROM orders), p AS (SELECT n, x[floor((n - 1) * 0.25 + 0.5)::INT + 1] AS p25, x[floor((n - 1) * 0.5 + 0.5)::INT + 1] AS p50, x[floor((n - 1) * 0.75 + 0.5)::INT + 1] AS p75, x[floor((n - 1) * 0.9 + 0.5)::INT + 1] AS p90, x[floor((n - 1) * 0.95 + 0.5)::INT + 1] AS p95 FROM s) SELECT n, p25, p50, p75, p90, p95, round(p75 - p25, 4) AS band FROM p")
def score_distribution(spark, sf):
    return M.score_distribution(table(spark, sf, "orders").select(F.col("o_totalprice").alias("score"))).withColumn("band", F.round("band", 4))


@query("m11_evidence", f"{with_views('pages')} SELECT page_id, e AS evidence, CASE WHEN e IN ('alias_hit', 'exact_title', 'strong') THEN 'exists' WHEN e = 'solid' THEN 'probable' ELSE 'unknown' END AS safety FROM (SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 'alias_hit' WHEN page_id % 13 = 0 THEN 'exact_title' WHEN page_id % 100 / 100.0 >= 0.85 THEN 'strong' WHEN page_id % 100 / 100.0 >= 0.6 THEN 'solid' ELSE 'weak' END AS e FROM pages_v)")
def evidence(spark, sf):
    i = F.col("page_id")
    e = views.pages(spark, sf).select("page_id", M.evidence(i % 17 == 0, i % 13 == 0, i % 100 / 100.0).alias("evidence"))
    return e.withColumn("safety", M.create_safety(F.col("evidence")))


# --- de-duplication and cut-offs -------------------------------------------------------------------------------------


@query("d1_top3_per_page", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 3")
def top3_per_page(spark, sf):
    return R.best_per(table(spark, sf, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], 3).select("l_orderkey", "l_linenumber")


@query("d2_text_dedup")
def text_dedup(spark, sf):
    """The best hundred documents of each source for a search, without those that repeat a better one."""
    k = _keyword(spark, sf).select("page_id", "source_id", F.round("score", 9).alias("score"))
    lists = R.best_per(k, ["source_id"], [F.desc("score"), F.asc("page_id")], 100)
    ranked = lists.withColumn("rank", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("score"), F.asc("page_id"))))
    texts = views.pages(spark, sf).select("page_id", F.col("compiled_truth").alias("text"))
    return M.text_dedup(ranked.join(texts, "page_id"), "source_id").select("source_id", F.col("page_id").alias("doc_id"), "rank")


@query("d3_type_diversity", f"{with_views('pages')} SELECT page_id, type FROM pages_v QUALIFY row_number() OVER (PARTITION BY type ORDER BY page_id) <= greatest(1, ceil(0.4 * count(*) OVER ()))")
def type_diversity(spark, sf):
    return M.diversify(views.pages(spark, sf).select("page_id", "type", F.col("page_id").alias("rank")), "type", 0.4).select("page_id", "type")


@query("d4_cap_per_page", "SELECT label AS page_id, vec_id AS chunk_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 2")
def cap_per_page(spark, sf):
    return R.best_per(views.chunks(spark, sf).select("page_id", "chunk_id"), ["page_id"], [F.asc("chunk_id")], 2)


@query(
    "d5_truth_guarantee",
    """WITH c AS (SELECT l_orderkey AS page_id, l_linenumber AS chunk_id, l_extendedprice AS score, CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN 'compiled_truth' ELSE 'timeline' END AS chunk_source FROM lineitem),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, chunk_id) <= 2),
b AS (SELECT * FROM c WHERE chunk_source = 'compiled_truth' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, chunk_id) = 1),
n AS (SELECT page_id FROM k GROUP BY 1 HAVING max((chunk_source = 'compiled_truth')::INT) = 0 INTERSECT SELECT page_id FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score, chunk_id DESC) AS low FROM k)
SELECT page_id, chunk_id, chunk_source FROM f WHERE page_id NOT IN (SELECT page_id FROM n) OR low > 1 UNION ALL SELECT page_id, chunk_id, chunk_source FROM b WHERE page_id IN (SELECT page_id FROM n)""",
)
def truth_guarantee(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_extendedprice").alias("score"), F.when(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp"), "compiled_truth").otherwise("timeline").alias("chunk_source"))
    kept = R.best_per(c, ["page_id"], [F.desc("score"), F.asc("chunk_id")], 2)
    return M.truth_guarantee(kept, c).select("page_id", "chunk_id", "chunk_source")


@query(
    "d6_autocut",
    f"""WITH s AS (SELECT vec_id AS chunk_id, round({_COS.format(i=1)}, 9) AS rs FROM embeddings QUALIFY row_number() OVER (ORDER BY {_COS.format(i=1)} DESC, vec_id) <= 100),
g AS (SELECT *, row_number() OVER (ORDER BY rs DESC, chunk_id) AS i, (rs - lead(rs) OVER (ORDER BY rs DESC, chunk_id)) / (SELECT max(rs) FROM s) AS gap FROM s),
c AS (SELECT rs AS cut, gap FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, i LIMIT 1)
SELECT chunk_id FROM s, c WHERE gap < 0.2 OR rs >= cut""",
)
def autocut(spark, sf):
    """The hundred nearest vectors to one of them, cut after the largest gap."""
    s = _list(spark, sf, 1, 100).select(F.lpad(F.col("chunk_id").cast("string"), 12, "0").alias("slug"), "chunk_id", F.round("score", 9).alias("rerank_score"), F.lit(False).alias("alias_hit"))
    return M.autocut(s).select("chunk_id")


@query("d7_adaptive_return", f"{with_views('pages')} SELECT page_id FROM pages_v WHERE type = 'en' ORDER BY n_chars DESC, page_id LIMIT 2")
def adaptive_return(spark, sf):
    return views.pages(spark, sf).filter("type = 'en'").orderBy(F.desc("n_chars"), "page_id").limit(M.adaptive_limit("entity")).select("page_id")


@query("d8_token_budget", f"{with_views('pages', more=_fts())}, {_HEAD} SELECT page_id, spent FROM (SELECT page_id, sum(ceil(length(coalesce(title, '') || coalesce(compiled_truth, '')) / 4.0)::BIGINT) OVER (ORDER BY score DESC, page_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM h) WHERE spent <= 40000")
def token_budget(spark, sf):
    """The head of a search, as far as a budget of tokens goes."""
    return M.token_budget(_head(spark, sf), 40000, [F.desc("score"), F.asc("page_id")]).select("page_id", "spent")


@query("d9_offset_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def offset_limit(spark, sf):
    return M.page_of(table(spark, sf, "orders"), 50, 25, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey")


@query("d10_content_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_dedup(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query("d11_tracker_dedup", "WITH t AS (SELECT o_orderkey AS id, o_custkey AS who, date_trunc('month', o_orderdate) AS m, o_totalprice AS v FROM orders) SELECT a.id, min(b.id) AS first_id FROM t a JOIN t b ON a.who = b.who AND a.m = b.m AND b.id < a.id AND abs(a.v - b.v) <= 0.2 * greatest(a.v, b.v) GROUP BY a.id")
def tracker_dedup(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"), F.date_trunc("month", "o_orderdate").alias("m"), F.col("o_totalprice").alias("v"))
    b = t.select(F.col("id").alias("other"), "who", "m", F.col("v").alias("w"))
    close = F.abs(F.col("v") - F.col("w")) <= 0.2 * F.greatest("v", "w")
    return t.join(b, ["who", "m"]).filter(F.col("other") < F.col("id")).filter(close).groupBy("id").agg(F.min("other").alias("first_id"))


# Similarity from which a fact is the same as an earlier one, and from which it is near it.
SAME, NEAR = 0.95, 0.92


@query("d12_near_duplicate_facts", f"SELECT bucket, id, other, round(sim, 6) AS sim, CASE WHEN sim >= {SAME} THEN 'same' WHEN sim >= {NEAR} THEN 'near' ELSE 'new' END AS verdict FROM (SELECT * FROM ({_PAIRS} AND b.vec_id < a.vec_id) QUALIFY row_number() OVER (PARTITION BY bucket, id ORDER BY sim DESC, other) = 1)")
def near_duplicate_facts(spark, sf):
    """Each fact's best match among all earlier ones of its bucket, and what that makes of it."""
    f = _facts(spark, sf)
    best = R.block_matches(f, f, 1, earlier_only=True)
    return best.select("bucket", "id", "other", F.round("sim", 6).alias("sim"), F.when(F.col("sim") >= SAME, "same").when(F.col("sim") >= NEAR, "near").otherwise("new").alias("verdict"))


@query("d13_summary_clusters", "SELECT source, count(*) AS documents, sum(ceil(n_chars / 4.0))::BIGINT AS tokens, count(*) FILTER (WHERE ceil(n_chars / 4.0) > 2000) AS over, 0::BIGINT AS failed FROM documents GROUP BY source")
def summary_clusters(spark, sf):
    """Each source's documents in clusters of like vectors within 2,000 tokens, summed up by a hook: all are there once, none is over but single ones."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.ceil(F.col("n_chars") / 4).alias("tokens"), "text")
    e = views.chunks(spark, sf).select(F.col("chunk_id").alias("k"), "embedding")
    n = e.count()
    rows = d.withColumn("k", F.col("doc_id") % n).join(e, "k", "left").select(F.col("source").alias("bucket"), F.col("doc_id").alias("id"), "tokens", F.col("embedding").alias("vector"))
    members = cut_lineage(payload.clusters(rows, 2000))
    done = payload.summed_up(members, d.select(F.col("doc_id").alias("id"), "text"), first_words, 2000)
    return done.groupBy(F.col("bucket").alias("source")).agg(F.sum("n").alias("documents"), F.sum("tokens").alias("tokens"), F.count_if("over").alias("over"), F.count_if(F.col("summary").isNull()).alias("failed"))


def first_words(texts: list[str]) -> str:
    """A stand-in for a model: the first words of each text."""
    return " / ".join(" ".join(t.split(None, 8)[:8]) for t in texts)


@query("d13_payload_batches", "SELECT doc_id, floor((sum(ceil(n_chars / 4.0)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - ceil(n_chars / 4.0)) / 2000)::BIGINT AS batch FROM documents")
def payload_batches(spark, sf):
    """Each source's documents in turn, in batches of about 2,000 tokens."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.ceil(F.col("n_chars") / 4).alias("cost"))
    upto = ordered.running_total(d, F.col("cost"), "doc_id", group=["source"], name="upto")
    return upto.select("doc_id", F.floor((F.col("upto") - F.col("cost")) / 2000).cast("long").alias("batch"))


@query(
    "hybrid_search",
    f"""{with_views('pages', more=_fts(("the", "and")).replace("contains(flat, ' the ') AND contains(flat, ' and ') AND contains(flat, ' of the ') AND (contains(flat, ' inghe ') OR contains(flat, ' thing ')) AND NOT contains(flat, ' stupid ')", "contains(flat, ' the ') AND contains(flat, ' and ')"))},
kw AS (SELECT page_id, round(score, 9) AS score FROM k ORDER BY round(score, 9) DESC, page_id LIMIT 100),
ve AS (SELECT vec_id AS page_id, round({_COS.format(i=0)}, 9) AS score FROM embeddings ORDER BY round({_COS.format(i=0)}, 9) DESC, page_id LIMIT 100),
u AS (SELECT page_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, page_id) - 1) AS part FROM kw UNION ALL SELECT page_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, page_id) - 1) FROM ve),
g AS (SELECT page_id, sum(part) AS s FROM u GROUP BY 1), n AS (SELECT page_id, s / (SELECT max(s) FROM g) AS s FROM g)
SELECT n.page_id, source_id, slug, round(s, 6) AS score FROM n JOIN pages_v p ON p.page_id = n.page_id WHERE deleted_at IS NULL QUALIFY row_number() OVER (ORDER BY round(s, 6) DESC, n.page_id) <= 20""",
)
def hybrid_search(spark, sf):
    """Keyword arm and vector arm, fused by reciprocal rank; visible pages, best twenty."""
    p = views.pages(spark, sf)
    arm = lambda d: R.top(d.select("page_id", F.round("score", 9).alias("score")), 100, F.desc("score"), F.asc("page_id"))
    words = arm(R.keyword_scores(p, "the and", ["page_id"], {"A": F.col("title"), "B": F.col("compiled_truth")}))
    near = arm(R.vector_scores(views.chunks(spark, sf).withColumn("page_id", F.col("chunk_id")), _vector_of(spark, sf)))
    fused = R.rrf([(words, 1.0), (near, 1.0)], ["page_id"])
    shown = fused.join(p.filter("deleted_at is null").select("page_id", "source_id", "slug"), "page_id").withColumn("score", F.round("score", 6))
    return R.top(shown, 20, F.desc("score"), F.asc("page_id")).select("page_id", "source_id", "slug", "score")
