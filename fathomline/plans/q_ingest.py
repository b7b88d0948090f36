"""Queries over sources, chunkers and the batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomline.functions import chunkers as C
from fathomline.functions import code as K
from fathomline.operators import analytics as A
from fathomline.operators import clusters, code_graph
from fathomline.operators import retrieval as R
from fathomline.plans.catalog import query
from fathomline.session import cut_lineage, table
from fathomline.sources import documents as D
from fathomline.sources import views
from fathomline.sources.views import with_views
from fathomline.streaming import ingest as I


def _markdown(spark, sf):
    d = table(spark, sf, "documents")
    text = F.concat(F.lit("---\ntitle: \"T "), F.col("doc_id").cast("string"), F.lit("\"\ntype: "), "lang", F.lit("\n---\n# Head\n"), "text", F.lit("\n## Timeline\n- 2024-01-0"), (1 + F.col("doc_id") % 9).cast("string"), F.lit(": met\n"))
    return d.select("doc_id", "n_chars", F.concat(F.lit("notes/2024-02-0"), (1 + F.col("doc_id") % 9).cast("string"), F.lit("-a-b.md")).alias("path"), text.alias("text"))


@query("s5_markdown_scan", "SELECT doc_id, 'T ' || doc_id AS title, lang AS type, '- 2024-01-0' || (1 + doc_id % 9) || ': met' AS timeline FROM documents WHERE NOT contains(text, '## Timeline')")
def markdown_scan(spark, sf):
    m = D.split_markdown(F.col("text"))
    return _markdown(spark, sf).select("doc_id", m["frontmatter"]["title"].alias("title"), m["frontmatter"]["type"].alias("type"), m["timeline"].alias("timeline"))


@query("s6_inferred_frontmatter", "SELECT doc_id, 'Head' AS title, '2024-02-0' || (1 + doc_id % 9) AS date, 'note' AS type FROM documents")
def inferred_frontmatter(spark, sf):
    i = D.inferred(F.col("path"), F.regexp_replace("text", D.FRONT, ""))
    return _markdown(spark, sf).select("doc_id", i["title"].alias("title"), i["date"].alias("date"), i["type"].alias("type"))


@query("s8_syncable_paths", "SELECT p_partkey, p_partkey % 4 = 0 AS sync, CASE p_partkey % 4 WHEN 0 THEN 'a/small-ring' WHEN 1 THEN 'hidden/x' WHEN 2 THEN 'node-modules/x' ELSE 'a/x-txt' END AS slug FROM part")
def syncable_paths(spark, sf):
    r = F.col("p_partkey") % 4
    path = F.when(r == 0, "a/Small Ring.md").when(r == 1, ".hidden/x.md").when(r == 2, "node_modules/x.md").otherwise("a/x.txt")
    return table(spark, sf, "part").select("p_partkey", D.syncable(path).alias("sync"), D.slug_of(path).alias("slug"))


@query("s11_chat_exports", "SELECT conv_id, 'bracket' AS format, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, '2024-01-01' AS time, role AS speaker, text FROM conversations")
def chat_exports(spark, sf):
    c = table(spark, sf, "conversations").filter("text is not null")
    line = F.concat(F.lit("[2024-01-01] "), "role", F.lit(": "), "text")
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return D.chats(whole, "conv_id", "body")


@query("s15_table_rows", "SELECT n_regionkey AS k, n_name AS name FROM nation")
def table_rows(spark, sf):
    lines = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.concat(F.lit("text\n| Name | X |\n|---|:-:|\n"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("| "), "n_name", F.lit(" | 1 |")))), "\n")).alias("body"))
    return D.table_rows(lines, "k", "body").select("k", F.col("cells")[0].alias("name"))


@query("s16_fences", "SELECT doc_id, 'c | h | 0.5' AS inside, text AS rest FROM documents")
def fences(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("<!-- takes:begin -->\nc | h | 0.5\n<!-- takes:end -->\n"), "text").alias("t"))
    return d.select("doc_id", D.fenced(F.col("t"), "takes").alias("inside"), D.without_fence(F.col("t"), "takes").alias("rest"))


@query("s10_image_pages", "SELECT vec_id AS page_id, 'image' AS modality, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings WHERE label < 5")
def image_pages(spark, sf):
    """The multimodal embedding is an input column of an image page."""
    from fathomline.functions import vector as V

    return views.chunks(spark, sf).filter("page_id < 5").select(F.col("chunk_id").alias("page_id"), F.lit("image").alias("modality"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("r14_image_fusion", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q.e) AS c FROM embeddings, q), i AS (SELECT vec_id, 0.6::DOUBLE / (60 + row_number() OVER (ORDER BY c DESC, vec_id) - 1) AS p FROM s WHERE label < 5 QUALIFY row_number() OVER (ORDER BY c DESC, vec_id) <= 100), t AS (SELECT vec_id, 0.4::DOUBLE / (60 + row_number() OVER (ORDER BY c DESC, vec_id) - 1) AS p FROM s QUALIFY row_number() OVER (ORDER BY c DESC, vec_id) <= 100) SELECT vec_id AS chunk_id, round(sum(p), 8)::DOUBLE AS score FROM (SELECT * FROM i UNION ALL SELECT * FROM t) GROUP BY vec_id")
def image_fusion(spark, sf):
    """The best hundred image chunks and the best hundred of all, fused with weights of 0.6 and 0.4."""
    c = views.chunks(spark, sf)
    q = [float(x) for x in c.filter("chunk_id = 0").select("embedding").first()[0]]
    s = R.vector_scores(c, q).select("chunk_id", "page_id", "score")

    def part(d, weight):
        best = R.ranked(R.top(d, 100, F.desc("score"), F.asc("chunk_id")), ["chunk_id"])
        return best.select("chunk_id", (weight / (60 + F.col("rank"))).alias("p"))

    return part(s.filter("page_id < 5"), 0.6).union(part(s, 0.4)).groupBy("chunk_id").agg(F.round(F.sum("p"), 8).alias("score"))


@query("x1_recursive_chunks")
def recursive_chunks(spark, sf):
    return C.exploded(table(spark, sf, "documents"), "doc_id", "text")


#: Boundaries in each label's sequence of embeddings, as SQL (label, place): the similarity's slope turns up at a low place.
BOUNDARIES_SQL = """p AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings),
s AS (SELECT a.label, a.i, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM p a JOIN p b ON b.label = a.label AND b.i = a.i + 1),
l AS (SELECT label, sim AS low FROM (SELECT label, sim, row_number() OVER (PARTITION BY label ORDER BY sim) AS r, count(*) OVER (PARTITION BY label) AS n FROM s) WHERE r = floor((n - 1) * 0.2) + 1),
e AS (SELECT label, i, sim, lag(sim) OVER w AS last, coalesce(lag(sim) OVER w, sim) AS b1, coalesce(lag(sim, 2) OVER w, lag(sim) OVER w, sim) AS b2, coalesce(lead(sim) OVER w, sim) AS a1, coalesce(lead(sim, 2) OVER w, lead(sim) OVER w, sim) AS a2 FROM s WINDOW w AS (PARTITION BY label ORDER BY i)),
d AS (SELECT *, -0.2::DOUBLE * b2 - 0.1::DOUBLE * b1 + 0.1::DOUBLE * a1 + 0.2::DOUBLE * a2 AS slope FROM e),
t AS (SELECT label, i, sim, last, lag(slope) OVER (PARTITION BY label ORDER BY i) < 0 AND slope >= 0 AS turns FROM d),
c AS (SELECT t.label, i + CASE WHEN sim <= last THEN 1 ELSE 0 END AS place FROM t JOIN l ON l.label = t.label WHERE turns AND least(sim, last) <= low),
q AS (SELECT label, place FROM c QUALIFY coalesce(place - lag(place) OVER (PARTITION BY label ORDER BY place) >= 2, true))"""


@query("w15_semantic_boundaries", f"WITH {BOUNDARIES_SQL} SELECT label AS page_id, place AS boundary FROM q")
def semantic_boundaries(spark, sf):
    """Boundaries in each label's sequence of embeddings."""
    return clusters.semantic_boundaries(views.chunks(spark, sf), ["page_id"], "chunk_id", "embedding")


#: (file, source, symbols, calls and imports as from>to>kind) as a reader would list them; {n} is a part's number.
_SOURCES = [
    ("m{n}.py", "import os\nclass C:\n    def m{n}(self):\n        return f({n})\n\ndef f(x):\n    return x\n", ["C", "C.m{n}", "f"], [">os>imports", "C.m{n}>f>calls"]),
    ("m{n}.ts", "import { x } from './lib{n}';\n// function no() {}\nexport async function load{n}(p: string) {\n  const s = 'function none() {';\n  if (p) { read(p); }\n}\nexport class Store {\n  get(k: string): string {\n    return this.find(k);\n  }\n}\n", ["load{n}", "Store", "Store.get"], [">./lib{n}>imports", "load{n}>read>calls", "Store.get>find>calls"]),
    ("m{n}.go", 'package main\nimport "fmt"\ntype P{n} struct { X int }\nfunc (p *P{n}) Move(d int) { log(d) }\nfunc main() {\n\trun("a }")\n}\n', ["P{n}", "P{n}.Move", "main"], [">fmt>imports", "P{n}.Move>log>calls", "main>run>calls"]),
    ("m{n}.rs", "use std::fmt;\npub struct P{n} { x: i32 }\nimpl P{n} {\n    pub fn new(x: i32) -> P{n} { make(x) }\n}\nfn main() { show({n}); }\n", ["P{n}", "P{n}.new", "main"], [">std::fmt>imports", "P{n}.new>make>calls", "main>show>calls"]),
    ("M{n}.java", 'import java.util.List;\npublic class M{n} {\n    public static void main(String[] a) {\n        open("}");\n    }\n    int size() { return count(); }\n}\n', ["M{n}", "M{n}.main", "M{n}.size"], [">java.util.List>imports", "M{n}.main>open>calls", "M{n}.size>count>calls"]),
    ("m{n}.c", "#include <stdio.h>\nstruct point{n} { int x; };\nstatic int add(int a, int b) {\n  return plus(a, {n});\n}\n", ["point{n}", "add"], [">stdio.h>imports", "add>plus>calls"]),
    ("m{n}.cpp", "#include <vector>\nclass Shape{n} {\n public:\n  int area() const { return size(2); }\n};\nint Shape{n}::edge(int n) {\n  return count(n);\n}\n", ["Shape{n}", "Shape{n}.area", "Shape{n}.edge"], [">vector>imports", "Shape{n}.area>size>calls", "Shape{n}.edge>count>calls"]),
    ("M{n}.cs", "using System.Text;\nnamespace N {\n  public class Store{n} {\n    public string Get(string k) {\n      return Find(k);\n    }\n  }\n}\n", ["Store{n}", "Store{n}.Get"], [">System.Text>imports", "Store{n}.Get>Find>calls"]),
    ("m{n}.php", "<?php\nrequire \"lib{n}.php\";\nfunction top($a) { return helper($a); }\nclass Box {\n  public function open($k) {\n    return $this->find($k);\n  }\n}\n", ["top", "Box", "Box.open"], [">lib{n}.php>imports", "top>helper>calls", "Box.open>find>calls"]),
    ("m{n}.kt", "import kotlin.math.abs\nclass Car{n}(val n: Int) {\n    fun go(d: Int): Int {\n        return abs(d)\n    }\n}\nfun main() {\n    run({n})\n}\n", ["Car{n}", "Car{n}.go", "main"], [">kotlin.math.abs>imports", "Car{n}.go>abs>calls", "main>run>calls"]),
    ("m{n}.swift", "import Foundation\nstruct P{n} {\n    func move(by d: Int) -> Int {\n        return shift(d)\n    }\n}\nfunc top() { run() }\n", ["P{n}", "P{n}.move", "top"], [">Foundation>imports", "P{n}.move>shift>calls", "top>run>calls"]),
    ("m{n}.scala", "import scala.util.Try\nobject Main{n} {\n  def run(x: Int): Int = {\n    twice(x)\n  }\n}\n", ["Main{n}", "Main{n}.run"], [">scala.util.Try>imports", "Main{n}.run>twice>calls"]),
    ("notes{n}.txt", "no code at all: f({n})", [""], []),
]


def _labelled(which: int) -> str:
    """The reader's lists as a DuckDB table (i, x), {n} left in."""
    rows = [f"({i}, '{v}')" for i, s in enumerate(_SOURCES) for v in s[which]]
    return f"SELECT p_partkey, replace(x, '{{n}}', p_partkey::VARCHAR) AS found FROM part JOIN (VALUES {', '.join(rows)}) AS t(i, x) ON p_partkey % {len(_SOURCES)} = i"


def _parts(spark, sf):
    """The parts, dealt over all cores: their table is small beside the work of reading the code made of each."""
    return table(spark, sf, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)


def _code(spark, sf, f):
    """(p_partkey, found) for each symbol or edge that ``f`` finds in the sources of all parts."""
    rows = spark.createDataFrame([(i, s[0], s[1]) for i, s in enumerate(_SOURCES)], "i int, path string, source string")
    filled = lambda c: F.replace(F.col(c), F.lit("{n}"), F.col("p_partkey").cast("string")).alias(c)
    p = _parts(spark, sf).select("p_partkey", (F.col("p_partkey") % len(_SOURCES)).cast("int").alias("i"))
    files = p.join(F.broadcast(rows), "i").select("p_partkey", F.concat_ws("\n", filled("path"), filled("source")).alias("file"))
    split = lambda t: t.split("\n", 1)
    found = C.exploded(files, "p_partkey", "file", lambda t: f(split(t)[1], K.language_of(split(t)[0]) or "text"))
    return found.select("p_partkey", F.col("chunk_text").alias("found"))


@query("x3_code_chunks", _labelled(2))
def code_chunks(spark, sf):
    """Symbols of sources in five languages, and of one that is no code."""
    return _code(spark, sf, lambda t, language: [x["symbol"] for x in K.code_chunks(t, language)])


@query("x4_code_edges", _labelled(3))
def code_edges(spark, sf):
    """Their calls and imports."""
    return _code(spark, sf, lambda t, language: [">".join(e) for e in K.code_edges(t, language)])


#: A small repository for each part: (path, source, the reader's list of from>name>where it is defined>how).
_REPOSITORY = [
    ("p{n}/store.py", "from util{n} import clean\n\nclass Store{n}:\n    def get(self, k):\n        return self.find(clean(k))\n\n    def find(self, k):\n        return lone{n}(k)\n\ndef save(k):\n    return k\n", ["Store{n}.get>find>p{n}/store.py:Store{n}.find>class", "Store{n}.get>clean>p{n}/util{n}.py:clean>import", "Store{n}.find>lone{n}>p{n}/deep.py:lone{n}>unique"]),
    ("p{n}/util{n}.py", "def clean(k):\n    return save(k)\n\ndef save(k):\n    return k\n", ["clean>save>p{n}/util{n}.py:save>file"]),
    ("p{n}/deep.py", "def lone{n}(k):\n    return save(missing(k))\n", ["lone{n}>save>?>?", "lone{n}>missing>?>?"]),
    ("p{n}/web{n}.ts", "import { draw } from './view{n}';\nexport function page(x) {\n  return draw(x);\n}\nexport class Box {\n  open(k) {\n    return this.close(k);\n  }\n  close(k) {\n    return k;\n  }\n}\n", ["page>draw>p{n}/view{n}.ts:draw>import", "Box.open>close>p{n}/web{n}.ts:Box.close>class"]),
    ("p{n}/view{n}.ts", "export function draw(x) {\n  return x;\n}\n", []),
]


def _bindings() -> str:
    """The reader's list for every part, {n} filled in, as SQL."""
    rows = ", ".join(f"('{path}', '{x}')" for path, _, found in _REPOSITORY for x in found)
    return f"SELECT replace(path, '{{n}}', p_partkey::VARCHAR) AS file, replace(x, '{{n}}', p_partkey::VARCHAR) AS binding FROM part, (VALUES {rows}) AS t(path, x)"


@query("x4_bound_calls", _bindings())
def bound_calls(spark, sf):
    """Calls in a small repository for each part, bound to the definitions they mean: many functions are named save, clean, draw."""
    rows = F.broadcast(spark.createDataFrame([(path, source) for path, source, _ in _REPOSITORY], "path string, source string"))
    filled = lambda c: F.replace(F.col(c), F.lit("{n}"), F.col("p_partkey").cast("string"))
    parts = _parts(spark, sf).withColumn("x", F.lit(1)).join(rows.withColumn("x", F.lit(1)), "x")
    files = parts.select(filled("path").alias("file"), F.concat_ws("\n", filled("path"), filled("source")).alias("whole"))

    def told(t: str) -> list[str]:
        """A file's definitions and edges: both from one reading of it."""
        path, source = t.split("\n", 1)
        language = K.language_of(path) or "text"
        return ["\t".join(("", x["symbol"], "defines")) for x in K.code_chunks(source, language)] + ["\t".join(e) for e in K.code_edges(source, language)]

    part = F.split("chunk_text", "\t")
    # the joins below come back to this table many times: it is read from the files' texts once
    read = cut_lineage(C.exploded(files, "file", "whole", told).select("file", part[0].alias("from_symbol"), part[1].alias("to_symbol"), part[2].alias("kind")))
    out = code_graph.bound_calls(read.filter("kind = 'defines'").select("file", F.col("to_symbol").alias("symbol")), read.filter("kind <> 'defines'"))
    where = F.coalesce(F.concat_ws(":", F.col("to_file"), F.nullif("to_symbol", F.lit(""))), F.lit("?"))
    return out.select("file", F.concat_ws(">", "from_symbol", "name", F.when(F.col("to_file").isNull(), "?").otherwise(where), F.coalesce("way", F.lit("?"))).alias("binding"))


@query("f14_timeline_lines", "SELECT doc_id, '2024-01-0' || (1 + doc_id % 9) || '|met|more' AS entry FROM documents")
def timeline_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("- 2024-01-0"), (1 + F.col("doc_id") % 9).cast("string"), F.lit(": met\n   more\n- 2024-13-01: never\n")).alias("t"))
    return C.exploded(d, "doc_id", "t", lambda t: ["|".join(x) for x in C.timeline_lines(t)]).select("doc_id", F.col("chunk_text").alias("entry"))


# --- streaming operators on tables -----------------------------------------------------------------------------------


@query("t1_valid_events", "SELECT event_id FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 1")
def valid_events(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("source_kind"), F.when(F.col("event_id") % 5 == 1, "").otherwise("h").alias("content_hash"), F.col("props").alias("content"))
    return I.valid(e).select("event_id")


@query("t2_sliding_dedup", "SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) >= 86400000000")
def sliding_dedup(spark, sf):
    """The time to live slides, so an event is fresh when the one before it is a day old: one window is exact."""
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w))
    return table(spark, sf, "events").withColumn("gap", gap).filter(F.col("gap").isNull() | (F.col("gap") >= 86_400_000_000)).select("event_id")


def _steps(events: str, start: str, state: str, accepted: str) -> str:
    """A DuckDB recursion through each key's events in order: ``events`` has (k, event_id, t); state and verdict see ``w`` and ``t``."""
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS n FROM ({events})),
r AS (SELECT DISTINCT k, 0::BIGINT AS n, {start} AS w, NULL::BIGINT AS event_id, false AS ok FROM e
      UNION ALL SELECT r.k, e.n, {state} AS w, e.event_id, {accepted} AS ok FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1)
SELECT event_id FROM r WHERE ok"""


_EVENTS = "SELECT {k} AS k, event_id, epoch_us(ts::TIMESTAMP) / 1e6::DOUBLE AS t FROM {source}"


def _rate(events: str, limit: int, seconds: float) -> str:
    live = f"list_filter(w, lambda x: t - x < {seconds}::DOUBLE)"
    return _steps(events, "[]::DOUBLE[]", f"CASE WHEN len({live}) < {limit} THEN list_append({live}, t) ELSE {live} END", f"len({live}) < {limit}")


def _throttle(events: str, seconds: float) -> str:
    fresh = f"(w IS NULL OR t - w >= {seconds}::DOUBLE)"
    return _steps(events, "NULL::DOUBLE", f"CASE WHEN {fresh} THEN t ELSE w END", fresh)


@query("t3_rate_limit", _rate(_EVENTS.format(k="event_type", source="events"), 3, 3600))
def rate_limit(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return I.stateful_batch(e, ["event_type"], "rate", limit=3, seconds=3600.0).select("event_id")


_LIVE = "(SELECT * FROM (SELECT *, epoch_us(ts::TIMESTAMP) - lag(epoch_us(ts::TIMESTAMP)) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS gap FROM events WHERE event_type <> 'error' AND props IS NOT NULL AND user_id IS NOT NULL) WHERE gap IS NULL OR gap >= 86400000000)"


@query("t4_ingest_modes", _rate(_EVENTS.format(k="event_type", source=_LIVE), 100, 10) + " UNION ALL SELECT event_id FROM events WHERE event_type = 'error' AND props IS NOT NULL AND user_id IS NOT NULL")
def ingest_modes(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("source_kind"), F.col("user_id").cast("string").alias("content_hash"), F.col("props").alias("content"), "ts")
    return I.ingest_batch(e, "source_kind", ["source_kind", "content_hash"], ["error"]).select("event_id")


@query("t7_job_claim", f"{with_views('jobs')} SELECT id, priority, (row_number() OVER (ORDER BY priority, created_at, id) - 1)::INT AS worker FROM jobs_v WHERE status = 'waiting' QUALIFY row_number() OVER (ORDER BY priority, created_at, id) <= 16")
def job_claim(spark, sf):
    return I.claim(views.jobs(spark, sf), 16).select("id", "priority", "worker")


@query(
    "t8_job_transitions",
    "WITH j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'delayed' WHEN 'P' THEN 'active' ELSE 'completed' END AS status, o_orderkey % 4 AS attempts, o_orderdate AS at_ FROM orders) SELECT id, CASE WHEN status = 'delayed' AND at_ <= TIMESTAMP '1999-01-01' THEN 'waiting' WHEN status = 'active' AND at_ + INTERVAL 700 DAY < TIMESTAMP '1999-01-01' THEN 'failed' WHEN status = 'active' AND at_ < TIMESTAMP '1999-01-01' AND attempts + 1 >= 3 THEN 'dead' WHEN status = 'active' AND at_ < TIMESTAMP '1999-01-01' THEN 'waiting' ELSE status END AS next_status, (attempts + (status = 'active' AND at_ < TIMESTAMP '1999-01-01')::INT)::BIGINT AS next_attempts FROM j",
)
def job_transitions(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "delayed").when(F.col("o_orderstatus") == "P", "active").otherwise("completed")
    at = F.col("o_orderdate").cast("timestamp")
    j = o.select(F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_orderkey") % 4).alias("attempts"), at.alias("delay_until"), at.alias("lock_until"), F.timestamp_add("DAY", F.lit(700), at).alias("timeout_at"))
    return I.job_transitions(j, "1999-01-01 00:00:00").select("id", "next_status", "next_attempts")


@query("t9_backoff", "SELECT l_orderkey, l_linenumber, least(5.0 * power(2, l_linenumber - 1), 60) AS delay FROM lineitem")
def backoff(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", A.backoff_seconds("exponential", F.col("l_linenumber"), 5.0, 60.0).alias("delay"))


@query("t10_parents_done", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')")
def parents_done(spark, sf):
    still = table(spark, sf, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(still, "o_orderkey", "left_anti").select("o_orderkey")


@query("t11_minute_rollup", "SELECT date_trunc('minute', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def minute_rollup(spark, sf):
    return I.rollup(table(spark, sf, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("t12_throttle", _throttle(_EVENTS.format(k="user_id", source="events"), 6 * 3600))
def throttle(spark, sf):
    return I.stateful_batch(table(spark, sf, "events").select("event_id", "user_id", "ts"), ["user_id"], "throttle", seconds=6 * 3600.0).select("event_id")


@query("t13_cooldown", _throttle(_EVENTS.format(k="user_id || '|' || event_type", source="events"), 3 * 86400))
def cooldown(spark, sf):
    return I.stateful_batch(table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "throttle", seconds=3 * 86400.0).select("event_id")


@query("t14_resume_cursor", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id <= 9000)")
def resume_cursor(spark, sf):
    e = table(spark, sf, "events")
    last = e.filter("event_id <= 9000").agg(F.max("ts")).first()[0]
    return e.filter(F.col("ts") > F.lit(last)).select("event_id")


@query("t15_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, sf):
    return I.sessions(table(spark, sf, "events"))
