"""The query compiler: a question and its knobs become a frozen plan, and the plan one DataFrame.

Everything that depends on the question alone (dates, intent, weights, expansion, the seed of a relation question) is
settled on the driver. ``run_search`` then builds, in this order: keyword lists of all variants (from a kept index or the postings
where the corpus has them, else by a scan), the vector list and the relation list; their weighted fusion; the boosts, gated by one
floor; text de-duplication and type diversity of the head; the alias hop; reranking and its cut-off; evidence; offset,
limit and token budget. What stands after the fusion works on a checkpointed list of some hundred rows, so the corpus is read
once for each list.

``expand``, ``rerank`` and ``embed`` are pluggable functions; one that fails leaves the plan or the ranking as it is.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import graph as G
from fathomline.operators import ranking as M
from fathomline.operators import retrieval as R
from fathomline.operators import scope
from fathomline.operators import text_index as TI
from fathomline.operators import vector_index as VI
from fathomline.session import cut_lineage

# Weights of the keyword and the vector list by intent.
INTENT_WEIGHTS = {"entity": (1.2, 0.8), "temporal": (1.0, 1.0), "event": (1.1, 0.9), "general": (1.0, 1.0)}

# Relation questions: pattern -> (link type, direction from the seed). No type: links of any. Callers may add their own.
RELATIONS: dict[str, tuple[str | None, str]] = {
    r"who (?:works|worked|is working) (?:at|for) (?P<seed>.+)": ("works_at", "in"),
    r"who (?:at|in|from|of) (?P<seed>.+?) (?:works|leads|runs|builds|owns|handles|manages|looks after)\b.*": ("works_at", "in"),
    r"who (?:invested|invests|put money) in(?:to)? (?P<seed>.+)": ("invested_in", "in"),
    r"who (?:founded|started|set up) (?P<seed>.+)": ("founded", "in"),
    r"who (?:advises|advised|is advising) (?P<seed>.+)": ("advises", "in"),
    r"who (?:attended|was at|came to|joined) (?P<seed>.+)": ("attended", "out"),
    r"what is located in (?P<seed>.+)": ("located_in", "in"),
    r"where (?:does|did|has) (?P<seed>.+?) (?:work|worked)": ("works_at", "out"),
    r"(?:what|which)(?: companies| firms| deals)? (?:did|does|has|have) (?P<seed>.+?) (?:invest|invested|put money) in(?:to)?": ("invested_in", "out"),
    r"(?:what|which)(?: companies| firms)? (?:did|has) (?P<seed>.+?) (?:found|founded|start|started|set up)": ("founded", "out"),
    r"(?:who|whom|what) (?:does|did) (?P<seed>.+?) advise": ("advises", "out"),
    r"who (?:introduced|referred|led) (?:me|us|him|her|them) to (?P<seed>.+)": (None, "both"),
}
# Questions for what lies between two seeds.
CONNECTIONS = (
    r"(?:what|who|which \w+) (?:connects|connect|links|link|ties|joins) (?P<seed>.+?) (?:and|to|with|&) (?P<other>.+)",
    r"how (?:is|are|do|does) (?P<seed>.+?) (?:and|to|with|&) (?P<other>.+?) (?:connected|related|linked|know each other)",
    r"what is the (?:connection|link|relation|relationship) between (?P<seed>.+?) (?:and|&) (?P<other>.+)",
)

#: Rows of a list that go into the fusion at most.
LIST_MOST = 100
#: What two words of a question that stand side by side add to a page's keyword score (a word of the title: up to 1), from a kept index.
NEAR_WEIGHT = 0.2
#: Nearest chunks that are taken from a vector index for each page of a list.
CHUNKS_A_PAGE = 4
#: Seeds of a relation question and hops from them.
SEEDS, HOPS = 3, 2
#: Nodes of a hop on either side of a question about two seeds at most.
CONNECTION_CAP = 1000


@dataclass(frozen=True)
class SearchPlan:
    query: str
    intent: str
    variants: tuple[str, ...]
    limit: int
    offset: int
    since: dt.datetime | None
    until: dt.datetime | None
    weights: tuple[float, float]
    detail: str = "medium"
    budget: int | None = None
    relation: tuple[str, str | None, str] | None = None
    connection: tuple[str, str] | None = None
    excludes: tuple[str, ...] = field(default=scope.HARD_EXCLUDES)
    now: dt.datetime | None = None
    salience: str = "off"
    recency: str = "off"
    floor_ratio: float | None = None
    vector: tuple[float, ...] | None = None


@dataclass(frozen=True)
class Corpus:
    """The tables of a search; all but the pages may be missing, and what needs them is left out."""

    pages: DataFrame
    #: (page_id, chunk_id, embedding)
    chunks: DataFrame | None = None
    #: (src, dst, link_type, link_source) between slugs
    links: DataFrame | None = None
    #: (alias_norm, source_id, slug)
    aliases: DataFrame | None = None
    #: (page_id, salience)
    salience: DataFrame | None = None
    #: (page_id, term, class, tf) of the pages: class A is the title, B the body
    postings: DataFrame | None = None
    #: A kept index of the pages' words by page_id, classes as in ``postings``, and of the chunks' embeddings by chunk_id
    words: TI.TextIndex | None = None
    vectors: VI.VectorIndex | None = None


def classify(query: str) -> str:
    return next((name for name, p in T.INTENTS if re.search(p, query.lower())), "general")


def verb_relations(verbs: dict[str, tuple[str, str]], known: set[str]) -> dict[str, tuple[str, str]]:
    """Relation patterns "who <verb> <seed>" for extra verbs (verb -> (link type, direction)); unknown link types are an error."""
    for verb, (kind, direction) in verbs.items():
        if kind not in known:
            raise ValueError(f"verb {verb!r} stands for the unknown link type {kind!r}; known are {', '.join(sorted(known))}")
        if direction not in ("in", "out", "both"):
            raise ValueError(f"verb {verb!r} has the unknown direction {direction!r}")
    return {rf"who (?:{verb}) (?P<seed>.+)": value for verb, value in verbs.items()}


def clean_seed(text: str) -> str:
    """A seed without blanks and quotes around it and without a leading article."""
    return re.sub(r"^(?:the|a|an)\s+", "", text.strip().strip("\"'`").strip(), flags=re.IGNORECASE).strip("\"'` ")


def relation_of(query: str, relations: dict[str, tuple[str | None, str]] = RELATIONS) -> tuple[str, str | None, str] | None:
    """(seed, link type, direction) of a relation question."""
    for pattern, (kind, direction) in relations.items():
        if m := re.fullmatch(pattern, query.strip().rstrip("?").strip(), re.IGNORECASE):
            seed = clean_seed(m["seed"])
            return (seed, kind, direction) if 0 < len(seed) <= 80 else None
    return None


def connection_of(query: str) -> tuple[str, str] | None:
    """The two seeds of a question for what connects them."""
    for pattern in CONNECTIONS:
        if m := re.fullmatch(pattern, query.strip().rstrip("?").strip(), re.IGNORECASE):
            seeds = clean_seed(m["seed"]), clean_seed(m["other"])
            return seeds if all(0 < len(x) <= 80 for x in seeds) else None
    return None


def compile_search(
    query: str,
    now: dt.datetime,
    limit: int | None = None,
    offset: int = 0,
    since: str | None = None,
    until: str | None = None,
    detail: str = "medium",
    budget: int | None = None,
    expand: Callable[[str], list[str]] | None = None,
    embed: Callable[[str], list[float]] | None = None,
    relations: dict[str, tuple[str, str]] | None = None,
    salience: str = "off",
    recency: str | None = None,
    floor_ratio: float | None = None,
) -> SearchPlan:
    """``relations`` adds question patterns to the built-in ones; ``recency`` is on for temporal questions unless given."""
    a, b = scope.date_window(since, until, now)
    intent = classify(query)
    try:
        more = [re.sub(r"[^\w\s'-]", " ", x).strip() for x in (expand(query) if expand else [])]
    except Exception:  # expansion is an extra: the question alone is still a plan
        more = []
    try:
        vector = tuple(float(x) for x in embed(query)) if embed else None
    except Exception:  # without a vector the keyword lists are still a search
        vector = None
    variants = tuple(dict.fromkeys([query, *[x for x in more if x]]))[:3]
    connection = connection_of(query)
    relation = None if connection else relation_of(query, {**RELATIONS, **(relations or {})})
    recency = recency or ("on" if intent == "temporal" else "off")
    return SearchPlan(query, intent, variants, scope.clamp_limit(limit), max(0, offset), a, b, INTENT_WEIGHTS[intent], detail, budget, relation, connection, now=now, salience=salience, recency=recency, floor_ratio=floor_ratio, vector=vector)


def seeds_of(seed: str, corpus: Corpus, pages: DataFrame) -> DataFrame:
    """The pages (as ``node``) that a question's seed names: by title, slug or alias."""
    name = F.lit(" ".join(seed.lower().split()))
    slug = F.lit(re.sub(r"[^a-z0-9]+", "-", seed.lower()).strip("-"))
    named = pages.filter((F.lower(F.trim("title")) == name) | (T.basename(F.col("slug")) == slug)).select("slug")
    if corpus.aliases is not None:
        named = named.unionByName(corpus.aliases.filter(F.regexp_replace("alias_norm", "^(the|an?) ", "") == name).select("slug"))
    return R.top(named.distinct(), SEEDS, F.asc("slug")).select(F.col("slug").alias("node"))


def relation_list(plan: SearchPlan, corpus: Corpus, pages: DataFrame) -> DataFrame:
    """(page_id, score) of the pages that the relation question's seed is linked with, nearest and best linked first.

    For a question about two seeds, of the pages between them, by the length of the way.
    """
    if plan.connection is not None:
        ends = [cut_lineage(seeds_of(seed, corpus, pages)) for seed in plan.connection]
        near = G.meeting(corpus.links, *ends, HOPS, CONNECTION_CAP)
        return near.join(pages.select("page_id", F.col("slug").alias("node")), "node").select("page_id", (1 / F.col("hops")).alias("score"))
    seed, kind, direction = plan.relation
    found = G.fanout(corpus.links, seeds_of(seed, corpus, pages), HOPS, None if kind is None else [kind], direction)
    near = found.join(pages.select("page_id", F.col("slug").alias("node")), "node")
    return near.select("page_id", (1 / F.col("hop") + F.col("edge_count") * 1e-6).alias("score"))


def boosted(plan: SearchPlan, corpus: Corpus, fused: DataFrame) -> DataFrame:
    """The fused list with all boosts, each for rows that reach the one floor."""
    out = M.floor_threshold(fused, plan.floor_ratio).withColumn("base_score", F.col("score"))
    if corpus.links is not None:
        nodes = out.select(F.col("slug").alias("node"), "source_id")
        counts = G.backlink_counts(nodes.select("node").distinct(), corpus.links.join(F.broadcast(nodes.select(F.col("node").alias("dst")).distinct()), "dst", "left_semi"))
        out = M.boost(out.join(F.broadcast(counts.withColumnRenamed("node", "slug")), "slug", "left"), M.backlink_factor(F.coalesce("n", F.lit(0)))).drop("n")
    if corpus.salience is not None and plan.salience != "off":
        out = M.boost(out.join(corpus.salience, "page_id", "left"), M.salience_factor(F.coalesce("salience", F.lit(0.0)), plan.salience == "strong")).drop("salience")
    if plan.recency != "off" and plan.now is not None:
        days = (F.lit(plan.now).cast("timestamp").cast("double") - F.coalesce("effective_date", "updated_at").cast("double")) / 86400
        out = M.boost(out, F.coalesce(M.recency_factor(F.col("slug"), days, plan.recency == "strong"), F.lit(1.0)))
        out = M.boost(out, M.chronicle_factor(F.col("type"), plan.recency == "strong"))
    out = M.boost(out, M.title_factor(F.col("title"), F.lit(plan.query)))
    if corpus.links is not None:
        near = G.adjacency(out.select(F.col("slug").alias("node"), "source_id"), corpus.links).withColumnRenamed("node", "slug")
        with_hits = out.join(F.broadcast(near), "slug", "left").fillna(0, ["hits", "cross_hits"]).withColumn("session", F.regexp_extract("slug", r"^(.*/sessions/[^/]+)/", 1))
        out = M.graph_signals(with_hits.withColumn("session", F.nullif("session", F.lit("")))).drop("hits", "cross_hits", "session")
    if corpus.aliases is not None:
        canonical = corpus.aliases.select("source_id", "slug").distinct().withColumn("named", F.lit(True))
        out = M.boost(out.join(canonical, ["source_id", "slug"], "left"), F.when(F.col("named"), 1.05).otherwise(1.0)).drop("named")
    return M.boost(out, M.exact_factor(F.col("slug"), F.col("title"), plan.query, plan.intent)).drop("floor")


def run_search(plan: SearchPlan, corpus: Corpus, rerank: Callable[[str], float] | None = None) -> DataFrame:
    """Ranked pages (page_id, source_id, slug, title, score, base_score, evidence, safety)."""
    pages = scope.in_window(scope.hard_exclude(corpus.pages.filter("deleted_at is null"), prefixes=plan.excludes), plan.since, plan.until)
    inner = min(LIST_MOST, 2 * (plan.limit + plan.offset))
    best = lambda d: R.top(d.select("page_id", F.round("score", 9).alias("score")), inner, F.desc("score"), F.asc("page_id"))
    classes = {"A": F.col("title"), "B": F.col("compiled_truth")} if plan.detail != "low" else {"A": F.col("title")}
    factor = scope.prefix_case(F.col("slug"), scope.SOURCE_FACTORS) if plan.detail != "high" else F.lit(1.0)

    def words(variant: str) -> DataFrame:
        if corpus.words is not None:
            found = TI.scores(pages.sparkSession, corpus.words, variant, list(classes), NEAR_WEIGHT)
            return pages.select("page_id", "slug").join(found.withColumnRenamed("key", "page_id"), "page_id")
        if corpus.postings is None:
            return R.keyword_scores(pages, variant, ["page_id", "slug"], classes)
        found = R.indexed_scores(corpus.postings.filter(F.col("class").isin(*classes)), variant, ["page_id"])
        return R.with_phrases(found.join(pages.select("page_id", "slug", "title", "compiled_truth"), "page_id"), variant, classes).select("page_id", "slug", "score")

    lists = [(best(words(v).withColumn("score", F.col("score") * factor)), plan.weights[0]) for v in plan.variants]
    if corpus.chunks is not None and plan.vector is not None:
        if corpus.vectors is None:
            near = R.vector_scores(corpus.chunks, list(plan.vector)).select("page_id", "chunk_id", "score")
        else:
            some = VI.nearest(pages.sparkSession, corpus.vectors, list(plan.vector), LIST_MOST * CHUNKS_A_PAGE).withColumnRenamed("id", "chunk_id")
            near = corpus.chunks.select("page_id", "chunk_id").join(F.broadcast(some), "chunk_id")
        found = near.join(pages.select("page_id"), "page_id", "left_semi")
        lists.append((best(R.best_per(found, ["page_id"], [F.desc("score"), F.asc("chunk_id")])), plan.weights[1]))
    if (plan.relation is not None or plan.connection is not None) and corpus.links is not None:
        lists.append((best(relation_list(plan, corpus, pages)), 1.0))
    shown = ["page_id", "source_id", "slug", "title", "type", "effective_date", "updated_at"]
    fused = R.rrf(lists, ["page_id"]).join(pages.select(*shown, F.col("compiled_truth").alias("text")), "page_id")
    # some hundred rows, which the steps from here on read several times
    out = cut_lineage(boosted(plan, corpus, cut_lineage(fused)))
    out = out.withColumn("rank", F.row_number().over(R.W.orderBy(F.desc("score"), F.asc("page_id")))).withColumn("whole", F.lit(1))
    out = M.diversify(M.text_dedup(out, "whole"), "type").drop("rank", "whole")
    out = out.withColumn("alias_hit", F.lit(False))
    if corpus.aliases is not None:
        hop = R.alias_hop(out.select("source_id", "slug", "score"), corpus.aliases, " ".join(plan.query.lower().split()))
        again = pages.select(*shown, F.col("compiled_truth").alias("text"))
        out = hop.join(out.select("source_id", "slug", "base_score"), ["source_id", "slug"], "left").withColumn("base_score", F.coalesce("base_score", "score")).join(again, ["source_id", "slug"])
    order = [F.desc("score"), F.asc("page_id")]
    if rerank is not None:
        out = R.rerank(out, rerank, LIST_MOST, 2 * LIST_MOST, order)
        out = M.autocut(out)
        order = [F.desc_nulls_last("rerank_score"), *order]
    exact = M.exact_factor(F.col("slug"), F.col("title"), plan.query, "entity") > 1
    out = out.withColumn("evidence", M.evidence(F.col("alias_hit"), exact, F.col("base_score"))).withColumn("safety", M.create_safety(F.col("evidence")))
    out = M.page_of(out, plan.offset, plan.limit, *order)
    if plan.budget is not None:
        out = M.token_budget(out, plan.budget, order).drop("spent")
    return out.select("page_id", "source_id", "slug", "title", "score", "base_score", "evidence", "safety")
