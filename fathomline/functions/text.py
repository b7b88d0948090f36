"""Text expressions: tokens, trigrams, estimates, patterns. JVM expressions unless marked."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN_GAP = r"[^\p{L}\p{N}]+"


def tokens(col: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), TOKEN_GAP), lambda x: x != "")


def arrow_tokens(lowered: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens`` of texts that are lower-cased already, inside a task: the words of all texts in order, and each one's text.

    Letters that are newer than the JVM's tables (Unicode 13) are letters here, as in SQL.
    """
    lists = pc.split_pattern(pc.replace_substring_regex(lowered, TOKEN_GAP, " "), " ")
    words, text = lists.flatten(), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    some = pc.not_equal(words, "")
    return words.filter(some), text[np.asarray(some)]


def token_estimate(col: Column) -> Column:
    """One token for four characters, rounded up."""
    return F.ceil(F.length(F.coalesce(col, F.lit(""))) / 4).cast("long")


def trigrams(col: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one behind."""
    padded = F.transform(tokens(col), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def set_similarity(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


#: Texts of a batch that are Python objects at once.
_AT_ONCE = 64


def _each(one: Callable[[str], str], texts: pa.Array) -> pa.Array:
    """``one`` of every text, nulls kept; of a batch a few texts at a time are more than Arrow's bytes."""
    parts = [pa.array([None if x is None else one(x) for x in texts.slice(i, _AT_ONCE).to_pylist()], pa.string()) for i in range(0, len(texts), _AT_ONCE)]
    return pa.concat_arrays(parts or [pa.array([], pa.string())])


@F.arrow_udf(StringType())
def normalize_alias(texts: pa.Array) -> pa.Array:
    """NFKC, lower case, white space collapsed, quotes and brackets taken off the ends (Arrow UDF: no built-in does NFKC)."""
    return _each(lambda x: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).lower()).strip().strip("\"'`“”‘’()[]{}<>").strip(), texts)


def _slug(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "-", bare.lower()).strip("-")


@F.arrow_udf(StringType())
def slugify(texts: pa.Array) -> pa.Array:
    """Marks stripped after NFKD, everything but letters and digits to single hyphens (Arrow UDF)."""
    return _each(_slug, texts)


CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯]"


def cjk_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(CJK))


def countable_size(col: Column) -> Column:
    """Words, or characters where at least three tenths of the non-blank ones are CJK."""
    bare = F.regexp_replace(col, r"\s+", "")
    dense = cjk_count(col) * 10 >= F.length(bare) * 3
    return F.when((F.length(bare) > 0) & dense, F.length(bare)).otherwise(F.size(F.filter(F.split(col, r"\s+"), lambda x: x != "")))


def content_hash(*cols: Column) -> Column:
    """SHA-256 of the JSON array of the fields, nulls as empty texts."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 256)


def without_code(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"(?s)```.*?```", " "), r"`[^`\n]*`", " ")


def markdown_links(col: Column) -> Column:
    """(text, target) of each markdown link."""
    found = F.regexp_extract_all(col, F.lit(r"\[([^\]\n]+)\]\(([^)\s]+)\)"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]+)\]", 1).alias("text"), F.regexp_extract(x, r"\(([^)]+)\)$", 1).alias("target")))


def wiki_links(col: Column) -> Column:
    """(source or null, slug) of each wiki link, ``[[source:slug|label]]``."""
    found = F.regexp_extract_all(col, F.lit(r"\[\[([^\]|\n]+)(?:\|[^\]\n]*)?\]\]"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.nullif(F.regexp_extract(x, r"^([a-z0-9-]+):", 1), F.lit("")).alias("source"), F.regexp_replace(x, r"^[a-z0-9-]+:", "").alias("slug")))


def code_references(col: Column) -> Column:
    """Paths with an optional line, like ``src/a.py:12``."""
    return F.regexp_extract_all(col, F.lit(r"\b((?:[\w.-]+/)+[\w.-]+\.[a-z]{1,4}(?::\d+)?)"), F.lit(1))


# Phrases by which a link's type is told: rows of slots, each a choice of words, or a number of further words at most.
_FOUNDING = [
    [("founded", "cofounded", "co-founded", "incorporated", "established", "cofounding", "co-founding")],
    [("founder", "founders", "cofounder", "cofounders", "co-founder", "co-founders")],
    [("started", "starts", "launched", "created", "built"), 2, ("company", "business", "firm", "startup", "start-up")],
]
_INVESTING = [
    [("invest", "invests", "invested", "investing", "investment", "investments", "investor", "investors", "stake", "stakes", "shareholder"), ("in", "of")],
    [("backed", "funded", "financed"), ("by",)],
    [("funding", "capital", "money", "raised", "raises"), 3, ("from",)],
    [("led", "leads", "leading", "joined", "closed", "anchored"), 4, ("round", "seed", "series", "financing", "investment")],
    [("part", "participated", "participates"), ("in",), 2, ("round", "seed", "series", "financing")],
    [("wrote", "writes", "sent", "signed", "cut"), 2, ("check", "checks", "cheque", "cheques")],
    [("first", "early", "angel", "seed"), ("check", "cheque", "investor", "investors", "backer", "backers")],
    [("portfolio",), ("company", "companies", "includes", "firm")],
    [("board",), ("seat", "seats"), ("at", "in", "on", "of", "with")],
    [("term",), ("sheet", "sheets")],
]
_ADVISING = [
    [("advise", "advises", "advised", "advising", "consults", "consulted", "consulting", "mentors"), 1, ("for", "with", "to", "on", "at", "the", "several", "many")],
    [("advises", "advised")],
    [("adviser", "advisor", "advisers", "advisors"), ("to", "at", "for", "of", "with")],
    [("as",), ("a", "an", "its", "their", "the"), 2, ("adviser", "advisor", "consultant")],
    [("board", "advisory"), ("adviser", "advisor", "board", "role", "roles", "work", "contract", "post", "position", "capacity")],
]
_CHIEFS = ("ceo", "cto", "coo", "cfo", "cmo", "cro", "president", "vp", "head", "director", "chief")
_STAFF = ("engineer", "developer", "designer", "scientist", "analyst", "manager", "lead", "architect", "researcher", "employee")
_FIELDS = ("engineering", "product", "design", "sales", "research", "marketing", "operations", "team", "org", "group")
_WORKING = [
    [_CHIEFS, 1, ("of", "at", "for")],
    [_STAFF, ("at", "for", "with", "in")],
    [("work", "works", "worked", "working", "employed", "hired", "job", "role", "position", "post", "stint", "tenure", "internship"), 1, ("at", "by", "as", "for")],
    [("leads", "led", "heads", "headed", "runs", "running", "manages", "managed"), 3, _FIELDS],
    [("joined", "joins"), ("as", "the team")],
    [("promoted",), ("to",)],
    [("spent", "spends"), 4, ("at",)],
    [("currently", "previously", "formerly"), 3, ("at",)],
    [("my", "his", "her", "their"), ("time", "days", "years"), ("at", "with")],
]
#: In order of precedence.
LINK_PHRASES = {"founded": _FOUNDING, "invested_in": _INVESTING, "advises": _ADVISING, "works_at": _WORKING}
# Phrases of a person's page that tell what the person is, in order of precedence.
_IS = ("is", "was", "became", "serves", "served", "works", "worked", "stayed")
ROLE_PHRASES = {
    "invested_in": [
        [("partner", "principal", "investor", "associate"), ("at", "of", "in", "with")],
        [("venture",), ("partner", "capital", "capitalist", "fund", "investor")],
        [("seed", "angel", "early-stage"), ("investor", "investing", "fund")],
        [("invests", "invested"), ("early", "across", "in")],
        [("backs", "funds", "portfolio")],
    ],
    "advises": [
        [_IS, 4, ("adviser", "advisor", "consultant")],
        [("advises",), ("multiple", "several", "various", "many", "a", "young")],
        [("advisory",), ("work", "role", "roles", "board", "practice")],
        [("full-time", "professional", "independent"), ("adviser", "advisor")],
    ],
    "works_at": [
        [_IS, 4, (*_STAFF, *_CHIEFS), 2, ("at", "of", "for")],
        [("holds", "held"), 2, _CHIEFS],
        [("employee", "team"), ("at", "of")],
        [("works", "worked"), 5, ("at", "for")],
    ],
}
# Page types whose links are all of one type.
TYPE_LINKS = {"media": "mentions", "image": "image_of", "meeting": "attended"}


def _any_of(phrases: list[list[tuple[str, ...] | int]]) -> str:
    """A pattern that finds any of the phrases, in either case."""

    def one(slots: list[tuple[str, ...] | int]) -> str:
        parts = [rf"(?:\S+\s+){{0,{slot}}}" if isinstance(slot, int) else rf"(?:{'|'.join(slot)})\b\s*" for slot in slots]
        return "".join(parts).removesuffix(r"\s*")

    return rf"(?i)\b(?:{'|'.join(map(one, phrases))})"


def link_type(context: Column, page_type: Column | None = None, page_text: Column | None = None, target: Column | None = None) -> Column:
    """The type of a link: by its page's type, else by the words around it, else by the role that a person's page states."""
    out = F
    for kind, name in TYPE_LINKS.items() if page_type is not None else ():
        out = out.when(page_type == kind, name)
    for name, phrases in LINK_PHRASES.items():
        out = out.when(context.rlike(_any_of(phrases)), name)
    if page_type is not None and page_text is not None and target is not None:
        person = (page_type == "person") & target.startswith("companies/")
        for name, phrases in ROLE_PHRASES.items():
            out = out.when(person & page_text.rlike(_any_of(phrases)), name)
    return out.otherwise("mentions")


def scrub(col: Column) -> Column:
    """E-mail, phone, social-security numbers, tokens, bearer headers, then card numbers that pass Luhn's check."""
    for pattern, mark in (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
        (r"(?<![\w.])\+?\d{1,3}[ .-]?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)", "[PHONE]"),
        (r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", "[SSN]"),
        (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[JWT]"),
        (r"(?i)bearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer [TOKEN]"),
    ):
        col = F.regexp_replace(col, pattern, mark)
    return scrub_cards(col)


def luhn(digits: Column) -> Column:
    """Luhn's check of a text of digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def scrub_cards(col: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(col, F.lit(r"(?<!\d)(\d(?:[ -]?\d){12,18})(?!\d)"), F.lit(1)))
    cards = F.filter(found, lambda x: luhn(F.regexp_replace(x, "[ -]", "")))
    return F.aggregate(cards, col, lambda text, card: F.replace(text, card, F.lit("[CARD]")))


def dates_in(col: Column) -> Column:
    """Real calendar days written as yyyy-mm-dd."""
    return F.filter(F.transform(F.regexp_extract_all(col, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)), lambda x: F.try_to_date(x, "yyyy-MM-dd")), lambda d: d.isNotNull())


def html_text(col: Column) -> Column:
    """Visible text of an HTML body: scripts, styles and tags off, breaks kept, entities decoded."""
    out = F.regexp_replace(col, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?i)<(br|/p|/div|/li|/h[1-6])\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(to))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def grid_weight(col: Column) -> Column:
    """Clamped to 0..1 and rounded half up to steps of 0.05."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), col)) * 20 + 0.5) / 20


def contextual(title: Column, heading: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.nullif(F.concat_ws(" > ", F.nullif(title, F.lit("")), F.nullif(heading, F.lit(""))), F.lit("")), body)


def handles(col: Column) -> Column:
    """@handles and runs of capitalised words."""
    return F.array_distinct(F.concat(F.regexp_extract_all(col, F.lit(r"(?:^|\s)(@[A-Za-z0-9_]{2,})"), F.lit(1)), F.regexp_extract_all(col, F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)"), F.lit(1))))


def basename(col: Column) -> Column:
    return F.element_at(F.split(col, "/"), -1)


INTENTS = (
    ("temporal", r"\b(when|last (week|month|year)|yesterday|recent(ly)?|latest|since)\b"),
    ("event", r"\b(meeting|call|event|conference|dinner)\b"),
    ("entity", r"\b(who is|who's|tell me about|profile of)\b"),
)


def intent(col: Column) -> Column:
    """temporal, event, entity or general: the first pattern that fits."""
    out = None
    for name, pattern in INTENTS:
        hit = F.lower(col).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


# Phrases by which a question tells how fresh, how weighty and of what kind its answers should be.
_ANSWERS = [
    [("who", "what"), ("is", "are", "was", "does", "means")],
    [("define", "definition", "meaning", "overview", "background", "origin", "history", "concept"), ("of",)],
    [("explain",), ("how", "what", "why")],
    [("tell",), ("me",), ("about",)],
]
_THIS_MOMENT = [[("today", "tonight")], [("right", "just"), ("now",)], [("this",), ("morning", "afternoon", "evening")]]
_BOUNDED = [*_THIS_MOMENT, [("this",), ("week", "month")], [("since",), 1, ("yesterday", "last", "launch", "monday", "january", "2024", "2025", "2026")], [("last", "past"), 1, ("day", "days", "weeks", "months")]]
_MEETINGS = [[("prep", "prepare", "brief"), ("for", "me")], [("before",), ("my", "the", "our"), ("meeting", "call", "sync", "chat")], [("catch", "catching"), 3, ("up",)], [("remind",), ("me",)], [("update", "status", "progress"), ("on", "from", "with")], [("going",), ("on",)]]
_LATELY = [*_MEETINGS, [("latest", "recent", "recently", "currently", "lately", "newest")], [("this", "last", "past"), 1, ("week", "month", "days", "quarter")], [("what's", "whats"), ("new", "up", "happening")]]
_WEIGHTY = [*_MEETINGS, [("matters", "important", "priorities")]]
_PICTURES = [[("photo", "photos", "image", "images", "picture", "pictures", "screenshot", "screenshots", "diagram", "sketch"), ("of", "from", "with", "showing")], [("show", "find", "get", "see"), 2, ("photos", "images", "pictures", "screenshots", "diagrams")], [("look", "looks", "looked"), ("like",)]]
_WORDS_TOO = [[("notes", "text", "documents", "pages", "write-up", "wrote", "said")]]
DETAILS = {"entity": "low", "temporal": "high", "event": "high"}


def query_axes(col: Column) -> Column:
    """intent, detail, salience, recency and modality of a question.

    A question for what holds for good has recency off, unless it bounds its time itself; this very moment is strong.
    Salience is apart from recency. Pictures are asked for alone, or with words.
    """
    has = lambda phrases: col.rlike(_any_of(phrases))
    kind = intent(col)
    detail = F
    for name, value in DETAILS.items():
        detail = detail.when(kind == name, value)
    recency = F.when(has(_ANSWERS) & ~has(_BOUNDED), "off").when(has(_THIS_MOMENT), "strong").when(has(_LATELY) | has(_BOUNDED), "on").otherwise("off")
    modality = F.when(has(_PICTURES) & has(_WORDS_TOO), "both").when(has(_PICTURES), "image").otherwise("text")
    return F.struct(kind.alias("intent"), detail.otherwise("medium").alias("detail"), F.when(has(_WEIGHTY), "on").otherwise("off").alias("salience"), recency.alias("recency"), modality.alias("modality"))
