"""Conversation structure repair (13): error-correcting Earley parsing of the turns' roles.

The grammar of roles is ``(s?(ua)+)?``: maybe a system turn, then pairs of a user's and an assistant's turn. Its lexical symbols
have weighted edits as productions: keep a turn whose role's initial is the one wanted, give it another role, insert a turn without
text, delete a turn. A chart item (production, dot, origin) retains the least (cost, audit) of its span, audits being the edits'
initials; the items of a column are settled cheapest first, as inserts don't move on. The completed chart holds the repair: the
audit says what to do with every turn. Two audits of one span and one cost are never each other's beginning, so the least audit
of a whole is made of least audits of its parts.

Faults: a turn is *blank* without a character outside of blanks, *duplicate* if its role and text were seen before in the
conversation, *truncated* if its last such character is none of ``.!?``; the first that holds counts. Blank and duplicate turns
must be deleted; a truncated one that stays costs more.

Conversations are sorted in their partitions and streamed, each held until it is parsed. Those of over ``HOT_ROWS`` turns or
``HOT_CHARS`` characters are never held: equal rows are counted first, the rest is cut into spans by sampled ranges, each span is
parsed from each of the grammar's four nonterminals in a task of its own, and the spans' items are joined in order, one span after
another; texts pass once more, in order, by the finished audit. What grows there with a conversation is its audit, a letter a turn, which
the result holds anyhow, and the time of its digest, which SHA-256 can only take in order.

Defined cases: turns are taken by turn, null first, those of one turn by role and text; null roles and texts are one blank; a
role whose initial is none of ``s``, ``u``, ``a`` fits nowhere and can only be changed or deleted; a null conv_id is a
conversation of its own; rows that repeat are duplicates; texts of any length are read whole; a conversation all of whose
turns are gone has an empty audit; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.textbatch import small_batches
from fathomline.session import cut_lineage

HOT_ROWS = 2_000
HOT_CHARS = 4_000_000
#: Turns of a span of a hot conversation, about.
SPAN_ROWS = 2_000
BROADCAST_HOT = 10_000

#: The characters between words, and those that end a turn.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

#: What a nonterminal is made of; lexical symbols are in lower case. ``Blank``: no turn is kept as yet.
GRAMMAR = (
    ("Turns", ("Blank",)),
    ("Turns", ("Pairs",)),
    ("Pairs", ("Asked", "answer")),
    ("Pairs", ("Pairs", "drop")),
    ("Asked", ("Blank", "question")),
    ("Asked", ("System", "question")),
    ("Asked", ("Pairs", "question")),
    ("Asked", ("Asked", "drop")),
    ("System", ("Blank", "head")),
    ("System", ("System", "drop")),
    ("Blank", ("Blank", "drop")),
)
STATES = ("Blank", "System", "Asked", "Pairs")
#: (initials taken, letter, cost) of the edits of each lexical symbol; no initials: a turn is put in. ``d`` is a turn that must go.
EDITS = {
    "drop": (("suaxd", "D", 2),),
    "head": (("s", "K", 0),),
    "question": (("u", "K", 0), ("sax", "R", 1), ("", "I", 5)),
    "answer": (("a", "K", 0), ("sux", "R", 1), ("", "I", 5)),
}
TRUNCATED = 5

Value = tuple[int, str]
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


def chart(turns: list[tuple[str, int]], start: str = "Blank") -> dict[str, Value]:
    """Least (cost, audit) by which ``start``, then the turns, make each nonterminal.

    A turn is its role's initial, in upper case if it is truncated, and how many like it follow (of ``d`` alone).
    """
    waiting: dict[str, list[tuple[int, int, int]]] = {}
    for rule, (_, body) in enumerate(GRAMMAR):  # predicted, all in column 0: no nonterminal follows another symbol
        waiting.setdefault(body[0], []).append((rule, 0, 0))
    heap: list[tuple[int, str, tuple[int, int, int]]] = [(0, "", (-1, 1, 0))]
    best: dict[str, Value] = {}
    for at in range(len(turns) + 1):
        initial, times = turns[at] if at < len(turns) else ("", 0)
        fault = TRUNCATED if initial.isupper() else 0
        initial = initial.lower()
        settled: dict[tuple[int, int, int], Value] = {}
        ahead: dict[tuple[int, int, int], Value] = {}
        best = {}
        while heap:
            cost, audit, item = heapq.heappop(heap)
            if item in settled:
                continue
            settled[item] = cost, audit
            rule, dot, origin = item
            head, body = (start, ("",)) if rule < 0 else GRAMMAR[rule]
            if dot == len(body):  # complete
                if head not in best:
                    best[head] = cost, audit
                    for other, place, begun in waiting.get(head, ()):
                        heapq.heappush(heap, (cost, audit, (other, place + 1, begun)))
                continue
            for takes, letter, price in EDITS[body[dot]]:  # scan
                moved = (rule, dot + 1, origin)
                if not takes:
                    heapq.heappush(heap, (cost + price, audit + letter, moved))
                elif initial and initial in takes:
                    value = (cost + price * times + (0 if letter == "D" else fault), audit + letter * times)
                    if moved not in ahead or value < ahead[moved]:
                        ahead[moved] = value
        if at < len(turns):
            heap = [(*value, item) for item, value in ahead.items()]
            heapq.heapify(heap)
    return best


@lru_cache(maxsize=50_000)
def parse(turns: str) -> Value:
    """The least (cost, audit) of a conversation."""
    return chart([(c, 1) for c in turns])["Turns"]


def joined(spans: Iterator[dict[tuple[str, str], Value]]) -> Value:
    """The least (cost, audit) of spans in order; what all remaining audits begin with is put aside."""
    done: list[str] = []
    now: dict[str, Value] = {"Blank": (0, "")}
    for span in spans:
        now = {end: min((cost + span[s, end][0], audit + span[s, end][1]) for s, (cost, audit) in now.items() if (s, end) in span) for end in {e for s, e in span if s in now}}
        same = len(commonprefix([audit for _, audit in now.values()]))
        done.append(next(iter(now.values()))[1][:same])
        now = {s: (cost, audit[same:]) for s, (cost, audit) in now.items()}
    cost, audit = min(now[s] for s in ("Blank", "Pairs") if s in now)
    return cost, "".join(done) + audit


class Repair:
    """What an audit makes of a conversation's turns, one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.asked = audit, 0, False

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._role(), ""

    def _role(self) -> str:
        self.asked = not self.asked
        return "user" if self.asked else "assistant"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            if role[:1] != "s":
                self._role()
            yield edit, role, text
        elif edit == "R":
            yield edit, self._role(), text
        else:
            yield edit, role, text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "x"


def illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


class Digest:
    """SHA-256 of repaired turns, ``role:text`` joined by line feeds."""

    def __init__(self):
        self.sha, self.first = hashlib.sha256(), True

    def add(self, edits: Iterator[tuple[str, str, str]]) -> None:
        for edit, role, text in edits:
            if edit != "D":
                self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
                self.first = False


def whole(conv, turns: list[tuple]) -> tuple[tuple, list[tuple]]:
    """The report of a conversation (turn, role, text, state), in order, and its turns after the repair."""
    symbols, seen, faults = [], set(), {"b": 0, "d": 0, "t": 0}
    for _, role, text, state in turns:
        if state != "b" and (role, text) in seen:
            state = "d"
        seen.add((role, text))
        if state != "o":
            faults[state] += 1
        symbols.append("d" if state in "bd" else initial(role).upper() if state == "t" else initial(role))
    cost, audit = parse("".join(symbols))
    repair, out = Repair(audit), []
    for _, role, text, _ in turns:
        out += repair.turn(role, text)
    out += repair.rest()
    digest = Digest()
    digest.add(iter(out))
    numbers = [t for t, *_ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    bad = sum(illegal(initial(a[1]), initial(b[1])) for a, b in zip(turns, turns[1:], strict=False))
    return (conv, gaps, faults["b"], faults["d"], faults["t"], bad, cost, audit, digest.sha.hexdigest()), out


def stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def prepared(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, and state: blank, truncated, or without such fault; ``-`` where ``gone`` says that the turn is."""
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        *([F.col(gone).alias("gone")] if gone else [F.lit(False).alias("gone")]),
    )
    left = stripped(F.col("text"))
    state = F.when(F.col("gone"), "-").when(left == "", "b").when(~F.right(left, F.lit(1)).isin(*ENDS), "t").otherwise("o")
    cleared = [F.when(~F.col("gone"), F.col(c)).alias(c) for c in ("turn", "role", "text")]
    return own.withColumn("state", state).select("conv_id", *cleared, "state")


def streamed(rows: DataFrame, wanted: str) -> DataFrame:
    """Reports, or turns, of conversations that can be held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reports: list[tuple] = []
        made: list[tuple] = []
        conv, held = None, None

        def close() -> None:
            if held is not None:
                report, out = whole(conv, held)
                if wanted == "report":
                    reports.append(report)
                else:
                    made.extend((conv, k, *x) for k, x in enumerate(out))

        for batch in batches:
            for key, turn, role, text, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or key != conv:
                    close()
                    conv, held = key, []
                if state != "-":
                    held.append((turn, role, text, state))
            if reports or made:
                yield as_batch(reports or made, wanted)
                reports, made = [], []
        close()
        if reports or made:
            yield as_batch(reports or made, wanted)

    small_batches(rows.sparkSession)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, REPORT if wanted == "report" else TURNS)


def as_batch(rows: list[tuple], wanted: str) -> pa.RecordBatch:
    fields = [x.split() for x in (REPORT if wanted == "report" else TURNS).split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def spans_of(rows: DataFrame, span_rows: int) -> DataFrame:
    """Different rows of hot conversations: how many each stands for, what it counts as, its place in order, and its span."""
    once = rows.filter("state <> '-'").groupBy("conv_id", "turn", "role", "text", "state").agg(F.count(F.lit(1)).alias("n"))
    once = once.withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("fathomline"), "text"))
    parts = max(1, -(-once.count() // span_rows))
    placed = once.repartitionByRange(parts, F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    placed = placed.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    placed = cut_lineage(placed.withColumn("place", F.monotonically_increasing_id()).withColumn("span", F.spark_partition_id()))
    key = ["role", "h", "h2"]
    first = placed.filter("state <> 'b'").groupBy("conv_id", *key).agg(F.min("place").alias("first")).withColumnRenamed("conv_id", "other")
    met = placed.join(first.withColumnsRenamed({k: f"first_{k}" for k in key}), F.col("conv_id").eqNullSafe(F.col("other")) & (F.col("role") == F.col("first_role")) & (F.col("h") == F.col("first_h")) & (F.col("h2") == F.col("first_h2")), "left")
    again = F.col("first").isNotNull() & (F.col("place") > F.col("first"))
    return met.withColumn("state", F.when(again, "d").otherwise(F.col("state"))).select("conv_id", "turn", "role", "text", "state", "n", "place", "span")


def parse_span(table: pa.Table) -> pa.Table:
    """The values of a span from each nonterminal to each, its first and last initial, and its counts."""
    table = table.sort_by("place")
    turns: list[tuple[str, int]] = []
    counts = {"b": 0, "d": 0, "t": 0}
    bad, before = 0, None
    for role, state, n in zip(*(table.column(c).to_pylist() for c in ("role", "state", "n")), strict=True):
        who = initial(role)
        more = {"b": "b", "d": "d"}.get(state, "d")  # a row's copies are duplicates, unless it's blank
        if state in "bd":
            turns.append(("d", n))
        else:
            turns.append((who.upper() if state == "t" else who, 1))
            if n > 1:
                turns.append(("d", n - 1))
        counts[more] += n if state in "bd" else n - 1
        if state == "t":
            counts["t"] += 1
        bad += (before is not None and illegal(before, who)) + (n - 1) * illegal(who, who)
        before = who
    found = [(s, e, *value) for s in STATES for e, value in chart(turns, s).items() if e in STATES]
    k = len(found)
    head = {"conv_id": table.column("conv_id")[0].as_py(), "span": table.column("span")[0].as_py(), "first": initial(table.column("role")[0].as_py()), "last": before, "illegal": bad, "blank": counts["b"], "duplicate": counts["d"], "truncated": counts["t"]}
    columns = {n: pa.array([v] * k, pa.string() if n in ("first", "last") else pa.int64()) for n, v in head.items()}
    columns |= {n: pa.array([f[i] for f in found], kind) for i, (n, kind) in enumerate((("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())))}
    return pa.table(columns)


SPAN = "conv_id long, span long, first string, last string, illegal long, blank long, duplicate long, truncated long, start string, end string, cost long, audit string"


def join_spans(table: pa.Table) -> pa.Table:
    """A conversation's cost, audit and counts from its spans'."""
    rows = sorted(table.to_pylist(), key=lambda r: r["span"])
    spans: dict[int, list[dict]] = {}
    for r in rows:
        spans.setdefault(r["span"], []).append(r)
    cost, audit = joined({(r["start"], r["end"]): (r["cost"], r["audit"]) for r in s} for s in spans.values())
    heads = [s[0] for s in spans.values()]
    total = {c: sum(h[c] for h in heads) for c in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(illegal(a["last"], b["first"]) for a, b in zip(heads, heads[1:], strict=False))
    return pa.table({"conv_id": pa.array([rows[0]["conv_id"]], pa.int64()), **{c: [v] for c, v in total.items()}, "cost": [cost], "audit": [audit]})


def hot(rows: DataFrame, wanted: str, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Reports, or turns, of conversations that can't be held."""
    placed = cut_lineage(spans_of(rows, span_rows))
    spans = placed.select("conv_id", "span", "place", "role", "state", "n").groupBy("conv_id", "span").applyInArrow(parse_span, SPAN)
    found = spans.groupBy("conv_id").applyInArrow(join_spans, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    found = cut_lineage(found)
    lines = found.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(1).cast("long").alias("n"), F.col("audit").alias("role"), F.lit("").alias("text"))
    lines = lines.unionByName(placed.select("conv_id", "place", "n", "role", "text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, repair, digest, k = None, None, None, 0
        out: list[tuple] = []

        def emit(edits) -> None:
            nonlocal k
            for x in edits:
                if wanted == "report":
                    digest.add(iter([x]))
                else:
                    out.append((conv, k, *x))
                    k += 1

        def close() -> None:
            if repair is not None:
                emit(repair.rest())
                if wanted == "report":
                    out.append((conv, digest.sha.hexdigest()))

        def drained() -> pa.RecordBatch:
            made = as_batch(out, wanted) if wanted != "report" else pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out])], names=["conv_id", "repaired_sha256"])
            out.clear()
            return made

        for batch in batches:
            for key, place, n, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place < 0:
                    close()
                    conv, repair, digest, k = key, Repair(role), Digest(), 0
                    continue
                for _ in range(n):
                    emit(repair.turn(role, text))
                    if len(out) >= 1000:
                        yield drained()
            if out:
                yield drained()
        close()
        if out:
            yield drained()

    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    if wanted != "report":
        return ordered.mapInArrow(apply, TURNS)
    digests = ordered.mapInArrow(apply, "id long, repaired_sha256 string".replace("id", "conv_id", 1)).withColumnRenamed("conv_id", "id")
    turns = placed.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")).withColumnRenamed("conv_id", "of")
    everything = found.join(digests, F.col("conv_id").eqNullSafe(F.col("id"))).join(turns, F.col("conv_id").eqNullSafe(F.col("of")))
    return everything.select(*(x.split()[0] for x in REPORT.split(", ")))


def repaired(rows: DataFrame, wanted: str = "report", gone: str | None = None, hot_rows: int = HOT_ROWS, hot_chars: int = HOT_CHARS, span_rows: int = SPAN_ROWS) -> DataFrame:
    """``report``: a row for each conversation with its faults, cost, audit and digest; ``turns``: every turn with its edit.

    ``gone``: a column that says which rows are no turns, but have their conversations reported all the same.
    """
    ready = prepared(rows, gone)
    sizes = ready.groupBy("conv_id").agg(F.count_if(F.col("state") != "-").alias("n"), F.sum(F.length("text")).alias("chars"))
    large = cut_lineage(sizes.filter((F.col("n") > hot_rows) | (F.col("chars") > hot_chars)).select(F.col("conv_id").alias("large"), F.lit(True).alias("is_large")))
    n = large.count()
    if not n:
        return streamed(ready, wanted)
    mine = F.col("conv_id").eqNullSafe(F.col("large"))
    others = F.broadcast(large) if n <= BROADCAST_HOT else large
    return streamed(ready.join(others, mine, "left_anti"), wanted).unionByName(hot(ready.join(others, mine, "left_semi"), wanted, span_rows))


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damage: by a hash of conversation and turn a row goes, or is emptied, cut, repeated or given to the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    role, text = text_of("role"), text_of("text")
    own = conversations.select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (case == 0).alias("gone"),
        F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return own.drop("copy")


def op13(spark, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone="gone")
