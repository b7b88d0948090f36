"""Conversation repair against exhaustive search, and its two ways against each other."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fathomline.llm import conversation_repair as cr

GOOD = re.compile(r"(s?(ua)+)?")
KIND = "conv_id long, turn long, role string, text string"


def brute_parse(turns):
    """The least (cost, audit) by trying every edit and every place for up to two inserts in a row."""
    best = None
    choices = []
    for c in turns:
        if c == "d":
            choices.append([("D", 2, "")])
            continue
        fault = 5 if c.isupper() else 0
        choices.append([("D", 2, ""), ("R", 1 + fault, "u"), ("R", 1 + fault, "a")] + ([("K", fault, c.lower())] if c.lower() != "x" else []))
    gaps = [("", 0, ""), *[("I" * len(x), 5 * len(x), x) for x in ("u", "a", "ua", "au")]]
    for own in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(turns) + 1):
            cost = sum(x[1] for x in own) + sum(x[1] for x in put)
            if best is not None and cost > best[0]:
                continue
            roles = put[0][2] + "".join(a[2] + b[2] for a, b in zip(own, put[1:], strict=True))
            if GOOD.fullmatch(roles):
                audit = put[0][0] + "".join(a[0] + b[0] for a, b in zip(own, put[1:], strict=True))
                best = min(best, (cost, audit)) if best else (cost, audit)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_parse_is_the_cheapest_repair(n):
    for turns in itertools.product("suaxSUAd", repeat=n):
        assert cr.parse("".join(turns)) == brute_parse("".join(turns))


def test_longer_parse_is_the_cheapest_repair():
    rng = random.Random(3)
    for _ in range(12):
        turns = "".join(rng.choice("suaxSUAd") for _ in range(4))
        assert cr.parse(turns) == brute_parse(turns)


def test_spans_join_to_the_whole():
    rng = random.Random(4)
    for _ in range(200):
        turns = "".join(rng.choice("ssuuaaxSUAddd") for _ in range(rng.randint(0, 40)))
        cuts = sorted(rng.randint(0, len(turns)) for _ in range(rng.randint(0, 6)))
        parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)], strict=True)]
        runs = [[(c, len(list(g)) if c == "d" else 1) for c, g in itertools.groupby(p)] if set(p) == {"d"} else [(c, 1) for c in p] for p in parts]
        spans = [{(s, e): v for s in cr.STATES for e, v in cr.chart(r, s).items() if e in cr.STATES} for r in runs]
        assert cr.joined(iter(spans)) == cr.parse(turns)


def brute(rows, damage):
    """Reports of all conversations (conv_id, turn, role, text), computed plainly."""
    kept, every = {}, set()
    for conv, turn, role, text in rows:
        every.add(conv)
        own = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        case = zlib.crc32(f"{own[0]}:{own[1]}".encode()) % 20 if damage else 9
        role, text = "user" if case == 4 else own[2], "" if case == 1 else re.sub("[.!?]", "", own[3]) if case == 2 else own[3]
        kept.setdefault(conv, []).extend([(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1))
    out = {}
    for conv in every:
        turns = sorted(kept[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        counts, symbols, seen = {"b": 0, "d": 0, "t": 0}, "", set()
        for _, role, text in turns:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            c = role[0] if role and role[0] in "sua" else "x"
            if not words:
                counts["b"], c = counts["b"] + 1, "d"
            elif (role, text) in seen:
                counts["d"], c = counts["d"] + 1, "d"
            elif words[-1] not in ".!?":
                counts["t"], c = counts["t"] + 1, c.upper()
            seen.add((role, text))
            symbols += c
        cost, audit = brute_parse(symbols) if len(symbols) < 4 else cr.parse(symbols)
        left, at, roles = [], 0, itertools.cycle(("user", "assistant"))
        for edit in audit:
            if edit == "I":
                left.append(f"{next(roles)}:")
                continue
            _, role, text = turns[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R" or role[0] in "ua":
                new = next(roles)
                role = new if edit == "R" else role
            left.append(f"{role}:{text}")
        numbers = {t for t, *_ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        initials = [r[:1] for _, r, _ in turns]
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], bad, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 9, "user", "cut"), (1, 9, "user", "cut"), (2, 0, None, None), (2, None, "tool", "x."), (2, 5, "", "y?"), (2, 5, "abc", "y?\t"),
    (None, None, None, None), (None, 3, "user", "a."), (None, 3, "user", "a."), (None, 4, "assistant", "b" * 100_000 + "."), (3, 1, "system", "s."), (3, 2, "assistant", " "), (4, 1, "assistant", "only."),
]


def long_conversation(n):
    rng = random.Random(6)
    return [(77, i // 3 if i % 5 else None, rng.choice(["user", "assistant", "system", "tool", "user"]), rng.choice(["Fine.", "ok", "", f"Number {i}.", f"open {i % 40}"])) for i in range(n)]


@pytest.mark.parametrize("which", ["table", "odd", "long", "none"])
@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("damage", [True, False])
def test_repair(which, hot, damage, spark, sf):
    if which == "table":
        df = spark.read.parquet(f"{sf}/conversations.parquet")
    else:
        df = spark.createDataFrame({"odd": ODD, "long": ODD + long_conversation(700), "none": []}[which], KIND).repartition(3)
    df = df.withColumn("cost", F.lit("a clashing name"))
    options = {"hot_rows": 0, "span_rows": 25} if hot else {}
    got = cr.repaired(cr.damaged(df), gone="gone", **options) if damage else cr.repaired(df, **options)
    want = brute([tuple(r)[:4] for r in df.collect()], damage)
    rows = got.collect()
    assert len(rows) == len(want)
    assert {r[0]: tuple(r)[1:] for r in rows} == want


@pytest.mark.parametrize("hot", [False, True])
def test_repaired_turns(hot, spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    turns = cr.repaired(cr.damaged(df), "turns", gone="gone", **({"hot_rows": 1, "span_rows": 30} if hot else {})).collect()
    reports = {r.conv_id: r for r in cr.repaired(cr.damaged(df), gone="gone").collect()}
    by = {}
    for r in sorted(turns, key=lambda r: (r.conv_id, r.place)):
        by.setdefault(r.conv_id, []).append(r)
    for conv, rows in by.items():
        left = [r for r in rows if r.edit != "D"]
        assert "".join(r.edit for r in rows) == reports[conv].audit
        assert GOOD.fullmatch("".join(r.role[0] for r in left))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in left).encode()).hexdigest() == reports[conv].repaired_sha256
