"""Token counts (12): prefix dynamic programming over a byte-pair vocabulary with word ends.

The tokens of a word's prefix are those of a shorter prefix and one token more, the only one that byte-pair merging would leave
apart from the token before it. So one pass over a word finds, for every prefix, its last token and its number of tokens,
whether the word goes on or ends there, without encoding any prefix anew. Words are put together by a running total. The table
of ``prefix_table`` holds the exact token count of every prefix of every text; ``counts_at`` and ``longest_within`` answer budget
and truncation questions from it. ``totals`` runs the same programme and keeps the count at the text's end.

Words are found on arrays of code points, by the class of each (letter, number, blank, other), and counted once for each different
word of some ``CHUNK`` code points; each worker keeps the counts of up to ``KEPT`` words for the next. Long texts go in windows that are cut
where the vocabulary's words end in any case, so memory is a window's; only a run without blank, digit or mark is longer.

Counts are those of the ``tokenizers`` library for the file (``word_bpe_49k.json`` by default; its path is a parameter): special strings
within a text are one token, as is the library's default, nothing is added at the ends. A prefix is counted in code points of the
text in normal form C, which the tokenizer brings texts to; a text that is in that form, as nearly all are, has its own prefixes.
Characters that Python's Unicode tables lack are classed and lowered by the library itself.

Defined cases: null and empty texts have no tokens; rows that repeat are counted each by itself; a null doc_id stays null; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.textbatch import give_back, small_batches

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
CHUNK = 1 << 19
#: Words, and pairs of tokens, that a worker keeps the answers of; words up to ``KEPT_LENGTH`` code points.
KEPT = 300_000
KEPT_LENGTH = 40
BORDERS = 500_000
#: Prefixes in one row of the table.
PART = 1 << 16

LETTER, NUMBER, BLANK, OTHER, UNKNOWN = range(5)
#: The tokenizer's blanks, and its pattern of words.
BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

COUNTED = "doc_id long, n_bytes long, n_tokens long"
PREFIXES = "doc_id long, part int, first long, counts array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@cache
def kinds() -> np.ndarray:
    """The class of every code point."""
    by_name = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((by_name.get(c[0], UNKNOWN if c == "Cn" else OTHER) for c in map(unicodedata.category, map(chr, range(0x110000)))), np.uint8, 0x110000)
    out[list(BLANKS)] = BLANK
    return out


class Vocabulary:
    """A byte-pair vocabulary with word ends: token ids by bytes, for tokens within a word and at its end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"].get("end_of_word_suffix")
        steps = spec["pre_tokenizer"].get("pretokenizers", [{}])
        if model["type"] != "BPE" or not end or model.get("continuing_subword_prefix") or steps[0].get("pattern") != {"Regex": WORDS}:
            raise ValueError(f"{path} isn't a byte-pair vocabulary with word ends and the usual words")
        self.library = Tokenizer.from_file(path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            if token not in self.special:
                ends = token.endswith(end)
                (self.final if ends else self.inner)[bytes(back[c] for c in (token[: -len(end)] if ends else token))] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        # a token's age is the number of the merge that makes it; bytes are as old as can be and have no parts
        vocab = model["vocab"]
        self.age = [-1] * (max(vocab.values()) + 1)
        self.parts = [(i, i) for i in range(len(self.age))]
        self.pairs: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(model["merges"]):
            made = vocab[a + b]
            self.pairs[vocab[a], vocab[b]] = k
            self.age[made], self.parts[made] = k, (vocab[a], vocab[b])
        self.apart: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, int] = {}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # a token that merging never arrives at, as an earlier merge crosses its parts' border, is no token of any word
        reached = [False] * len(self.age)
        for i in sorted(range(len(self.age)), key=self.age.__getitem__):
            x, y = self.parts[i]
            reached[i] = x == i or (reached[x] and reached[y] and self.stay_apart(x, y, (self.age[i], 0.5)))
        self.inner = {t: i for t, i in self.inner.items() if reached[i]}
        self.final = {t: i for t, i in self.final.items() if reached[i]}
        self.apart.clear()
        self.found = ahocorasick.Automaton()
        for t, i in self.inner.items():
            self.found.add_word(t.decode("latin-1"), (len(t), i))
        self.found.make_automaton()

    def stay_apart(self, a: int, b: int, limit: tuple[float, float] = (float("inf"), 0)) -> bool:
        """Whether merging leaves tokens ``a`` and ``b`` as they are, side by side.

        Taken apart from the youngest on, no pair across the border may have a merge that comes before the one undone last; of
        equal merges that on the left comes first. ``limit``: the merge undone last, and its place, at the start.
        """
        x, y, age, parts, pairs = a, b, self.age, self.parts, self.pairs
        while True:
            k = pairs.get((x, y))
            if k is not None and (k, 0.5) < limit:
                out = False
                break
            if age[x] < 0 and age[y] < 0:
                out = True
                break
            if age[x] > age[y]:
                limit, x = (age[x], 0), parts[x][1]
            else:
                limit, y = (age[y], 1), parts[y][0]
        if len(self.apart) >= BORDERS:
            self.apart.clear()
        self.apart[a, b] = out
        return out

    def prefixes(self, word: bytes, every: bool = True) -> array:
        """Number of tokens of each prefix of a word that ends at the end of a code point, or of the whole word alone."""
        n, final, apart = len(word), self.final, self.apart
        last, count = array("i", [-1]) * n, array("i", [0]) * (n + 1)
        for at, (size, t) in self.found.iter(word.decode("latin-1")):  # the vocabulary's tokens, by their ends
            if at < n - 1 and last[at] < 0:
                i = at + 1 - size
                if not i:
                    last[at], count[at + 1] = t, 1
                    continue
                before = last[i - 1]
                stay = apart.get((before, t))
                if self.stay_apart(before, t) if stay is None else stay:
                    last[at], count[at + 1] = t, count[i] + 1
        out = array("i")
        for j in range(1, n + 1) if every else (n,):
            if j < n and word[j] & 0xC0 == 0x80:
                continue
            for i in range(max(0, j - self.longest), j):
                t = final.get(word[i:j])
                if t is not None:
                    if i:
                        stay = apart.get((last[i - 1], t))
                        if not (self.stay_apart(last[i - 1], t) if stay is None else stay):
                            continue
                    out.append(count[i] + 1)
                    break
        return out

    def by_prefix(self, word: str) -> list[int]:
        """Token counts of a word's prefixes, by code point."""
        out = self.prefixes(word.encode()).tolist()
        if word[0] == "'" and word[1:] in ENDINGS:  # until an ending is whole, its letters are a word of their own
            out[1:-1] = [out[0] + self.whole(word[1:k]) for k in range(2, len(word))]
        return out

    def whole(self, word: str) -> int:
        found = self.kept.get(word)
        if found is None:
            found = self.prefixes(word.encode(), every=False)[0]
            if len(word) <= KEPT_LENGTH:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[word] = found
        return found

    def kind_of(self, c: str) -> int:
        n = len(self.library.pre_tokenizer.pre_tokenize_str(f"a{c}{c}a"))
        return {1: LETTER, 2: BLANK, 4: NUMBER}.get(n, OTHER)

    def form_c(self, text: str) -> str:
        if text.isascii():
            return text
        if (kinds()[points(text)] == UNKNOWN).any():
            from tokenizers.normalizers import NFC

            return NFC().normalize_str(text)
        return unicodedata.normalize("NFC", text)

    def lower(self, text: str) -> str:
        """Each character lowered by itself: a sigma at a word's end is no exception."""
        if text.isascii():
            return text.lower()
        if (kinds()[points(text)] == UNKNOWN).any():
            from tokenizers.normalizers import Lowercase

            return Lowercase().normalize_str(text)
        return text.replace("Σ", "σ").lower()


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def words(v: Vocabulary, text: str) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Words and runs of blanks of a lowered text: first code point, which different word, those words, whether it's no blank."""
    p = points(text)
    kind = kinds()[p]
    for c in np.unique(p[kind == UNKNOWN]).tolist():
        kind = np.where(p == c, v.kind_of(chr(c)), kind)
    first = np.ones(len(p), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    marks = np.flatnonzero((p == 39) & first)
    if len(marks):
        ahead = np.concatenate((p, [0, 0, 0]))
        goes_on = np.concatenate((first, [True] * 3))
        for ending in ENDINGS:
            at = marks[np.all([ahead[marks + 1 + i] == ord(c) for i, c in enumerate(ending)], axis=0)]
            goes_on[at + 1] = False
            goes_on[at + 1 + len(ending)] = True
        first = goes_on[: len(p)]
    where = np.flatnonzero(first)
    data = text.encode()
    ends = where if len(data) == len(p) else np.concatenate(([0], np.cumsum(1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000))))[where]
    ends = np.append(ends, len(data)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(where), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
    return where, np.asarray(found.indices), found.dictionary.to_pylist(), kind[where] != BLANK


CUTS = re.compile(f"[{''.join(map(chr, BLANKS))}]" r"|[0-9]|(?<=[^\W\d_İ])[!-/:-@\[-`{-~、。！，．？]")


def windows(text: str, most: int = CHUNK) -> Iterator[str]:
    """A text cut ahead of blanks, digits, and marks that follow a letter, where words end and normal forms don't reach across.

    (İ counts as no letter here: in lower case it ends in a mark.)
    """
    at = 0
    while len(text) - at > most:
        near = [m.start() for m in CUTS.finditer(text, at + most - min(most, 1 << 12) + 1, at + most)]
        to = near[-1] if near else getattr(CUTS.search(text, at + most), "start", lambda: len(text))()
        yield text[at:to]
        at = to
    yield text[at:]


def segments(v: Vocabulary, text: str) -> Iterator[str | None]:
    """Stretches of ordinary text; None stands for a special string."""
    at = 0
    for m in v.split.finditer(text) if v.split is not None and any(x in text for x in v.special) else ():
        yield text[at : m.start()]
        yield None
        at = m.end()
    yield text[at:]


def batch_totals(v: Vocabulary, texts: Iterator[str | None], chunk: int = CHUNK) -> np.ndarray:
    """Tokens of each text."""
    out: list[int] = []
    held: list[str] = []
    of: list[int] = []
    size = 0

    def settle() -> None:
        joined = "\n".join(held)
        if joined:
            where, which, different, solid = words(v, joined)
            total = np.concatenate(([0], np.cumsum(np.fromiter(map(v.whole, different), np.int64, len(different))[which] * solid)))
            begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in held])))
            at = total[np.searchsorted(where, begin)]
            for doc, n in zip(of, np.diff(at).tolist(), strict=True):
                out[doc] += n
        held.clear()
        of.clear()

    for i, text in enumerate(texts):
        out.append(0)
        for part in segments(v, text or ""):
            if part is None:
                out[i] += 1
                continue
            for piece in windows(part, chunk):
                held.append(v.lower(v.form_c(piece)))
                of.append(i)
                size += len(piece) + 1
                if size > chunk:
                    settle()
                    size = 0
    settle()
    return np.array(out, np.int64)


def prefix_counts(v: Vocabulary, text: str | None, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """Token counts of the prefixes of 0, 1, 2 ... code points, in arrays of a window each."""
    yield np.zeros(1, np.int32)
    before = 0
    parts = list(segments(v, text or ""))
    for k, part in enumerate(parts):
        if part is None:
            continue
        specials = v.split.findall(text) if len(parts) > 1 else []
        tail = specials[k // 2] if k + 1 < len(parts) else ""
        base = before
        for piece in windows(part + tail[:-1], chunk) if part or tail else ():
            form = v.form_c(piece)
            low = v.lower(form)
            if not low:
                continue
            where, which, different, solid = words(v, low)
            runs = [np.array(v.by_prefix(w), np.int32) for w in different]
            ends = np.array([r[-1] for r in runs], np.int64)[which] * solid
            start = base + np.concatenate(([0], np.cumsum(ends)))
            counts = np.concatenate([runs[w] * s for w, s in zip(which.tolist(), solid.tolist(), strict=True)]) + np.repeat(start[:-1], np.diff(np.append(where, len(low))))
            if len(low) != len(form):  # a few letters are longer in lower case
                counts = counts[np.cumsum([len(v.lower(c)) for c in form]) - 1]
            base = int(start[-1])
            yield counts.astype(np.int32)
        if tail:
            before += int(batch_totals(v, iter([part]), chunk)[0]) + 1
            yield np.array([before], np.int32)


def totals(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch_totals(vocabulary(path), (x.as_py() for x in batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])
        give_back()

    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, COUNTED)


def prefix_table(docs: DataFrame, path: str | None = None, part: int = PART) -> DataFrame:
    """The counts of every prefix: ``counts[i]`` is that of the first ``first + i`` code points; a row holds ``part`` prefixes."""
    path = path or default_tokenizer()

    def cut(text: str | None) -> Iterator[np.ndarray]:
        held = np.zeros(0, np.int32)
        for counts in prefix_counts(vocabulary(path), text):
            held = np.concatenate((held, counts))
            whole = len(held) // part * part
            yield from (held[i : i + part] for i in range(0, whole, part))
            held = held[whole:]
        if len(held):
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_ = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, counts in enumerate(cut(text.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((doc, k, k * part, counts), kinds_, strict=True)], names=["doc_id", "part", "first", "counts"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PREFIXES)


def counts_at(table: DataFrame, asked: DataFrame) -> DataFrame:
    """n_tokens of the first ``n_chars`` code points of each asked document; null beyond its end."""
    size = table.agg(F.max(F.size("counts"))).first()[0] or 1
    part = F.floor(F.col("n_chars") / size).cast("int")
    found = asked.withColumn("part", part).join(table, ["doc_id", "part"], "left")
    return found.select("doc_id", "n_chars", F.get("counts", (F.col("n_chars") - F.col("first")).cast("int")).alias("n_tokens"))


def longest_within(table: DataFrame, budget: int) -> DataFrame:
    """n_chars of each document's longest prefix of at most ``budget`` tokens."""
    fits = F.filter(F.transform("counts", lambda n, i: F.when(n <= budget, i + F.col("first"))), lambda i: i.isNotNull())
    return table.groupBy("doc_id").agg(F.max(F.array_max(fits)).alias("n_chars"))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return totals(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
