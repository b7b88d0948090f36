"""Line-first cleaning (8): rules on each line, removal of the lines that fail, then a verdict on what is left.

Base columns follow the words ``[^\\x20\\x09-\\x0D]+`` of the whole text. A line that has a word fails

* *punctuation*: no sentence punctuation in or at its end (unless it is mostly in scripts that write none, as Thai), or over half of its words end in ``!``, or over a tenth of
  its word characters are symbols of ``#*$%&|<>``, or over half of its words repeat the word before;
* *navigation*: ``|``, ``>`` or a bullet parts it into more than two entries;
* *boilerplate*: it opens or holds one of the fixed phrases below.

Failed lines are removed, whichever rule they fail, and a document that loses more than ``max_loss`` of its word
characters with them is rejected.

Defined cases: null or empty text has no words, so ``base_failed`` is true and ``kept`` false; documents of any
length are judged whole; repeated rows are judged each by itself; an empty table gives no rows; further columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.textbatch import Texts, byte_class, chunks, map_texts, mix, per_doc, small_batches, span_hash, words

#: The characters that count as symbols.
SYMBOLS = tuple(b"#*$%&|<>")
#: Characters that end or part sentences.
SENTENCE_MARKS = ".!?:;\u2026\u3002\uff01\uff1f\uff1a\uff1b\uff0e\uff61\u061f\u061b\u06d4\u0964\u0965\u0589\u0f0d\u0f0e\u1362\u104a\u104b\u17d4\u17d5\u203c\u2047\u2048\u2049"
#: Entry marks of menus and tables.
ENTRY_MARKS = "|>\u2022\u00bb"
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    b"all rights reserved",
    b"cookie policy",
    b"copyright (c)",
    b"enable javascript",
    b"is licensed under",
    b"licensed under",
    b"privacy policy",
    b"sign up for our newsletter",
    b"spdx-license-identifier",
    b"terms of service",
    b"terms of use",
)

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOSS = 0.5

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_lines_removed long, loss double"


def is_mark(buf: np.ndarray, marks: str) -> np.ndarray:
    """Where a character of ``marks`` (of at most three bytes in UTF-8) begins."""
    codes = [m.encode() for m in marks]
    found = byte_class(tuple(c[0] for c in codes if len(c) == 1))[buf]
    at = np.flatnonzero(buf >= 0xC2)
    if len(at):
        padded = np.append(buf, np.zeros(2, np.uint8)).astype(np.uint32)
        two = padded[at] << 8 | padded[at + 1]
        three = two << 8 | padded[at + 2]
        of = lambda n: [int.from_bytes(c) for c in codes if len(c) == n]
        found[at] = np.isin(two, of(2)) | np.isin(three, of(3))
    return found


def is_unmarked(buf: np.ndarray) -> np.ndarray:
    """Where a character begins whose script needs no mark at a sentence's end.

    These are Thai, Lao and Tibetan (U+0E00 to U+0FFF), Burmese (to U+109F), the scripts of U+1700 to U+1CFF, Khmer and Mongolian among
    them, and those of U+A800 to U+ABFF.
    """
    found = np.zeros(len(buf), bool)
    at = np.flatnonzero((buf == 0xE0) | (buf == 0xE1) | (buf == 0xEA))
    if len(at):
        padded = np.append(buf, np.zeros(2, np.uint8)).astype(np.uint32)
        code = (padded[at] & 0x0F) << 12 | (padded[at + 1] & 0x3F) << 6 | padded[at + 2] & 0x3F
        found[at] = ((code >= 0x0E00) & (code < 0x10A0)) | ((code >= 0x1700) & (code < 0x1D00)) | ((code >= 0xA800) & (code < 0xAC00))
    return found


def repeat_words(word_hash: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Words that lie in a window of words found twice or more in their document, by document."""
    n = len(word_hash) - window + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = mix(key + word_hash[k : k + n])
    whole = np.flatnonzero(doc[:n] == doc[window - 1 :])
    key = mix(key[whole] ^ mix(doc[whole].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(whole), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = whole[twice]
    cover = np.zeros(len(word_hash) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return per_doc(n_docs, doc[np.cumsum(cover[:-1]) > 0])


class Lines:
    """The lines of a chunk that hold a word, with the counts that the rules need."""

    def __init__(self, t: Texts):
        starts, ends, doc = words(t)
        self.word_doc = doc
        not_tail = (t.buf & 0xC0) != 0x80
        points = np.concatenate([[0], np.cumsum(not_tail)])
        self.word_points = points[ends] - points[starts]
        prefix = t.prefix_hash()
        self.word_hash = span_hash(prefix, starts, ends)
        breaks = np.concatenate([[0], np.cumsum(t.buf == 10)])
        # the number of a line: line breaks before it, and one for each document before it
        line = breaks[starts] + doc
        first = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:], [len(line)]]) - 1 if len(first) else first
        self.first, self.last, self.doc = first, last, doc[first] if len(first) else first
        self.n_words = last - first + 1
        self.chars = self._sum(self.word_points)
        # a line's bytes: from after the break before its first word to the break after its last one
        edge = np.flatnonzero(t.buf == 10)
        bounds = np.unique(np.concatenate([t.offsets, edge + 1]))
        if len(first):
            k = np.searchsorted(bounds, starts[first], side="right") - 1
            self.start = bounds[k]
            self.end = np.minimum(bounds[np.minimum(k + 1, len(bounds) - 1)], len(t.buf))
            self.end = self.end - ((self.end > self.start) & (t.buf[np.maximum(self.end - 1, 0)] == 10))
        else:
            self.start = self.end = first
        self.hash = span_hash(prefix, self.start, self.end)
        self.text_points = np.diff(points[t.offsets])
        self.marks = self._within(is_mark(t.buf, SENTENCE_MARKS))
        self.unmarked = self._within(is_unmarked(t.buf))
        self.symbols = self._bytes(t, SYMBOLS)
        self.entries = self._within(is_mark(t.buf, ENTRY_MARKS))
        shout = (t.buf[ends - 1] == 33) if len(ends) else np.zeros(0, bool)
        self.shouts = self._sum(shout)
        again = np.zeros(len(starts), bool)
        again[1:] = self.word_hash[1:] == self.word_hash[:-1]
        again[first] = False
        self.again = self._sum(again)
        self.boilerplate = np.zeros(len(first), bool)
        low = t.buf.tobytes().lower()
        for phrase in BOILERPLATE:
            at = low.find(phrase)
            while at >= 0:
                if len(first):
                    k = int(np.searchsorted(self.start, at, side="right")) - 1
                    if k >= 0 and at + len(phrase) <= self.end[k]:
                        self.boilerplate[k] = True
                at = low.find(phrase, at + 1)

    def _sum(self, by_word: np.ndarray) -> np.ndarray:
        return np.add.reduceat(by_word.astype(np.int64), self.first) if len(self.first) else np.zeros(0, np.int64)

    def _bytes(self, t: Texts, members: tuple[int, ...]) -> np.ndarray:
        return self._within(byte_class(members)[t.buf])

    def _within(self, marked: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(marked)])
        return c[self.end] - c[self.start]

    def duplicates(self, n_docs: int) -> np.ndarray:
        """Lines equal to an earlier line of their document, by document."""
        key = mix(self.hash ^ mix(self.doc.astype(np.uint64)))
        _, at = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[at] = False
        return per_doc(n_docs, self.doc[again])

    def failures(self) -> tuple[np.ndarray, np.ndarray]:
        """(fails punctuation or navigation, fails boilerplate) of each line."""
        chars = np.maximum(self.chars, 1)
        unended = (self.marks == 0) & (2 * self.unmarked <= chars)
        punctuation = unended | (2 * self.shouts > self.n_words) | (10 * self.symbols > chars) | (2 * self.again > self.n_words)
        return punctuation | (self.entries > 2), self.boilerplate


def judge(t: Texts, max_loss: float = MAX_LOSS) -> dict[str, object]:
    n = len(t)
    x = Lines(t)
    n_words = per_doc(n, x.word_doc)
    word_chars = per_doc(n, x.word_doc, x.word_points)
    symbols = per_doc(n, np.searchsorted(t.offsets, np.flatnonzero(byte_class(SYMBOLS)[t.buf]), side="right") - 1)
    repeats = repeat_words(x.word_hash, x.word_doc, n)
    failed, boilerplate = x.failures()
    base_failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    bad = failed | boilerplate
    lost = per_doc(n, x.doc[bad], x.chars[bad])
    loss = np.where(word_chars > 0, lost / np.maximum(word_chars, 1), 1.0)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": x.duplicates(n),
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "kept": ~base_failed & (loss <= max_loss),
        "n_lines": per_doc(n, x.doc),
        "n_lines_removed": per_doc(n, x.doc[bad]),
        "loss": loss,
    }


def quality_rules(docs: DataFrame, max_loss: float = MAX_LOSS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verdict and its figures for each document, one narrow pass over the texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, text_col, [id_col], lambda t: judge(t, max_loss), f"`{id_col}` {kind}, {COLUMNS}")


def cleaned(docs: DataFrame, max_loss: float = MAX_LOSS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, their failed lines removed; all other columns as they were."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            for row, t in chunks(batch.column(at)):
                x, verdict = Lines(t), judge(t, max_loss)
                failed, boilerplate = x.failures()
                drop = np.zeros(len(t.buf) + 1, np.int64)
                bad = failed | boilerplate
                np.add.at(drop, x.start[bad], 1)
                np.add.at(drop, np.minimum(x.end[bad] + 1, t.offsets[x.doc[bad] + 1]), -1)
                keep = np.cumsum(drop[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(keep)])
                kept, flat = np.asarray(verdict["kept"]), t.buf[keep].tobytes()
                texts = [flat[left[a] : left[b]].decode() for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True)]
                part = batch.slice(row, len(t))
                columns = [pa.array(texts, batch.schema.field(at).type) if i == at else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(kept))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))
    return quality_rules(docs)
