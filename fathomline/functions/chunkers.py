"""Chunkers and extractors: pure functions on one text, and their DataFrame forms in Arrow batches."""

from __future__ import annotations

import ast
import functools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# What parts a text, from coarse to fine.
LEVELS = (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+|(?<=[。！？])", r"(?<=[,;:])\s+|(?<=[；：，、])", r"\s+")
CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")
#: Share of a text's characters from which it is counted in characters, not in words.
CJK_SHARE = 0.3
TARGET = 300
OVERLAP = 50
HARD_CHARS = 6000


def is_cjk(text: str) -> bool:
    bare = len("".join(text.split()))
    return bare > 0 and len(CJK.findall(text)) >= CJK_SHARE * bare


def _words(text: str) -> int:
    """Words, or the characters that aren't blank of a text in a script without blanks between words."""
    return len("".join(text.split())) if is_cjk(text) else len(text.split())


def _pieces(text: str, target: int, level: int = 0) -> list[str]:
    """Parts of at most ``target`` words (characters of CJK text), cut at the coarsest mark that does it."""
    if _words(text) <= target or level == len(LEVELS):
        return [text] if text.strip() else []
    if level == len(LEVELS) - 1:
        if is_cjk(text):
            return [text[i : i + target] for i in range(0, len(text), target)]
        words = text.split()
        return [" ".join(words[i : i + target]) for i in range(0, len(words), target)]
    out: list[str] = []
    for part in re.split(LEVELS[level], text):
        out += _pieces(part, target, level + 1)
    return out


def chunk_text(text: str | None, target: int = TARGET, overlap: int = OVERLAP, hard: int = HARD_CHARS) -> list[str]:
    """Chunks of about ``target`` words (merged up to half as many more), each opening with the end of the one before.

    The overlap is at most ``overlap`` words, from the start of a sentence where there is one. No chunk is longer than
    ``hard`` characters.
    """
    merged: list[str] = []
    for piece in _pieces(text or "", target):
        if merged and _words(merged[-1]) + _words(piece) <= target:
            merged[-1] += "\n" + piece
        else:
            merged.append(piece)
    if len(merged) > 1 and _words(merged[-1]) + _words(merged[-2]) <= math.ceil(1.5 * target):
        merged[-2:] = [merged[-2] + "\n" + merged[-1]]
    out: list[str] = []
    for i, body in enumerate(merged):
        if i and overlap:
            before = merged[i - 1]
            tail = before[-overlap:] if is_cjk(before) else " ".join(before.split()[-overlap:])
            starts = [m.end() for m in re.finditer(r"[.!?]\s+|[。！？]", tail)]
            lead = tail[starts[0] :] if starts and starts[0] < len(tail) else tail
            body = lead[-min(500, hard // 10) :] + "\n" + body
        out += [body[k : k + hard] for k in range(0, len(body), hard)]
    return out


def exploded(df: DataFrame, key: str, text: str, chunker: Callable[[str | None], list[str]] = chunk_text) -> DataFrame:
    """(key, chunk_index, chunk_text): one row for each chunk."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, i, c) for k, t in zip(pdf[key], pdf[text], strict=True) for i, c in enumerate(chunker(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk_text"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, chunk_index int, chunk_text string")


# The Savitzky-Golay first derivative over five points, degree two or three.
SLOPE = np.array([-2.0, -1.0, 0.0, 1.0, 2.0]) / 10.0


def semantic_boundaries(vectors: np.ndarray, share: float = 0.2, gap: int = 2) -> list[int]:
    """Places between sentences where the similarity of neighbours has a low minimum.

    The smoothed slope of the similarities turns from falling to rising there, and the similarity is under the
    ``share`` percentile (the value at the floored index); boundaries are at least ``gap`` apart.
    """
    if len(vectors) < 3:
        return []
    norm = np.linalg.norm(vectors, axis=1)
    sims = (vectors[:-1] * vectors[1:]).sum(axis=1) / np.maximum(norm[:-1] * norm[1:], 1e-12)
    padded = np.pad(sims, 2, mode="edge")
    slope = np.array([(padded[i : i + 5] * SLOPE).sum() for i in range(len(sims))])
    limit = np.sort(sims)[int(math.floor((len(sims) - 1) * share))]
    out: list[int] = []
    for i in range(1, len(sims)):
        if slope[i - 1] < 0 <= slope[i] and min(sims[i - 1], sims[i]) <= limit:
            at = i if sims[i] <= sims[i - 1] else i - 1
            if not out or at + 1 - out[-1] >= gap:
                out.append(at + 1)
    return out


@functools.lru_cache(maxsize=1)
def _parsed(source: str) -> ast.Module | None:
    """The source's tree, kept for who asks next for the same source; none of what isn't Python."""
    try:
        return ast.parse(source)
    except SyntaxError:
        return None


#: Nodes without calls or imports below them.
_LEAVES = (ast.Name, ast.Constant, ast.arg, ast.alias, ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)


def code_chunks(source: str) -> list[dict]:
    """Top-level functions, classes and methods of Python code with lines and qualified names; the rest as ``module``."""
    tree = _parsed(source)
    if tree is None:
        return [{"symbol": "", "kind": "text", "start_line": 1, "end_line": source.count("\n") + 1, "doc": None}]
    out: list[dict] = []

    def walk(body, prefix):
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}.{node.name}" if prefix else node.name
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if prefix else "function"
                out.append({"symbol": name, "kind": kind, "start_line": node.lineno, "end_line": node.end_lineno, "doc": ast.get_docstring(node)})
                if kind == "class":
                    walk(node.body, name)

    walk(tree.body, "")
    return out or [{"symbol": "", "kind": "module", "start_line": 1, "end_line": source.count("\n") + 1, "doc": None}]


def code_edges(source: str) -> list[tuple[str, str, str]]:
    """(from symbol, to symbol, kind) of calls and imports of Python code."""
    tree = _parsed(source)
    if tree is None:
        return []
    out: list[tuple[str, str, str]] = []

    def name_of(f) -> str:
        return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""

    def walk(node, scope):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _LEAVES):
                continue
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{scope}.{child.name}" if scope else child.name
            elif isinstance(child, ast.Call) and name_of(child.func):
                out.append((scope, name_of(child.func), "calls"))
            elif isinstance(child, ast.Import):
                out.extend((scope, a.name, "imports") for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.extend((scope, f"{child.module or ''}.{a.name}", "imports") for a in child.names)
            walk(child, inner)

    walk(tree, "")
    return out


def timeline_lines(text: str) -> list[tuple[str, str, str]]:
    """(day, summary, detail) of list lines that open with a real calendar day; indented lines below are the detail."""
    import datetime as dt

    out: list[list[str]] = []
    for line in (text or "").split("\n"):
        m = re.match(r"^\s*[-*]?\s*\**(\d{4}-\d{2}-\d{2})\**\s*(?:[:|—-]\s*)?(.*)$", line)
        real = False
        if m:
            try:
                dt.date.fromisoformat(m[1])
                real = True
            except ValueError:
                pass
        if real:
            out.append([m[1], m[2].strip(), ""])
        elif out and re.match(r"^\s{2,}\S", line):
            out[-1][2] = (out[-1][2] + "\n" + line.strip()).strip()
        elif line.strip():
            out.append(["", "", ""]) if out and out[-1][0] else None
    return [tuple(x) for x in out if x[0]]
