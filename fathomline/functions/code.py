"""Chunks and edges of code in languages with braces, by declarations at the start of lines and a scan for matching braces.

Python goes by its own parser (``chunkers``). Strings and comments are blanked before anything is looked for, so what they
hold is no code. A language is a row of patterns; callers may add rows to ``LANGUAGES``.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from fathomline.functions import chunkers

_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"


@dataclass(frozen=True)
class Language:
    #: (kind, pattern with a group ``name`` and perhaps ``owner``) of a declaration, tried in order at the start of a line.
    declarations: tuple[tuple[str, str], ...]
    #: Patterns of imports whose group 1 is what is imported.
    imports: tuple[str, ...]
    #: Kinds whose inner functions are methods.
    owners: tuple[str, ...] = ("class",)
    #: A pattern of methods within an owner's body.
    method: str | None = None
    quotes: str = "\"'`"


_SCRIPT = Language(
    (
        ("function", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}"),
        ("class", rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}"),
        ("interface", rf"(?:export\s+)?interface\s+{_NAME}"),
        ("enum", rf"(?:export\s+)?(?:const\s+)?enum\s+{_NAME}"),
        ("function", rf"(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)"),
    ),
    (r"import\b[^'\"\n]*['\"]([^'\"\n]+)['\"]", r"require\(\s*['\"]([^'\"\n]+)['\"]"),
    method=rf"(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*{_NAME}\s*\([^)]*\)\s*(?::[^{{;]+)?\{{",
)
LANGUAGES = {
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "go": Language((("method", rf"func\s+\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*{_NAME}"), ("function", rf"func\s+{_NAME}"), ("struct", rf"type\s+{_NAME}\s+struct"), ("interface", rf"type\s+{_NAME}\s+interface")), (r"import\s+(?:\w+\s+)?\"([^\"\n]+)\"",), (), quotes='"`'),
    "rust": Language(
        (("function", rf"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+{_NAME}"), ("struct", rf"(?:pub\s+)?struct\s+{_NAME}"), ("enum", rf"(?:pub\s+)?enum\s+{_NAME}"), ("trait", rf"(?:pub\s+)?trait\s+{_NAME}"), ("impl", rf"impl(?:<[^>]*>)?\s+(?:[\w:]+(?:<[^>]*>)?\s+for\s+)?{_NAME}")),
        (r"use\s+([\w:]+)",),
        ("impl", "trait"),
        rf"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+{_NAME}",
        '"',
    ),
    "java": Language(
        (("class", rf"(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|record)\s+{_NAME}"), ("interface", rf"(?:public\s+)?interface\s+{_NAME}"), ("enum", rf"(?:public\s+)?enum\s+{_NAME}")),
        (r"import\s+(?:static\s+)?([\w.*]+)\s*;",),
        ("class", "interface"),
        rf"(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\],.? ]+\s+{_NAME}\s*\([^)]*\)\s*(?:throws [\w, .]+)?\{{",
        '"',
    ),
}
_MODIFIERS = r"(?:(?:public|private|protected|internal|open|override|static|final|sealed|abstract|virtual|async|data|inline|suspend|lazy|implicit|case|partial|readonly|mutating|fileprivate)\s+)*"
_C_TYPE = r"(?:(?:static|inline|extern|const|unsigned|signed|virtual|explicit|constexpr|struct)\s+)*[A-Za-z_][\w:<>,]*(?:\s*[*&]+\s*|\s+)"
_C_FUNCTION = rf"{_C_TYPE}{_NAME}\s*\([^;{{)]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{{"
_INCLUDES = (r"#\s*include\s*[<\"]([^>\"\n]+)[>\"]",)
LANGUAGES |= {
    "c": Language((("struct", rf"(?:typedef\s+)?struct\s+{_NAME}\s*\{{"), ("enum", rf"(?:typedef\s+)?enum\s+{_NAME}\s*\{{"), ("function", _C_FUNCTION)), _INCLUDES, (), quotes="\"'"),
    "cpp": Language(
        (("class", rf"(?:class|struct)\s+{_NAME}[^;{{(]*\{{"), ("enum", rf"enum\s+(?:class\s+)?{_NAME}[^;{{]*\{{"), ("method", rf"(?:{_C_TYPE})?(?P<owner>\w+)::{_NAME}\s*\([^;{{]*\)[^;{{]*\{{"), ("function", _C_FUNCTION)),
        _INCLUDES,
        method=rf"(?:{_C_TYPE})?{_NAME}\s*\([^;{{)]*\)[^;{{}}]*\{{",
        quotes="\"'",
    ),
    "csharp": Language(
        (("class", rf"{_MODIFIERS}(?:class|record|struct)\s+{_NAME}"), ("interface", rf"{_MODIFIERS}interface\s+{_NAME}"), ("enum", rf"{_MODIFIERS}enum\s+{_NAME}")),
        (r"using\s+(?:static\s+)?([\w.]+)\s*;",),
        method=rf"{_MODIFIERS}[\w<>\[\],.?]+\s+{_NAME}\s*\([^)]*\)\s*\{{",
        quotes='"',
    ),
    "php": Language(
        (("class", rf"{_MODIFIERS}class\s+{_NAME}"), ("interface", rf"interface\s+{_NAME}"), ("trait", rf"trait\s+{_NAME}"), ("function", rf"function\s+&?{_NAME}")),
        (r"^\s*use\s+([\w\\]+)", r"(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"\n]+)['\"]"),
        ("class", "trait"),
        rf"{_MODIFIERS}function\s+&?{_NAME}",
        "\"'",
    ),
    "kotlin": Language(
        (("function", rf"{_MODIFIERS}fun\s+(?:<[^>]*>\s*)?{_NAME}"), ("class", rf"{_MODIFIERS}(?:enum\s+)?(?:class|object)\s+{_NAME}"), ("interface", rf"{_MODIFIERS}interface\s+{_NAME}")),
        (r"^import\s+([\w.*]+)",),
        ("class",),
        rf"{_MODIFIERS}fun\s+(?:<[^>]*>\s*)?{_NAME}",
        '"',
    ),
    "swift": Language(
        (("function", rf"{_MODIFIERS}func\s+{_NAME}"), ("class", rf"{_MODIFIERS}(?:class|struct|actor)\s+{_NAME}"), ("enum", rf"{_MODIFIERS}enum\s+{_NAME}"), ("interface", rf"{_MODIFIERS}protocol\s+{_NAME}"), ("impl", rf"{_MODIFIERS}extension\s+{_NAME}")),
        (r"^import\s+([\w.]+)",),
        ("class", "impl", "enum"),
        rf"{_MODIFIERS}func\s+{_NAME}",
        '"',
    ),
    "scala": Language(
        (("function", rf"{_MODIFIERS}def\s+{_NAME}"), ("class", rf"{_MODIFIERS}(?:class|object)\s+{_NAME}"), ("trait", rf"{_MODIFIERS}trait\s+{_NAME}")),
        (r"^import\s+([\w.]+)",),
        ("class", "trait"),
        rf"{_MODIFIERS}def\s+{_NAME}",
        '"',
    ),
}
EXTENSIONS = {"c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "php": "php", "kt": "kotlin", "swift": "swift", "scala": "scala", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "go": "go", "rs": "rust", "java": "java"}
#: Words before a parenthesis that are no calls.
CONTROL = frozenset("if for foreach while switch catch return match using lock guard when elseif else sizeof".split())
NO_CALLS = CONTROL | frozenset("async function func fun fn def new super typeof await constructor class object struct init".split())


def language_of(path: str) -> str | None:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def blanked(source: str, quotes: str) -> str:
    """The source with comments and the insides of strings as blanks; line breaks and lengths stay."""
    pattern = r"//[^\n]*|/\*.*?\*/|" + "|".join(rf"{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(10)}])*{q}" for q in quotes)
    keep = lambda m: m[0] if len(m[0]) < 2 else re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
    return re.sub(pattern, keep, source, flags=re.DOTALL)


def _end(text: str, at: int) -> int:
    """The place after the declaration that begins at ``at``: its closing brace, else the end of its line."""
    line = text.find("\n", at)
    line = len(text) if line < 0 else line
    opened = text.find("{", at)
    stop = text.find(";", at)
    if opened < 0 or (0 <= stop < opened) or opened > line + 200:
        return line
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, opened):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def _declared(text: str, language: Language) -> list[tuple[str, str, int, int]]:
    """(symbol, kind, from, to) of declarations outside others, and of the methods within them."""
    out: list[tuple[str, str, int, int]] = []
    at = 0
    while at < len(text):
        found = None
        for kind, pattern in language.declarations:
            if m := re.compile(r"[ \t]*" + pattern).match(text, at):
                found = (kind, m)
                break
        if found is None:
            line = text.find("\n", at)
            at = len(text) if line < 0 else line + 1
            continue
        kind, m = found
        stop = _end(text, m.start())
        owner = m.groupdict().get("owner")
        if kind != "impl":
            out.append((f"{owner}.{m['name']}" if owner else m["name"], kind, m.start(), stop))
        if kind in language.owners and language.method:
            body = text.find("{", m.start()) + 1
            inner = re.compile(r"^[ \t]+" + language.method, re.MULTILINE)
            while 0 < body < stop and (x := inner.search(text, body, stop)):
                to = _end(text, x.start())
                if x["name"] not in CONTROL:
                    out.append((f"{m['name']}.{x['name']}", "method", x.start(), to))
                body = max(to, x.end())
        line = text.find("\n", stop)
        at = len(text) if line < 0 else line + 1
    return out


@functools.lru_cache(maxsize=1)
def _read(source: str, language: str) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The blanked source and its declarations, kept for who asks next for the same source."""
    text = blanked(source, LANGUAGES[language].quotes)
    return text, _declared(text, LANGUAGES[language])


def code_chunks(source: str, language: str = "python") -> list[dict]:
    """Functions, types and methods with lines and qualified names; a source without any, or in another language, is one chunk."""
    if language == "python":
        return chunkers.code_chunks(source)
    if language not in LANGUAGES:
        return [{"symbol": "", "kind": "text", "start_line": 1, "end_line": source.count("\n") + 1, "doc": None}]
    text, declared = _read(source, language)
    line = lambda at: text.count("\n", 0, at) + 1
    out = [{"symbol": name, "kind": kind, "start_line": line(a), "end_line": line(max(a, b - 1)), "doc": None} for name, kind, a, b in declared]
    return out or [{"symbol": "", "kind": "module", "start_line": 1, "end_line": source.count("\n") + 1, "doc": None}]


def code_edges(source: str, language: str = "python") -> list[tuple[str, str, str]]:
    """(from symbol, to symbol, kind) of imports and of calls, each from the innermost declaration that holds it."""
    if language == "python":
        return chunkers.code_edges(source)
    if language not in LANGUAGES:
        return []
    own = LANGUAGES[language]
    text, declared = _read(source, language)
    out = [("", m[1], "imports") for p in own.imports for m in re.finditer(p, source, re.MULTILINE)]
    for m in re.finditer(r"([A-Za-z_$][\w$]*)\s*\(", text):
        inside = [(b - a, name, a, kind) for name, kind, a, b in declared if a <= m.start() < b]
        scope, begin, kind = min(inside)[1:] if inside else ("", -1, "")
        opened = text.find("{", begin) if inside else -1
        # keywords, an interface's methods and a declaration's own name are no calls
        if m[1] not in NO_CALLS and kind != "interface" and not (inside and scope.rsplit(".", 1)[-1] == m[1] and m.start() < opened):
            out.append((scope, m[1], "calls"))
    return out
