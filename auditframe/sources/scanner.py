"""One pass over source text: what is code, comment or string, which brackets belong together, where statements end.

A small machine reads a file once from left to right. Brackets are matched on a stack; one that never finds its partner
counts as plain text, so broken code keeps its lines apart. Work and memory are linear in the length of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = {
    "js": re.compile(
        r"(?P<c>//[^\n]*|/\*)"
        r"|(?P<s>\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'|`(?:[^`\\]|\\[\s\S])*+`)"
        r"|(?P<r>/)|(?P<b>[()\[\]{}])|(?P<n>\n)|(?P<e>[;,])|\\[^\n]"
    ),
    "py": re.compile(
        r"(?P<c>#[^\n]*)"
        r"|(?P<s>\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
        r"|\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+')"
        r"|(?P<b>[()\[\]{}])|(?P<g>\\\r?\n)|(?P<n>\n)|(?P<e>[;,])"
    ),
}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*")
# A slash begins a pattern, and a brace an object, where a value is expected.
_VALUE_NEXT = re.compile(r"(?:[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|do|else))$")
_OBJECT_NEXT = re.compile(r"(?:[(,=\[?&|]|\b(?:return|import|export|const|let|var|default|typeof))$")
_GOES_ON = re.compile(r"(?:=>|[=*%&|^?,.~]|(?<!\+)\+|(?<!-)-|\b(?:return|typeof|await|new|in|of))$")
_CONTINUES = re.compile(r"\s*(?:\.(?!\.)|\?|&&|\|\||=(?!>)|%|\+(?!\+)|-(?!-)|:)")
_NESTED = re.compile(r"\([^()]*+\)")
_CONTROL = re.compile(r"\b(?:if|while|switch|with|for|for\s+await)\s*$")
_CLOSES = {")": "(", "]": "[", "}": "{"}


def _lex(text: str, language: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of comments, strings and patterns (c, s), brackets (b), line ends (n, g), separators (e)."""
    out, at, n, find = [], 0, len(text), _TOKENS[language].search
    comments_end = text.rfind("*/")
    while (m := find(text, at)) is not None:
        start, at, kind = m.start(), m.end(), m.lastgroup
        if kind == "c" and m[0] == "/*":
            at = text.index("*/", at) + 2 if start + 2 <= comments_end else n
        elif kind == "r":
            before = start - 1
            while before >= 0 and text[before] in " \t":
                before -= 1
            pattern = _REGEX.match(text, start) if before < 0 or text[before] == "\n" or _VALUE_NEXT.search(text[max(0, before - 7) : before + 1]) else None
            if pattern is None:
                continue
            at, kind = pattern.end(), "s"
        if kind:
            out.append((start, at, kind))
    return out


def _partners(text: str, tokens: list[tuple[int, int, str]]) -> dict[int, int]:
    """Token of the closing bracket for that of the opening one; those without partner are missing."""
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held = {"(": 0, "[": 0, "{": 0}
    for k, (start, _, kind) in enumerate(tokens):
        if kind != "b":
            continue
        bracket = text[start]
        opens = _CLOSES.get(bracket)
        if opens is None:
            stack.append((bracket, k))
            held[bracket] += 1
        elif held[opens]:
            while True:
                other, j = stack.pop()
                held[other] -= 1
                if other == opens:
                    found[j] = k
                    break
    return found


class _Call:
    """A call whose arguments are kept: without comments, and without what stands in their own brackets."""

    def __init__(self, line: int, name: str, start: int) -> None:
        self.line, self.name, self.start, self.args = line, name, start, [[]]

    def add(self, piece: str) -> None:
        self.args[-1].append(piece)


def scan(
    text: str, language: str, calls: frozenset[str] = frozenset(), mark: str | None = None, split: bool = False
) -> tuple[list[tuple[int, str]], list[tuple[int, str, list[str], bool]]]:
    """Statements (line, text) and calls (line, name, arguments, marked) of a source text.

    A statement is a logical line: it goes on while a bracket is open that is no block, where an operator asks for
    more, or where the next line begins with one. Its line is that of its first character. Comments are left out, strings
    stay. With ``split`` it also ends at semicolons and commas outside brackets, where a block begins and ends and behind the
    head of ``if``, ``for`` and the like; objects behind ``=`` then belong to it.

    Calls are those of the methods named in ``calls``. ``marked``: the pattern ``mark`` occurs between the method and the
    closing parenthesis, comments included. Of a call that is never closed, the arguments on its line are listed, and it is
    ``marked``: nothing can be said about what it holds; of several on a line it is the first.
    """
    tokens = _lex(text, language)
    partners = _partners(text, tokens)
    closing = set(partners.values())
    marks = [m.start() for m in re.finditer(mark, text)] if mark and calls else []
    method = re.compile(r"\.\s*(" + "|".join(sorted(calls)) + r")\s*$") if calls else None
    statements: list[tuple[int, str]] = []
    found: list[tuple[int, int, str, list[str], bool]] = []
    stack: list[tuple[str, int, _Call | None]] = []  # (folds or block, closing token, call)
    pieces: list[str] = []
    line = first = 1
    begin = 0  # of the line
    broken = 0  # line of the last call without end
    tail = ""

    def add(piece: str) -> None:
        nonlocal first, tail
        if not pieces:
            piece = piece.lstrip()
            first = line
        if piece:
            pieces.append(piece)
        if kept := piece.rstrip():
            tail = kept[-12:] if len(kept) > 3 else (tail + kept)[-12:]
            if stack and stack[-1][2]:
                stack[-1][2].add(piece)

    def flush() -> None:
        nonlocal tail
        if pieces and (whole := "".join(pieces).strip()):
            statements.append((first, whole))
        pieces.clear()
        tail = ""

    at = 0
    for k, (start, end, kind) in enumerate([*tokens, (len(text), len(text), "n")]):
        if start > at:
            add(text[at:start].replace("\r", ""))
        at, token = end, text[start:end]
        if kind == "c":
            line += token.count("\n")
        elif kind == "s":
            add(token.replace("\r", "").replace("\n", " ") if "\n" in token else token)
            line += token.count("\n")
        elif kind == "b" and k in partners:
            call = None
            if token == "(" and method and (m := method.search(text, max(0, start - 40), start)):
                leads = m.start() - begin < 200 and not text[begin : m.start()].strip()
                call = _Call(first if leads else line, m[1], m.start())
            folds = token != "{" or language == "py"
            if not folds:
                nested = bool(stack) and stack[-1][0] == "folds"
                folds = bool(_OBJECT_NEXT.search(tail)) and (split or not tail.endswith(("=", "return"))) and not tail.endswith("=>")
                folds = folds or (nested and tail.endswith(":"))
            heads = token == "(" and split and not (stack and stack[-1][0] == "folds") and _CONTROL.search(tail)
            add(token)
            stack.append(("head" if heads else "folds" if folds else "block", partners[k], call))
            if split and not folds:
                flush()
        elif kind == "b" and k in closing:
            if split and token == "}" and stack and stack[-1][0] == "block":
                flush()
            while stack:
                sort, close, call = stack.pop()
                if call and close == k:
                    args = [a for a in ("".join(x).strip() for x in call.args)]
                    marked = bisect_left(marks, call.start) < bisect_left(marks, end)
                    found.append((call.start, call.line, call.name, args if len(args) > 1 or args[0] else [], marked))
                if close == k:
                    break
            add(token)
            if sort == "head":
                flush()
        elif kind == "e" and token == "," and stack and stack[-1][2]:
            pieces.append(token)
            tail = ","
            stack[-1][2].args.append([])
        elif kind == "e" and split and not (stack and stack[-1][0] != "block"):
            flush()
        elif kind in ("b", "e"):
            if token == "(" and method and broken < line and (m := method.search(text, max(0, start - 40), start)):
                broken = line
                stop = text.find("\n", end)
                rest = _NESTED.sub("()", text[end : stop if stop >= 0 else len(text)])
                found.append((m.start(), line, m[1], [a.strip() for a in rest.split(",")], True))
            add(token)
        elif kind == "g" or (kind == "n" and pieces and start < len(text) and _goes_on(text, end, language, stack, tail)):
            while pieces and not pieces[-1].strip():
                pieces.pop()
            if pieces:
                pieces[-1] = pieces[-1].rstrip()
            add(" ")
            line, begin = line + 1, end
            while at < len(text) and text[at] in " \t":
                at += 1
        elif kind == "n":
            flush()
            line, begin = line + 1, end
    return statements, [f[1:] for f in sorted(found, key=lambda f: f[0])]


def _goes_on(text: str, end: int, language: str, stack: list, tail: str) -> bool:
    if stack and stack[-1][0] != "block":
        return True
    return language == "js" and (bool(_GOES_ON.search(tail)) or bool(_CONTINUES.match(text, end)) and not tail.endswith(("{", ";")))


def _lists(rows: list[list[tuple]], names: list[str], types: list[pa.DataType]) -> pa.Array:
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    flat = [x for r in rows for x in r]
    columns = [pa.array([x[i] for x in flat], t) for i, t in enumerate(types)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names))


@lru_cache
def _scanned(language: str, methods: frozenset[str], mark: str | None, split: bool):
    def run(content: pa.Array) -> pa.Array:
        rows = [scan(t, language, methods, mark, split) if t else ([], []) for t in content.to_pylist()]
        lines = _lists([r[0] for r in rows], ["line", "text"], [pa.int32(), pa.string()])
        calls = _lists([r[1] for r in rows], ["line", "name", "args", "marked"], [pa.int32(), pa.string(), pa.list_(pa.string()), pa.bool_()])
        return pa.StructArray.from_arrays([lines, calls], ["statements", "calls"])

    return F.arrow_udf(
        run,
        "struct<statements:array<struct<line:int,text:string>>,calls:array<struct<line:int,name:string,args:array<string>,marked:boolean>>>",
    )


def scanned(content: Column, language: str = "js", methods: tuple[str, ...] = (), mark: str | None = None, split: bool = False) -> Column:
    """struct<statements, calls> of a source text as ``scan`` finds them; a null text has none of either."""
    return _scanned(language, frozenset(methods), mark, split)(content)
