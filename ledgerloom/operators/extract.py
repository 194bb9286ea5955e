"""Symbols and references of source texts.

Python is read with the standard parser.  Other languages are read by tables
of declaration patterns over text without comments and strings: a heuristic,
stated as such.  Calls belong to the nearest enclosing function.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BY_EXTENSION

Symbol = tuple[str, str, int, int]  # name, kind, first and last line
Reference = tuple[str, str | None, int]  # name, from function, line


class _Python(ast.NodeVisitor):
    def __init__(self) -> None:
        self.symbols: list[Symbol] = []
        self.references: list[Reference] = []
        self.inside: list[str] = []

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.symbols.append((node.name, "function", node.lineno, node.end_lineno or node.lineno))
        for d in node.decorator_list:
            self.visit(d)
        self.inside.append(node.name)
        for child in ast.iter_child_nodes(node):
            if child not in node.decorator_list:
                self.visit(child)
        self.inside.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.symbols.append((node.name, "class", node.lineno, node.end_lineno or node.lineno))
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name:
            self.references.append((name, self.inside[-1] if self.inside else None, node.lineno))
        self.generic_visit(node)


_W = r"([A-Za-z_]\w*)"
_FN = "function"
#: Per language: (pattern, kind).  The first group is the name.
RULES: dict[str, list[tuple[str, str]]] = {
    "rust": [(rf"\bfn\s+{_W}", _FN), (rf"\bstruct\s+{_W}", "struct"), (rf"\benum\s+{_W}", "enum"), (rf"\btrait\s+{_W}", "trait"), (rf"\bimpl\b[^{{;]*?\bfor\s+{_W}", "impl"), (rf"\bimpl(?:<[^>]*>)?\s+{_W}(?![^{{]*\bfor\b)", "impl"), (rf"\bmod\s+{_W}", "module"), (rf"\b(?:const|static)\s+(?:mut\s+)?{_W}\s*:", "const"), (rf"\btype\s+{_W}", "type"), (rf"\bmacro_rules!\s*{_W}", "macro")],
    "go": [(rf"\bfunc\s+(?:\([^)]*\)\s*)?{_W}", _FN), (rf"\btype\s+{_W}\s+struct\b", "struct"), (rf"\btype\s+{_W}\s+interface\b", "interface"), (rf"\btype\s+{_W}\s+(?!struct\b|interface\b)", "type")],
    "java": [(rf"\bclass\s+{_W}", "class"), (rf"\binterface\s+{_W}", "interface"), (rf"\benum\s+{_W}", "enum"), (rf"[\w>\]]\s+{_W}\s*\([^;{{}}()]*\)\s*(?:throws[\w\s.,]*)?\{{", _FN)],
    "csharp": [(rf"\bclass\s+{_W}", "class"), (rf"\bstruct\s+{_W}", "struct"), (rf"\binterface\s+{_W}", "interface"), (rf"\benum\s+{_W}", "enum"), (rf"[\w>\]?]\s+{_W}\s*\([^;{{}}()]*\)\s*(?:\{{|=>)", _FN)],
    "c": [(rf"\bstruct\s+{_W}\s*\{{", "struct"), (rf"\benum\s+{_W}\s*\{{", "enum"), (rf"[\w*]\s+\**{_W}\s*\([^;{{}}()]*\)\s*\{{", _FN)],
    "javascript": [(rf"\bfunction\s*\*?\s*{_W}", _FN), (rf"\bclass\s+{_W}", "class"), (rf"\b(?:const|let|var)\s+{_W}\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>|\w+\s*=>)", _FN), (rf"(?:^|[{{;}}\n])\s*(?:async\s+|static\s+)*{_W}\s*\([^;{{}}()]*\)\s*\{{", _FN)],
    "ruby": [(rf"\bdef\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", _FN), (rf"\bclass\s+{_W}", "class"), (rf"\bmodule\s+{_W}", "module")],
    "php": [(rf"\bfunction\s+&?{_W}", _FN), (rf"\bclass\s+{_W}", "class"), (rf"\binterface\s+{_W}", "interface"), (rf"\btrait\s+{_W}", "trait"), (rf"\benum\s+{_W}", "enum")],
    "bash": [(rf"(?:^|\n)\s*(?:function\s+)?{_W}\s*\(\)\s*\{{", _FN)],
    "kotlin": [(rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?{_W}", _FN), (rf"\binterface\s+{_W}", "interface"), (rf"\b(?:class|object)\s+{_W}", "class")],
    "swift": [(rf"\bfunc\s+{_W}", _FN), (rf"\bclass\s+{_W}", "class"), (rf"\bstruct\s+{_W}", "struct"), (rf"\benum\s+{_W}", "enum"), (rf"\bprotocol\s+{_W}", "interface")],
    "lua": [(r"\bfunction\s+(?:[\w.]+[.:])?([A-Za-z_]\w*)", _FN)],
    "scala": [(rf"\bdef\s+{_W}", _FN), (rf"\b(?:class|object)\s+{_W}", "class"), (rf"\btrait\s+{_W}", "trait")],
    "elixir": [(r"\bdefp?\s+([a-z_]\w*[?!]?)", _FN), (r"\bdefmodule\s+([A-Z][\w.]*)", "module")],
}
RULES["cpp"] = [(rf"\bclass\s+{_W}", "class"), *RULES["c"]]
RULES["typescript"] = RULES["tsx"] = [*RULES["javascript"], (rf"\binterface\s+{_W}", "interface"), (rf"\benum\s+{_W}", "enum"), (rf"\btype\s+{_W}\s*=", "type")]

_WORDS = frozenset("if for while switch match return catch sizeof function fn def func fun when elsif elif else unless until and or not in await yield throw typeof using lock synchronized super loop move".split())
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])'", re.S)
_HASH_NOISE = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_CALL = re.compile(r"([A-Za-z_]\w*)\s*(?:::<[^>]*>)?\(")
_MARKED_CALL = re.compile(r"([A-Za-z_]\w*[?!]?)\(")  # names may end in a mark


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def _end(text: str, at: int, word_ends: bool) -> int:
    """Where the block that begins after ``at`` ends."""
    if word_ends:
        depth = 0
        for m in re.finditer(r"\b(def|class|module|do|function|if|unless|case|while|begin|defp|defmodule|end)\b", text[at:]):
            depth += -1 if m.group() == "end" else 1
            if depth <= 0:
                return at + m.end()
        return len(text)
    depth = 0
    for i in range(at, len(text)):
        c = text[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return i + 1
        elif c == ";" and depth == 0:
            return i + 1
    return text.find("\n", at) if "\n" in text[at:] else len(text)


def extract(language: str | None, source: str) -> tuple[list[Symbol], list[Reference]]:
    """(symbols, references) in source order; nothing for a text that can't be
    parsed or a language that isn't known."""
    if language == "python":
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            return [], []
        found = _Python()
        found.visit(tree)
        return sorted(found.symbols, key=lambda s: s[2]), sorted(found.references, key=lambda r: r[2])
    if language not in RULES:
        return [], []
    hashes = language in ("ruby", "bash", "elixir")
    text = (_HASH_NOISE if hashes else _NOISE).sub(_blank, source)
    if language == "lua":
        text = re.sub(r"--[^\n]*", _blank, text)
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda i: bisect_left(ends, i) + 1
    heads: dict[int, tuple[str, str, int]] = {}
    for pattern, kind in RULES[language]:
        for m in re.finditer(pattern, text):
            if m.group(1) not in _WORDS:
                heads.setdefault(m.start(1), (m.group(1), kind, m.start()))
    symbols, functions = [], []
    for at, (name, kind, start) in sorted(heads.items()):
        stop = _end(text, start if language in ("ruby", "lua", "elixir") else at, language in ("ruby", "lua", "elixir"))
        symbols.append((name, kind, line(at), line(max(at, stop - 1))))
        if kind == _FN:
            functions.append((at, stop, name))
    references = []
    for m in (_MARKED_CALL if language in ("ruby", "elixir") else _CALL).finditer(text):
        if m.group(1) in _WORDS or m.start(1) in heads:
            continue
        around = [f for f in functions if f[0] < m.start() < f[1]]
        references.append((m.group(1), around[-1][2] if around else None, line(m.start())))
    return symbols, references


_SYMBOLS = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64())]))
_REFERENCES = pa.list_(pa.struct([("name", pa.string()), ("from", pa.string()), ("line", pa.int64())]))


def slices(files: DataFrame, isolated: bool = False) -> DataFrame:
    """``path, content`` (bytes of the slice as JSON) of files ``path, content``
    in a known language.  The slice names no path, so equal files share one.
    ``isolated`` parses in child processes: a file that crashes or outlasts
    them is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not isolated:
            yield from parsed(batches, extract)
            return
        from .parse_pool import ParsePool

        pool = ParsePool()
        try:
            yield from parsed(batches, pool.call)
        finally:
            pool.close()

    def parsed(batches: Iterator[pa.RecordBatch], parse) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, symbols, references = [], [], []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = path.rsplit("/", 1)[-1]
                language = BY_EXTENSION.get(name.rsplit(".", 1)[-1]) if "." in name[1:] else None
                if language is None or content is None:
                    continue
                found = parse(language, bytes(content).decode("utf-8", "replace"))
                if found is None:
                    continue
                s, r = found
                paths.append(path)
                symbols.append([dict(zip(("name", "kind", "start_line", "end_line"), x)) for x in s])
                references.append([dict(zip(("name", "from", "line"), x)) for x in r])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(symbols, _SYMBOLS), pa.array(references, _REFERENCES)], names=["path", "symbols", "references"])

    schema = "path string, symbols array<struct<name: string, kind: string, start_line: bigint, end_line: bigint>>, references array<struct<name: string, from: string, line: bigint>>"
    made = files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)
    return made.select("path", F.to_json(F.struct("symbols", "references"), {"ignoreNullFields": "false"}).cast("binary").alias("content"))
