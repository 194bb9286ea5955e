"""Text expressions: paragraphs, headers, languages, indexable paths."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SEPARATOR = "\u001f"
#: The outline of a file's language: one entry per extension.
LANGUAGES = {
    "rust": "rs",
    "python": "py",
    "javascript": "js jsx mjs cjs",
    "typescript": "ts mts cts",
    "tsx": "tsx",
    "go": "go",
    "java": "java",
    "csharp": "cs",
    "c": "c h",
    "cpp": "cpp cc cxx hpp hh",
    "ruby": "rb",
    "php": "php",
    "bash": "sh bash",
    "kotlin": "kt kts",
    "swift": "swift",
    "lua": "lua",
    "scala": "scala sc",
    "elixir": "ex exs",
}
BY_EXTENSION = {e: name for name, endings in LANGUAGES.items() for e in endings.split()}
#: The kinds that a filter may name.
SYMBOL_KINDS = ("function", "struct", "enum", "trait", "impl", "module", "const", "static", "type_alias", "class", "interface")


def parse_kind(name: str) -> str:
    """A kind by its name, whatever its case, with ``_``, ``-`` or neither."""
    wanted = name.strip().lower().replace("_", "").replace("-", "")
    for kind in SYMBOL_KINDS:
        if kind.replace("_", "") == wanted:
            return kind
    raise ValueError(f"unknown kind {name!r}")


#: Folders and endings of dependencies, build output and generated files.
SKIPPED_FOLDERS = "target node_modules vendor dist build site-packages third_party".split()
SKIPPED_ENDINGS = ".min.js .min.css .bundle.js -lock.json".split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_paragraphs(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(_col(c), "\n\n"), trim), lambda x: x != "")


def prepend_header(header: Column, pieces: Column) -> Column:
    """The header joins the first piece, or stands alone."""
    first = F.concat(header, F.lit("\n"), F.element_at(pieces, 1))
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1)))
    return F.when(F.size(pieces) > 0, F.concat(F.array(first), rest)).otherwise(F.array(header))


def chunk_id(id: Column | str, ordinal: Column | str) -> Column:
    return F.concat(_col(id), F.lit(CHUNK_SEPARATOR), _col(ordinal).cast("string"))


def parent_of_chunk(c: Column | str) -> Column:
    """``id, ordinal`` of a chunk id; without a separator, or with a bad
    number, the ordinal is 0."""
    c, last = _col(c), F.substring_index(_col(c), CHUNK_SEPARATOR, -1)
    there = F.contains(c, F.lit(CHUNK_SEPARATOR))
    id = F.when(there, F.substring(c, F.lit(1), F.length(c) - F.length(last) - 1)).otherwise(c)
    number = F.when(there & last.rlike(r"\A[0-9]{1,18}\z"), last).otherwise(F.lit("0"))
    return F.struct(id.alias("id"), number.cast("long").alias("ordinal"))


def language_of(path: Column | str) -> Column:
    """The language of a path's last extension, or ``unknown``."""
    ending = F.regexp_extract(_col(path), r"[^/]\.([^./]*)$", 1)
    table = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.element_at(table, ending), F.lit("unknown"))


def is_indexable(path: Column | str, include: Sequence[str] = ()) -> Column:
    """Whether a path belongs in an index.  An included prefix of whole
    components always does; else no component may be hidden or a folder of
    dependencies, nor the name have a generated file's ending."""
    path = _col(path)
    bad_part = F.exists(F.split(path, "/"), lambda x: x.startswith(".") | x.isin(SKIPPED_FOLDERS))
    name = F.substring_index(path, "/", -1)
    bad_name = F.lit(False)
    for ending in SKIPPED_ENDINGS:
        bad_name = bad_name | name.endswith(ending)
    wanted = F.lit(False)
    for raw in include:
        prefix = raw.replace("\\", "/").rstrip("/")
        if prefix:
            wanted = wanted | (path == prefix) | path.startswith(prefix + "/")
    return wanted | ~(bad_part | bad_name)


def should_descend(folder: Column | str, include: Sequence[str] = ()) -> Column:
    """Whether a walk has to enter a folder: it is indexable itself or leads to
    an included prefix."""
    folder = _col(folder)
    leads = F.lit(False)
    for raw in include:
        prefix = raw.replace("\\", "/").rstrip("/")
        leads = leads | F.lit(prefix + "/").startswith(F.concat(folder, F.lit("/")))
    return is_indexable(folder, include) | leads


def in_tests(path: Column | str) -> Column:
    return F.array_contains(F.split(_col(path), "/"), "tests")


def document_text(node: object) -> str:
    """The text of a nested rich-text document (objects with ``text``,
    ``content`` and ``type``), a line per paragraph and heading."""
    out: list[str] = []
    stack: list[object] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            stack.extend(y for y in reversed(x) if not isinstance(y, str))
        elif isinstance(x, dict):
            if x.get("type") in ("paragraph", "heading"):
                stack.append("\n")
            if isinstance(x.get("content"), (dict, list)):
                stack.append(x["content"])
            if isinstance(x.get("text"), str):
                out.append(x["text"])
    return "".join(out).rstrip()


def _rich_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: document_text(json.loads(x)), na_action="ignore")


def rich_text(c: Column | str) -> Column:
    """``document_text`` of JSON strings; null stays null."""
    return F.pandas_udf(_rich_text, "string")(c)
