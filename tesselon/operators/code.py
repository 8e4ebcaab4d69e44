"""Symbol chunks of source files: declarations with their bodies, windows where a file has none."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

BRACES = {"ts", "tsx", "js", "jsx", "mjs", "go", "rs", "java", "kt"}
_DECLARED = {
    "py": re.compile(r"^(?P<indent>[ \t]*)(?:async\s+)?(?P<kind>def|class)\s+(?P<name>[A-Za-z_]\w*)", re.M),
    "go": re.compile(r"^(?P<kind>func)\s+(?:\([^)]*\)\s*)?(?P<name>[A-Za-z_]\w*)|^type\s+(?P<type>[A-Za-z_]\w*)\s+(?:struct|interface)", re.M),
    "rs": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?P<kind>fn|struct|enum|trait)\s+(?P<name>[A-Za-z_]\w*)", re.M),
    "java": re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|override|suspend|open)\s+)*(?:(?P<kind>class|interface|enum|fun|object)\s+(?P<name>[A-Za-z_]\w*)|[\w<>\[\], ]+?\s(?P<method>[a-z]\w*)\s*\([^;{}]*\)\s*(?:throws[^{;]*)?(?=\{))", re.M),
    "ts": re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?P<kind>function|class|interface|enum)\s+(?P<name>[A-Za-z_$][\w$]*)|^[ \t]*(?:export\s+)?const\s+(?P<arrow>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n{]+)?=>\s*(?=\{)", re.M),
}
for _a, _b in (("tsx", "ts"), ("js", "ts"), ("jsx", "ts"), ("mjs", "ts"), ("kt", "java")):
    _DECLARED[_a] = _DECLARED[_b]
# a string, a comment or a bracket, whichever comes first
_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[{}()\[\]]", re.S)
_PAIR = {"}": "{", ")": "(", "]": "["}


def braced_end(code: str, start: int) -> int | None:
    """CHK-05: end of the first braced block from ``start`` on, strings and comments skipped; None on a mismatch."""
    stack: list[str] = []
    for m in _TOKEN.finditer(code, start):
        t = m[0]
        if t in "{([":
            stack.append(t)
        elif t in _PAIR:
            if not stack or stack.pop() != _PAIR[t]:
                return None
            if t == "}" and not stack:
                return m.end()
    return None


def indented_end(code: str, start: int, indent: int) -> int:
    """CHK-05: end of an indented block: the last line deeper than its header, a tab being two columns."""
    end = code.find("\n", start)
    if end < 0:
        return len(code)
    last, at = end, end + 1
    while at < len(code):
        stop = code.find("\n", at)
        stop = len(code) if stop < 0 else stop
        line = code[at:stop]
        if line.strip():
            if len(line[: len(line) - len(line.lstrip())].replace("\t", "  ")) <= indent:
                break
            last = stop
        at = stop + 1
    return last


def symbols(language: str, code: str) -> list[tuple[str, str, int, int]]:
    """CHK-04: (name, kind, start, end) of declarations at their outermost level, in order."""
    pattern, out, covered = _DECLARED.get(language), [], 0
    if pattern is None:
        return []
    for m in pattern.finditer(code):
        if m.start() < covered:
            continue
        g = m.groupdict()
        name = next(v for k in ("name", "type", "arrow", "method") if (v := g.get(k)))
        kind = "class" if g.get("kind") in ("class", "interface", "struct", "trait", "enum", "object") or g.get("type") else "function"
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        if language == "py":
            indent = len(g["indent"].replace("\t", "  "))
            end = indented_end(code, m.end(), indent)
        else:
            end = braced_end(code, m.end())
        if end:
            out.append((name, kind, begin, end))
            covered = end
    return out


def symbol_chunks(files: DataFrame) -> DataFrame:
    """CHK-03: (path, symbol, symbol_kind, start_line, end_line, start_offset, text) of (path, language, content); files without
    a declaration are left to the line windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, language, code in zip(b["path"], b["language"], b["content"], strict=True):
                for name, kind, a, z in symbols(language, code or ""):
                    first = code.count("\n", 0, a) + 1
                    out.append((path, name, kind, first, first + code.count("\n", a, z), a, code[a:z]))
            yield pd.DataFrame(out, columns=["path", "symbol", "symbol_kind", "start_line", "end_line", "start_offset", "text"])

    return files.select("path", "language", "content").mapInPandas(
        run, "path string, symbol string, symbol_kind string, start_line int, end_line int, start_offset int, text string"
    )
