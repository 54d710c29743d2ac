"""Entities of source files: functions, classes, variables, imports, calls, comments and docstrings.

Python is parsed with the standard library's ast; JavaScript, TypeScript, Rust, Go, Java, C and C++ by tolerant line
patterns that find definitions, imports and calls. Files that cannot be parsed, and other languages, give one row of
kind "error" or nothing. A definition's parent is the innermost definition around it; qualified names join the names
of definitions with dots. Extraction runs inside mapInPandas, one file at a time, so its memory is that of one file.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["kind", "name", "qualified_name", "parent", "start_line", "end_line", "source", "docstring"]
SCHEMA = "path string, kind string, name string, qualified_name string, parent string, start_line int, end_line int, source string, docstring string"

WORD = r"[A-Za-z_$][\w$]*"
NOT_CALLS = set("if for while switch catch return function match sizeof new await typeof in of fn func def class".split())
#: language -> [(kind, pattern with the name in group 1)]
PATTERNS = {
    "javascript": [
        ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({WORD})"),
        ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({WORD})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{WORD})\s*=>"),
        ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({WORD})"),
        ("variable", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({WORD})\b(?!.*=>)"),
        ("import", r"""^\s*import\b.*?["']([^"']+)["']"""),
        ("import", r"""\brequire\(\s*["']([^"']+)["']"""),
    ],
    "rust": [("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+({WORD})"), ("class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+({WORD})"), ("class", rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?({WORD})"), ("variable", rf"^\s*(?:let|const|static)\s+(?:mut\s+)?({WORD})"), ("import", r"^\s*(?:pub\s+)?use\s+([\w:]+)")],
    "go": [("function", rf"^func\s+(?:\([^)]*\)\s*)?({WORD})"), ("class", rf"^\s*type\s+({WORD})\s+(?:struct|interface)"), ("variable", rf"^\s*(?:var|const)\s+({WORD})"), ("import", r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$')],
    "java": [("class", rf"\b(?:class|interface|enum|record)\s+({WORD})"), ("function", rf"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+({WORD})\s*\("), ("import", r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;")],
    "c": [("function", rf"^[A-Za-z_][\w\s*]*?\b({WORD})\s*\([^;]*$"), ("class", rf"^\s*(?:typedef\s+)?struct\s+({WORD})"), ("import", r'^\s*#\s*include\s+"([^"]+)"')],
}
PATTERNS["typescript"] = [*PATTERNS["javascript"], ("class", rf"^\s*(?:export\s+)?interface\s+({WORD})")]
PATTERNS["cpp"] = [*PATTERNS["c"], ("class", rf"^\s*(?:class|namespace)\s+({WORD})"), ("import", r"^\s*using\s+(?:namespace\s+)?([\w:]+)")]
BLOCK = {"function", "class"}


def _row(kind, name, start, end, source="", docstring=None) -> dict:
    return {"kind": kind, "name": name, "start_line": start, "end_line": end, "source": source, "docstring": docstring}


def python_entities(text: str) -> list[dict]:
    tree, lines = ast.parse(text), text.split("\n")
    out = []
    for node in ast.walk(tree):
        start, end = getattr(node, "lineno", 0), getattr(node, "end_lineno", 0)
        source = "\n".join(lines[start - 1 : end]) if start else ""
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(_row("function", node.name, start, end, source, ast.get_docstring(node)))
        elif isinstance(node, ast.ClassDef):
            out.append(_row("class", node.name, start, end, source, ast.get_docstring(node)))
        elif isinstance(node, ast.Import):
            out += [_row("import", a.name, start, end, source) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append(_row("import", "." * node.level + (node.module or ""), start, end, source))
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    out.append(_row("variable", target.id, start, end, source))
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                out.append(_row("call", name, start, end, source))
    for i, line in enumerate(lines, 1):
        if line.lstrip().startswith("#"):
            out.append(_row("comment", f"comment_line_{i}", i, i, line.strip().lstrip("# /").strip()))
    if doc := ast.get_docstring(tree):
        out.append(_row("docstring", "module", 1, 1, doc))
    return out


def block_end(lines: list[str], start: int) -> int:
    """Last line (1-based) of the braces that open at or after line `start`; `start` itself without any."""
    depth, opened = 0, False
    for i in range(start - 1, len(lines)):
        for c in lines[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
        if opened and depth <= 0:
            return i + 1
        if not opened and ";" in lines[i]:
            return i + 1
    return start


def pattern_entities(text: str, language: str) -> list[dict]:
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines, 1):
        stripped = line.strip()
        if stripped.startswith(("//", "/*", "*")):
            out.append(_row("comment", f"comment_line_{i}", i, i, stripped.lstrip("/* ").strip()))
            continue
        found = set()
        for kind, pattern in PATTERNS[language]:
            m = re.search(pattern, line)
            if m and m[1] not in NOT_CALLS and (kind, m[1]) not in found:
                found.add((kind, m[1]))
                end = block_end(lines, i) if kind in BLOCK else i
                out.append(_row(kind, m[1], i, end, "\n".join(lines[i - 1 : end])))
        defined = {n for k, n in found if k == "function"}
        for m in re.finditer(rf"({WORD})\s*\(", line):
            if m[1] not in NOT_CALLS and m[1] not in defined:
                out.append(_row("call", m[1], i, i, stripped))
    return out


def nested(rows: list[dict]) -> list[dict]:
    """Adds parent and qualified_name from the innermost other definition around each entity."""
    rows = sorted(rows, key=lambda r: (r["start_line"], -r["end_line"], r["kind"], r["name"]))
    open_: list[dict] = []
    for r in rows:
        while open_ and open_[-1]["end_line"] < r["start_line"]:
            open_.pop()
        around = next((o for o in reversed(open_) if o["end_line"] >= r["end_line"]), None)
        r["parent"] = around["qualified_name"] if around else None
        r["qualified_name"] = f"{r['parent']}.{r['name']}" if around and r["kind"] in (*BLOCK, "variable") else r["name"]
        if r["kind"] in BLOCK:
            open_.append(r)
    return rows


def entities(text: str, language: str) -> list[dict]:
    """Entities of one text; an "error" row if it cannot be parsed; none for languages without extractor."""
    try:
        found = python_entities(text) if language == "python" else pattern_entities(text, language) if language in PATTERNS else []
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{**_row("error", type(e).__name__, 0, 0, str(e)), "parent": None, "qualified_name": None}]
    return nested(found)


def extract(files: DataFrame) -> DataFrame:
    """files (path, language, text) -> a row for each entity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p, **r} for p, lang, text in zip(batch["path"], batch["language"], batch["text"], strict=True) for r in entities(text or "", lang or "")]
            yield pd.DataFrame(rows, columns=["path", *COLUMNS])

    return files.select("path", "language", "text").where(F.col("language").isNotNull()).mapInPandas(run, SCHEMA)
