"""Calls, assignments and parameters of Go and Python sources, as rows.

Neither language has a parser on the JVM. Go is read by a small tokenizer that
knows comments, strings, nesting and imports; Python by its own ``ast``. Both
run in Arrow batches over whole files, so a file is the unit of work.
"""

from __future__ import annotations

import ast
import json
import re

from pyspark.sql import DataFrame

_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\])+\'|[A-Za-z_]\w*|\d\w*|:=|\.\.\.|.', re.S)

GO_SCHEMA = "path string, kind string, pkg string, scope string, line int, name string, import_path string, func string, args array<string>, targets array<string>"


def _tokens(text: str) -> list[tuple[str, int]]:
    out, line = [], 1
    for m in _TOKEN.finditer(text):
        t = m[0]
        if not t.isspace() and not t.startswith(("//", "/*")):
            out.append((t, line))
        elif t == "\n" and out and out[-1][0] not in ("\n", "(", "{", ",", "[", ".", "=", ":=", "+", "&", "|"):
            out.append(("\n", line))
        line += t.count("\n")
    return out


_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, set(")]}")


def _group(tokens, at: int) -> tuple[list[str], int]:
    """The comma-separated parts of the bracket at ``at``, as text, and the place after it."""
    depth, part, parts, i = 0, [], [], at
    while i < len(tokens):
        t = tokens[i][0]
        if t in _OPEN:
            depth += 1
        elif t in _CLOSE:
            depth -= 1
            if depth == 0:
                break
        if depth == 1 and t == "," and i > at:
            parts.append("".join(part))
            part = []
        elif i > at and t != "\n":
            part.append(t)
        i += 1
    if part:
        parts.append("".join(part))
    return parts, i + 1


def go_rows(path: str, text: str) -> list[tuple]:
    """Rows of one file: ``import``, ``func`` (args are its parameters), ``call``, ``literal`` and ``assign``."""
    tokens = _tokens(text or "")
    rows, imports, pkg, scope, depth, scope_depth = [], {}, "", "", 0, 0
    i = 0
    while i < len(tokens):
        t, line = tokens[i]
        following = tokens[i + 1][0] if i + 1 < len(tokens) else ""
        if t == "package" and depth == 0:
            pkg = following
        elif t == "import" and depth == 0:
            parts, end = _group(tokens, i + 1) if following == "(" else ([], i + 3)
            names = [tokens[k] for k in range(i + 1, end) if k < len(tokens)]
            for k, (x, at) in enumerate(names):
                if x[0] in '"`':
                    alias = names[k - 1][0] if k and re.fullmatch(r"[A-Za-z_]\w*|\.", names[k - 1][0]) else x.strip('"`').split("/")[-1]
                    imports[alias] = x.strip('"`')
                    rows.append((path, "import", pkg, "", at, alias, x.strip('"`'), None, None, None))
            i = end
            continue
        elif t == "func" and depth == 0:
            k = i + 1
            if k < len(tokens) and tokens[k][0] == "(":
                _, k = _group(tokens, k)
            name = tokens[k][0] if k < len(tokens) else ""
            opened, end = k + 1, _group(tokens, k + 1)[1]
            parameters, nest = [], 0
            for j in range(opened, end - 1):
                x = tokens[j][0]
                if j > opened and nest == 1 and (tokens[j - 1][0] == "," or j == opened + 1) and re.match(r"[A-Za-z_]", x):
                    parameters.append(x)
                nest += (x in _OPEN) - (x in _CLOSE)
            while end < len(tokens) and tokens[end][0] != "{":  # results
                end += 1
            scope, scope_depth = name, 0
            rows.append((path, "func", pkg, name, line, name, None, None, parameters, None))
            i = end
            continue
        elif t == "{":
            depth += 1
        elif t == "}":
            depth -= 1
            if depth == scope_depth:
                scope = ""
        elif re.fullmatch(r"[A-Za-z_]\w*", t) and t not in ("if", "for", "switch", "return", "func", "make", "map", "range", "case"):
            owner, name, k = "", t, i + 1
            if following == "." and i + 2 < len(tokens):
                owner, name, k = t, tokens[i + 2][0], i + 3
            after = tokens[k][0] if k < len(tokens) else ""
            chained = i and tokens[i - 1][0] == "."
            if after == "(" and not chained:
                args, _ = _group(tokens, k)
                rows.append((path, "call", pkg, scope, line, owner, imports.get(owner), name, args, None))
            elif after == "{" and owner and not chained:
                fields, _ = _group(tokens, k)
                rows.append((path, "literal", pkg, scope, line, owner, imports.get(owner), name, fields, None))
        if t in (":=", "=") and i:
            j = i - 1
            left = []
            while j >= 0 and (re.fullmatch(r"[A-Za-z_]\w*", tokens[j][0]) or tokens[j][0] == ",") and tokens[j][1] == line:
                left.append(tokens[j][0])
                j -= 1
            k, right = i + 1, []
            nest = 0
            while k < len(tokens) and not (nest == 0 and tokens[k][0] in ("\n", ";", "}")) and len(right) < 400:
                nest += (tokens[k][0] in _OPEN) - (tokens[k][0] in _CLOSE)
                right.append(tokens[k][0])
                k += 1
            targets = [x for x in reversed(left) if x != "," and x != "var"]
            if targets and right:
                rows.append((path, "assign", pkg, scope, line, None, None, None, _split("".join(x for x in right if x != "\n")), targets))
        i += 1
    return rows


def _split(text: str) -> list[str]:
    parts, depth, quoted, part = [], 0, "", ""
    for c in text:
        if quoted:
            quoted = "" if c == quoted else quoted
        elif c in "\"`'":
            quoted = c
        else:
            depth += (c in _OPEN) - (c in _CLOSE)
        if c == "," and not depth and not quoted:
            parts.append(part)
            part = ""
        else:
            part += c
    return parts + [part]


def go_code(files: DataFrame) -> DataFrame:
    """Rows of Go files (path, content); see ``go_rows``. [A17, B7]"""
    import pandas as pd

    names = [f.split()[0] for f in GO_SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"]) for r in go_rows(p, c)], columns=names)

    return files.select("path", "content").mapInPandas(run, GO_SCHEMA)


PY_SCHEMA = "path string, kind string, line int, name string, args array<string>, kwargs map<string,string>"


def python_rows(path: str, text: str) -> list[tuple]:
    """Rows of one Python file: ``import``, ``call`` and ``assign``; a file that does not parse has none."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return []

    def dotted(node) -> str:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            return f"{dotted(node.value)}.{node.attr}".lstrip(".")
        return dotted(node.func) if isinstance(node, ast.Call) else ""

    def value(node) -> str:
        return json.dumps(node.value) if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool, type(None))) else dotted(node)

    rows = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            rows.append((path, "call", node.lineno, dotted(node.func), [value(a) for a in node.args], {k.arg: value(k.value) for k in node.keywords if k.arg}))
        elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            rows.append((path, "assign", node.lineno, node.targets[0].id, [value(node.value)], {}))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            rows += [(path, "import", node.lineno, f"{getattr(node, 'module', None) or ''}.{a.name}".lstrip("."), [a.asname or a.name], {}) for a in node.names]
    return sorted(rows, key=lambda r: (r[2], r[1], r[3]))


def python_code(files: DataFrame) -> DataFrame:
    """Rows of Python files (path, content). [A16]"""
    import pandas as pd

    names = [f.split()[0] for f in PY_SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"]) for r in python_rows(p, c)], columns=names)

    return files.select("path", "content").mapInPandas(run, PY_SCHEMA)
