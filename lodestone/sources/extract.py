"""Extraction of symbols, references and document keys from source files.

Python goes through the standard library's ast; Go and TypeScript through a declaration scanner that knows comments,
strings and brace depth, a documented subset: top-level declarations, class members, imports, calls and constructions.
Files are dealt to tasks as rows (path, content); everything a file yields is a row of one of three kinds.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "path string, what string, name string, qualified string, kind string, start_line int, start_col int, end_line int, end_col int, signature string, docstring string, visibility string, parent string, src string, dst string, line int, col int, key string, value string"
_FIELDS = [x.split()[0] for x in ROWS.split(", ")]
SYMBOL_FILES = {".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript"}
#: The sections of package.json that list dependencies.
DEPENDENCIES = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
_NOT_CALLS = {"if", "for", "while", "switch", "return", "func", "function", "catch", "typeof", "await", "range", "go", "defer", "select", "else", "new", "super", "constructor", "case", "in", "of", "interface", "struct", "map", "chan", "make"}


def module_name(path: str) -> str:
    base = path.rsplit("/", 1)[-1]
    return re.sub(r"(\.d\.ts|\.[^.]*)$", "", base)


def language_of(path: str) -> str:
    dot = path.rfind(".")
    return SYMBOL_FILES.get(path[dot:], "") if dot >= 0 else ""


def document_kind(path: str) -> str | None:
    parts = path.split("/")
    if parts[-1] == "package.json":
        return "package_json_deps"
    if parts[-1] == "go.mod":
        return "go_mod_requires"
    return "i18n_json" if parts[-1].endswith(".json") and any(p in ("locales", "i18n") for p in parts[:-1]) else None


def _symbol(path, name, qualified, kind, start, end, signature="", doc="", visibility="public", parent=""):
    return {"path": path, "what": "symbol", "name": name, "qualified": qualified, "kind": kind, "start_line": start[0], "start_col": start[1], "end_line": end[0], "end_col": end[1], "signature": signature, "docstring": doc, "visibility": visibility, "parent": parent}


def _ref(path, src, dst, kind, line, col):
    return {"path": path, "what": "ref", "src": src, "dst": dst, "kind": kind, "line": line, "col": col}


# --- Python ---


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    return None


def parse_python(path: str, text: str) -> list[dict]:
    tree, module, out = ast.parse(text), module_name(path), []
    lines = text.split("\n")
    hidden = lambda n: "private" if n.startswith("_") and not (n.startswith("__") and n.endswith("__")) else "public"

    def declare(node, owner: str, kind: str) -> str:
        name = f"{owner}.{node.name}"
        out.append(_symbol(path, node.name, name, kind, (node.lineno, node.col_offset + 1), (node.end_lineno, node.end_col_offset + 1), lines[node.lineno - 1].strip().rstrip(":"), ast.get_docstring(node) or "", hidden(node.name), owner if owner != module else ""))
        return name

    def calls(node, src: str) -> None:
        for x in ast.walk(node):
            if isinstance(x, ast.Call) and (dst := _dotted(x.func)):
                out.append(_ref(path, src, dst, "call", x.lineno, x.col_offset + 1))

    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        if isinstance(node, functions):
            calls(node, declare(node, module, "function"))
        elif isinstance(node, ast.ClassDef):
            name = declare(node, module, "class")
            for b in node.bases:
                if dst := _dotted(b):
                    out.append(_ref(path, name, dst, "inherit", node.lineno, node.col_offset + 1))
            for item in node.body:
                calls(item, declare(item, name, "method") if isinstance(item, functions) else name)
        elif isinstance(node, ast.Import):
            out += [_ref(path, "", a.name, "import", node.lineno, node.col_offset + 1) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [_ref(path, "", f"{'.' * node.level}{node.module or ''}", "import", node.lineno, node.col_offset + 1)]
        else:
            calls(node, "")
    return out


# --- Go and TypeScript ---


def blanked(text: str, ticks: bool) -> str:
    """The text with comments and the insides of strings blanked, so that braces and names left are code."""
    pattern = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'" + (r"|`[^`]*`" if ticks else "")
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] in "/" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], text, flags=re.S)


def _close(code: str, start: int) -> int:
    """Where the brace group that opens at or after start on the declaration ends; the line's end without one."""
    depth, i = 0, start
    while i < len(code):
        c = code[i]
        if c in "{(":
            depth += 1
        elif c in "})":
            depth -= 1
            if depth == 0 and c == "}":
                return i + 1
        elif c == "\n" and depth == 0:
            return i
        i += 1
    return len(code)


class _Places:
    def __init__(self, text: str):
        self.feeds = [m.start() for m in re.finditer("\n", text)]

    def __call__(self, at: int) -> tuple[int, int]:
        from bisect import bisect_left

        line = bisect_left(self.feeds, at)
        return line + 1, at - (self.feeds[line - 1] + 1 if line else 0) + 1


def _doc_above(text: str, at: int) -> str:
    found, rows = [], text[:at].split("\n")[:-1]
    while rows and rows[-1].strip().startswith(("//", "*", "/*")):
        found.append(rows.pop().strip().lstrip("/* ").rstrip("*/ "))
    return "\n".join(reversed(found)).strip()


def _calls(path: str, code: str, owners: list[tuple[int, int, str]], where: _Places) -> list[dict]:
    out = []
    for m in re.finditer(r"(?<![\w.])(new\s+)?([A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*\(", code):
        name = re.sub(r"\s", "", m[2])
        if name in _NOT_CALLS or re.search(r"(?:func|function|get|set)\s+$", code[: m.start()][-12:]) or re.search(r"func\s*\([^)]*\)\s*$", code[: m.start()][-80:]):
            continue
        inside = [o for o in owners if o[0] <= m.start() < o[1]]
        if inside and any(m.start(2) == o[0] for o in inside):
            continue
        out.append(_ref(path, max(inside, key=lambda o: o[0])[2] if inside else "", name, "call", *where(m.start())))
    return out


def parse_go(path: str, text: str) -> list[dict]:
    code, where, out, owners = blanked(text, True), _Places(text), [], []
    package = (re.search(r"^package\s+(\w+)", code, re.M) or ["", module_name(path)])[1]
    seen = lambda n: "public" if n[:1].isupper() else "private"
    first_line = lambda at: text[at : text.find("\n", at) if "\n" in text[at:] else len(text)].rstrip(" {")
    for m in re.finditer(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)", code, re.M):
        end = _close(code, m.end())
        owner = f"{package}.{m[1]}" if m[1] else package
        name = f"{owner}.{m[2]}"
        out.append(_symbol(path, m[2], name, "method" if m[1] else "function", where(m.start()), where(end), first_line(m.start()), _doc_above(text, m.start()), seen(m[2]), owner if m[1] else ""))
        owners.append((m.start(), end, name))
    for m in re.finditer(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(?:=\s*)?(\w+)?", code, re.M):
        end = _close(code, m.end())
        out.append(_symbol(path, m[1], f"{package}.{m[1]}", "interface" if m[2] == "interface" else "type", where(m.start()), where(end), first_line(m.start()), _doc_above(text, m.start()), seen(m[1])))
    for m in re.finditer(r"^(var|const)\s+(?:(\w+)|\()", code, re.M):
        end = code.find("\n)", m.end()) if not m[2] else _close(code, m.end())
        names = [(m.start(), m[2])] if m[2] else [(m.end() + x.start(1), x[1]) for x in re.finditer(r"^\s*(\w+)", code[m.end() : end], re.M)]
        out += [_symbol(path, n, f"{package}.{n}", m[1], where(at), where(at + len(n)), first_line(at), "", seen(n)) for at, n in names if n != "_"]
    for m in re.finditer(r"^import\s+(?:\(([^)]*)\)|.*)$", code, re.M | re.S if "import (" in code else re.M):
        for x in re.finditer(r"\"([^\"\n]+)\"", text[m.start() : m.end() if m[1] is not None else text.find("\n", m.start())]):
            out.append(_ref(path, "", x[1], "import", *where(m.start() + x.start())))
    for m in re.finditer(r"(?<![\w.])&?([A-Z]\w*(?:\.[A-Z]\w*)?|\w+\.[A-Z]\w*)\s*\{", code):
        inside = [o for o in owners if o[0] < m.start() < o[1]]
        if inside and not re.search(r"\)\s*\*?$|func[^\n{]*$", code[code.rfind("\n", 0, m.start()) + 1 : m.start()]):
            out.append(_ref(path, inside[-1][2], m[1], "type_ref", *where(m.start())))
    return out + _calls(path, code, owners, where)


def parse_typescript(path: str, text: str) -> list[dict]:
    code, where, out, owners, module = blanked(text, True), _Places(text), [], [], module_name(path)
    first_line = lambda at: text[at : text.find("\n", at) if "\n" in text[at:] else len(text)].rstrip(" {")
    lead = r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?"

    def add(m, name, kind, parent="", visibility="public", at=None, end=None):
        at = m.start() if at is None else at
        end = _close(code, m.end()) if end is None else end
        qualified = f"{parent or module}.{name}"
        out.append(_symbol(path, name, qualified, kind, where(at), where(end), first_line(at), _doc_above(text, at), visibility, parent))
        return qualified, end

    for m in re.finditer(lead + r"(?:async\s+)?function\s*\*?\s*([\w$]+)", code, re.M):
        q, end = add(m, m[1], "function")
        owners.append((m.start(), end, q))
    for m in re.finditer(lead + r"(interface|type|enum)\s+([\w$]+)", code, re.M):
        add(m, m[2], "interface" if m[1] == "interface" else "type")
    for m in re.finditer(lead + r"(const|let|var)\s+([\w$]+)", code, re.M):
        q, end = add(m, m[2], "const" if m[1] == "const" else "var")
        owners.append((m.start(), end, q))
    for m in re.finditer(lead + r"(?:abstract\s+)?class\s+([\w$]+)([^{]*)\{", code, re.M):
        q, end = add(m, m[1], "class", end=_close(code, m.end() - 1))
        owners.append((m.start(), end, q))
        heads = re.sub(r"<[^<>]*>", "", m[2])
        for part in re.findall(r"(?:extends|implements)\s+([\w$.,\s]+?)(?=extends|implements|$)", heads):
            out += [_ref(path, q, b.strip(), "inherit", *where(m.start())) for b in part.split(",") if b.strip()]
        depth, i, body = 0, m.end(), []
        while i < end - 1:
            if depth == 0:
                x = re.compile(r"[ \t]*((?:(?:public|private|protected|static|readonly|abstract|async|override|get|set|declare)\s+)*)(\*?[ \t]*#?[A-Za-z_$][\w$]*)[ \t]*[?!]?[ \t]*(<[^>(]*>)?[ \t]*(\(|[:=;])").match(code, i)
                if x and (code[i - 1] in "{};\n" or code[:i].rstrip(" \t")[-1:] in "{};\n"):
                    name = x[2].strip("* ")
                    stop = _close(code, x.end() - 1) if x[4] == "(" else code.find("\n", x.end())
                    body.append((x, name, stop if stop > 0 else end))
                    i = stop if stop > 0 else end
                    continue
            depth += {"{": 1, "(": 1, "}": -1, ")": -1}.get(code[i], 0)
            i += 1
        for x, name, stop in body:
            hidden = "private" if "private" in x[1] or "protected" in x[1] or name.startswith(("_", "#")) else "public"
            at = x.start(2) if not x[1] else x.start(1)
            mq, _ = add(x, name, "method" if x[4] == "(" else "var", q, hidden, at, stop)
            if x[4] == "(":
                owners.append((x.start(2), stop, mq))
    for m in re.finditer(r"^(?:import|export)\b[^;\n]*?(?:from\s*)?(['\"])([^\n]*?)\1", text, re.M):
        out.append(_ref(path, "", m[2], "import", *where(m.start())))
    return out + _calls(path, code, owners, where)


# --- documents ---


def parse_document(path: str, text: str, kind: str) -> list[dict]:
    found: list[tuple[str, str, int]] = []
    if kind == "go_mod_requires":
        block = False
        for n, row in enumerate(text.split("\n"), 1):
            row = row.strip()
            block = block or row.startswith("require (")
            m = re.match(r"(?:require\s+)?(\S+)\s+(v\S+)(\s*//\s*indirect)?", row) if block and not row.startswith("require (") or row.startswith("require ") else None
            if m:
                found.append((m[1], m[2] + ("  // indirect" if m[3] else ""), n))
            block = block and row != ")"
        return [{"path": path, "what": "key", "kind": kind, "key": k, "value": v, "line": n} for k, v, n in found]
    data = json.loads(text)
    at = lambda name: text[: max(0, text.find(json.dumps(name, ensure_ascii=False)))].count("\n") + 1
    if kind == "package_json_deps":
        for section in DEPENDENCIES:
            for k, v in (data.get(section) or {}).items():
                if isinstance(v, str):
                    found.append((k, v, at(k)))
    else:

        def leaves(x, prefix: str, last: str) -> None:
            if isinstance(x, str):
                found.append((prefix, x, at(last)))
            for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
                leaves(v, f"{prefix}.{k}" if prefix else str(k), k if isinstance(k, str) else last)

        leaves(data, "", "")
    return [{"path": path, "what": "key", "kind": kind, "key": k, "value": v, "line": n} for k, v, n in sorted(found, key=lambda x: x[0])]


def parse_file(path: str, text: str) -> list[dict]:
    """All that a file yields; parsers of symbols come before those of documents. A file that does not parse yields one
    row of kind error."""
    parsers = {"go": parse_go, "python": parse_python, "typescript": parse_typescript}
    try:
        if language := language_of(path):
            return parsers[language](path, text)
        kind = document_kind(path)
        return parse_document(path, text, kind) if kind else []
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"path": path, "what": "error", "value": str(e)}]


def extract(files: DataFrame) -> DataFrame:
    """Rows of files(path, content); one pass, file by file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, text in zip(batch["path"], batch["content"], strict=True) for r in parse_file(path, text)]
            frame = pd.DataFrame(rows, columns=_FIELDS)
            for c in ("start_line", "start_col", "end_line", "end_col", "line", "col"):
                frame[c] = frame[c].astype("Int32")
            yield frame.astype({c: object for c in _FIELDS if c not in ("start_line", "start_col", "end_line", "end_col", "line", "col")}).where(frame.notna(), None)

    return files.select("path", "content").mapInPandas(run, ROWS)


def symbol_hash(signature: str, body: str) -> str:
    return hashlib.sha256(f"{signature}\0{body}".encode()).hexdigest()


def parse_hash(rows: DataFrame) -> DataFrame:
    """(path, parse_hash): a digest of all that a file yields, whatever the order."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _FIELDS[1:]))
    return rows.groupBy("path").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("parse_hash"))
