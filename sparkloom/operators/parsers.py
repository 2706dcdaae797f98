"""Facts of one source text, by the standard syntax tree for Python and by patterns for the brace languages; no Spark in here.

``parse(language, text)`` gives imports, symbols, calls, heritage and decorators as lists of tuples in the order of FACTS.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable

FACTS = {
    "imports": "specifier string, names array<string>, is_type_only boolean, is_dynamic boolean",
    "symbols": "name string, kind string, start_line int, end_line int, is_exported boolean, body_hash string, body_tokens array<string>",
    "calls": "caller string, object string, callee string, line int, is_new boolean",
    "heritage": "name string, base string, relation string",
    "decorators": "target string, name string",
}
#: Words before a bracket that are no calls.
NO_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "match", "fn", "func", "super", "typeof", "await", "new", "sizeof", "loop", "else", "class", "def", "with", "and", "or", "not", "in", "import", "require"}
_CALL = re.compile(r"(?:\b(new)\s+)?(?:\b([A-Za-z_]\w*)\s*(?:\.|::)\s*)?\b([A-Za-z_]\w*)\s*(?:<[\w, ]*>)?\(")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _blank(text: str, lifetimes: bool = False) -> str:
    """The text with comments and string contents replaced by blanks, lines kept; with ``lifetimes`` a quote before a name that none closes opens nothing."""
    keep = lambda m: re.sub(r"[^\n]", " ", m[0])
    if lifetimes:
        text = re.sub(r"'(?=[A-Za-z_]\w*\b(?!'))", " ", text)
    return re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", keep, text, flags=re.S)


def _end(text: str, at: int) -> int:
    """Where the block that opens at or after ``at`` closes; the end of the line for a body without braces."""
    start = text.find("{", at)
    stop = text.find(";", at)
    if start < 0 or 0 <= stop < start:
        return stop if stop >= 0 else len(text)
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def _symbol(text: str, name: str, kind: str, start: int, end: int, exported: bool) -> tuple:
    body = text[start:end]
    tokens = [w.lower() for w in _WORD.findall(body) if len(w) > 1]
    return (name, kind, text.count("\n", 0, start) + 1, text.count("\n", 0, max(start, end - 1)) + 1, exported, hashlib.sha256(body.encode()).hexdigest()[:16], tokens)


def _names(inside: str) -> list[str]:
    """Names of a list such as ``a, type b, c as d``: what is imported, not what it is called here."""
    out = []
    for part in inside.split(","):
        words = [w for w in re.split(r"\s+", part.strip()) if w and w != "type"]
        if words:
            out.append(words[0])
    return out


def _braced(text: str, spans: list[tuple[str, str, int, bool]], calls_in: bool = True, lifetimes: bool = False) -> tuple[list, list]:
    """Symbols of (name, kind, start, exported) and the calls in functions and methods, each call given to the innermost."""
    plain = _blank(text, lifetimes)
    symbols, owners = [], []
    for name, kind, start, exported in spans:
        end = _end(plain, start)
        symbols.append(_symbol(text, name, kind, start, end, exported))
        if kind in ("function", "method", "component"):
            owners.append((start, end, name))
    calls = []
    for m in _CALL.finditer(plain) if calls_in else ():
        if m[3] in NO_CALLS and not m[2]:
            continue
        around = [o for o in owners if o[0] < m.start() < o[1]]
        if around:
            start, _, caller = max(around)
            if not (m[3] == caller and plain.count("\n", start, m.start()) == 0 and not m[2] and plain.find("{", start) > m.start()):
                calls.append((caller, m[2], m[3], plain.count("\n", 0, m.start()) + 1, bool(m[1])))
    return symbols, calls


def _typescript(text: str) -> dict[str, list]:
    imports = []
    for m in re.finditer(r"(?m)^\s*(?:import|export)\s+(type\s+)?((?:[^'\";]|\n)*?)\s*from\s*['\"]([^'\"]+)['\"]", text):
        what, names = m[2].strip(), []
        braces = re.search(r"\{([^}]*)\}", what)
        if braces:
            names += _names(braces[1])
        head = what.split("{")[0].strip().rstrip(",")
        if star := re.match(r"\*\s+as\s+(\w+)", head):
            names.append(f"* as {star[1]}")
        elif head == "*":
            names.append("*")
        elif head:
            names.append(head)
        imports.append((m[3], names, bool(m[1]), False))
    imports += [(m[1], [], False, False) for m in re.finditer(r"(?m)^\s*import\s*['\"]([^'\"]+)['\"]", text)]
    imports += [(m[1], [], False, True) for m in re.finditer(r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)", text)]
    imports += [(m[2], _names(m[1].replace(":", " ")) if m[1] else [], False, False) for m in re.finditer(r"(?:\{([^}]*)\}\s*=\s*)?\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", text)]
    plain = _blank(text)
    listed = {n for m in re.finditer(r"\bexport\s*\{([^}]*)\}(?!\s*from)", plain) for n in _names(m[1])}
    spans = []
    for pattern, kind in (
        (r"(export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function"), (r"(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"(export\s+)?interface\s+(\w+)", "interface"),
        (r"(export\s+)?type\s+(\w+)\s*(?:<[^=]*>)?\s*=", "type"), (r"(export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)", "function"),
    ):
        for m in re.finditer(r"(?m)^\s*" + pattern, plain):
            if len(m[2]) >= 2 and not m[2].startswith("_"):
                body = text[m.start() : _end(plain, m.start())]
                shown = "component" if kind == "function" and m[2][0].isupper() and re.search(r"return\s*\(?\s*<\w|=>\s*\(?\s*<\w", body) else kind
                spans.append((m[2], shown, m.start() + len(m[0]) - len(m[0].lstrip()), bool(m[1]) or m[2] in listed))
    for c in re.finditer(r"\bclass\s+\w+[^{]*\{", plain):
        for m in re.compile(r"(?m)^\s+(?:(?:public|private|protected|static|async|override)\s+)*(\w+)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{;]+)?\{").finditer(plain, c.end(), _end(plain, c.start())):
            if m[1] not in NO_CALLS and m[1] != "constructor" and len(m[1]) >= 2 and not m[1].startswith("_"):
                spans.append((m[1], "method", m.start() + len(m[0]) - len(m[0].lstrip()), False))
    heritage = []
    for m in re.finditer(r"\b(?:class|interface)\s+(\w+)(?:<[^>{]*>)?([^{]*)\{", plain):
        for relation, bases in re.findall(r"\b(extends|implements)\s+([\w.<>,\s]+?)(?=\bimplements\b|$)", m[2]):
            heritage += [(m[1], re.sub(r"<.*", "", b).strip(), relation) for b in re.sub(r"<[^<>]*>", "", bases).split(",") if b.strip()]
    decorators = [(m[2], m[1]) for m in re.finditer(r"@(\w+)(?:\([^)]*\))?\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class\s+|async\s+)?(\w+)", plain)]
    symbols, calls = _braced(text, spans)
    return {"imports": imports, "symbols": symbols, "calls": calls, "heritage": heritage, "decorators": decorators}


def _python(text: str) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in FACTS}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out
    lines = text.split("\n")
    name_of = lambda n: n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else name_of(n.func) if isinstance(n, ast.Call) else None

    def walk(node: ast.AST, owner: str | None, in_class: bool, types_only: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.Import):
                out["imports"] += [(a.name, [], types_only, False) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out["imports"].append(("." * n.level + (n.module or ""), [a.name for a in n.names], types_only, False))
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if in_class else "function"
                if len(n.name) >= 2 and not n.name.startswith("_"):
                    body = "\n".join(lines[n.lineno - 1 : n.end_lineno])
                    s = _symbol(body, n.name, kind, 0, len(body), True)
                    out["symbols"].append((n.name, kind, n.lineno, n.end_lineno, True, s[5], s[6]))
                out["decorators"] += [(n.name, d) for d in map(name_of, n.decorator_list) if d]
                if isinstance(n, ast.ClassDef):
                    out["heritage"] += [(n.name, b, "extends") for b in map(name_of, n.bases) if b and b != "object"]
                    out["heritage"] += [(n.name, b, "metaclass") for k in n.keywords if k.arg == "metaclass" and (b := name_of(k.value))]
                walk(n, n.name if kind != "class" else owner, kind == "class", types_only)
                continue
            elif isinstance(n, ast.Call) and owner and (callee := name_of(n.func)):
                of = n.func.value.id if isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) else None
                out["calls"].append((owner, of, callee, n.lineno, callee[0].isupper()))
            guarded = isinstance(n, ast.If) and name_of(n.test) == "TYPE_CHECKING"
            walk(n, owner, in_class, types_only or guarded)

    walk(tree, None, False, False)
    return out


def _go(text: str) -> dict[str, list]:
    plain = _blank(text)
    imports = [(m, [], False, False) for m in re.findall(r'(?m)^import\s+(?:\w+\s+)?"([^"]+)"', text)]
    imports += [(s, [], False, False) for m in re.finditer(r"(?s)^import\s*\((.*?)\)", text, re.M | re.S) for s in re.findall(r'"([^"]+)"', m[1])]
    spans = [(m[2], "method" if m[1] else "function", m.start(), m[2][0].isupper()) for m in re.finditer(r"(?m)^func\s+(\([^)]*\)\s*)?(\w+)", plain) if not m[2].startswith("_")]
    spans += [(m[1], {"struct": "struct", "interface": "interface"}.get(m[2], "type"), m.start(), m[1][0].isupper()) for m in re.finditer(r"(?m)^type\s+(\w+)\s+(\w+)", plain)]
    heritage = []
    for m in re.finditer(r"(?ms)^type\s+(\w+)\s+(struct|interface)\s*\{(.*?)^\}", plain):
        heritage += [(m[1], b, "embeds" if m[2] == "struct" else "extends") for b in re.findall(r"(?m)^\s+\*?(?:\w+\.)?([A-Z]\w*)\s*$", m[3])]
    symbols, calls = _braced(text, spans)
    return {"imports": imports, "symbols": symbols, "calls": calls, "heritage": heritage, "decorators": []}


def _rust(text: str) -> dict[str, list]:
    plain = _blank(text, lifetimes=True)
    imports = []

    def tree(prefix: str, rest: str) -> None:
        rest = rest.strip()
        if m := re.match(r"^(.*?)(?:::)?\{(.*)\}$", rest, re.S):
            depth, part = 0, ""
            for c in m[2] + ",":
                depth += (c == "{") - (c == "}")
                if c == "," and not depth:
                    if part.strip():
                        tree("::".join(x for x in (prefix, m[1]) if x), part)
                    part = ""
                else:
                    part += c
            return
        full = "::".join(x for x in (prefix, re.sub(r"\s+as\s+\w+$", "", rest)) if x)
        head, _, last = full.rpartition("::")
        imports.append((full, [], False, False) if last in ("", "*") and not head else (head or last, [] if last == "*" else [last], False, False))

    for m in re.finditer(r"(?ms)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", plain):
        tree("", m[1])
    imports += [(f"mod::{m}", [], False, False) for m in re.findall(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", plain)]
    inside = [(m.start(), _end(plain, m.start())) for m in re.finditer(r"(?m)^\s*impl\b", plain)]
    spans = []
    for m in re.finditer(r"(?m)(?:^|[{};])\s*(pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*(fn|struct|enum|trait)\s+(\w+)", plain):
        kind = {"fn": "function"}.get(m[2], m[2])
        at = m.start(1) if m[1] else m.start(2)
        if kind == "function" and any(a < at < b for a, b in inside):
            kind = "method"
        if len(m[3]) >= 2 and not m[3].startswith("_"):
            spans.append((m[3], kind, at, bool(m[1])))
    heritage = [(m[2], m[1], "implements") for m in re.finditer(r"(?m)^\s*impl(?:<[^>]*>)?\s+(?:\w+::)*(\w+)(?:<[^>]*>)?\s+for\s+(\w+)", plain)]
    heritage += [(m[1], b.strip(), "extends") for m in re.finditer(r"\btrait\s+(\w+)\s*:\s*([\w\s+:]+)\{", plain) for b in m[2].split("+") if b.strip()]
    decorators = [(m[2], d.strip()) for m in re.finditer(r"#\[derive\(([^)]*)\)\]\s*(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)", plain) for d in m[1].split(",") if d.strip()]
    symbols, calls = _braced(text, spans, lifetimes=True)
    return {"imports": imports, "symbols": symbols, "calls": calls, "heritage": heritage, "decorators": decorators}


def _java(text: str) -> dict[str, list]:
    plain = _blank(text)
    imports = []
    for path in re.findall(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", plain):
        imports.append((path.removesuffix(".*"), [] if path.endswith(".*") else [path.rpartition(".")[2]], False, False))
    spans, heritage = [], []
    for m in re.finditer(r"(?m)^\s*((?:public|protected|private|abstract|static|final|sealed)\s+)*(class|interface|enum|record)\s+(\w+)(?:<[^>{]*>)?([^{]*)\{", plain):
        kind = {"record": "class"}.get(m[2], m[2])
        spans.append((m[3], kind, m.start() + len(m[0]) - len(m[0].lstrip()), "public" in m[0].split(m[2])[0]))
        for relation, bases in re.findall(r"\b(extends|implements)\s+([\w.<>,\s]+?)(?=\bimplements\b|\bpermits\b|$)", m[4]):
            heritage += [(m[3], b.strip().rpartition(".")[2], relation) for b in re.sub(r"<[^<>]*>", "", bases).split(",") if b.strip()]
    for m in re.finditer(r"(?m)^\s+((?:(?:public|protected|private|abstract|static|final|synchronized|default)\s+)*)(?:<[^>]+>\s*)?(?:[\w<>\[\],.?]+\s+)?(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s.]+)?\{", plain):
        if m[2] not in NO_CALLS and len(m[2]) >= 2:
            spans.append((m[2], "method", m.start() + len(m[0]) - len(m[0].lstrip()), "public" in m[1]))
    decorators = [(m[2], m[1]) for m in re.finditer(r"@(\w+)(?:\([^)]*\))?\s+(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|abstract|static|final)\s+)*(?:class|interface|enum|record|[\w<>\[\]]+)\s+(\w+)", plain) if m[1] != "interface"]
    symbols, calls = _braced(text, spans)
    return {"imports": imports, "symbols": symbols, "calls": calls, "heritage": heritage, "decorators": decorators}


PARSERS: dict[str, Callable[[str], dict[str, list]]] = {"typescript": _typescript, "javascript": _typescript, "python": _python, "go": _go, "rust": _rust, "java": _java}


def parse(language: str | None, text: str | None) -> dict[str, list]:
    """Facts of a text; empty ones for unknown languages and empty texts."""
    f = PARSERS.get(language or "")
    return f(text) if f and text else {k: [] for k in FACTS}
