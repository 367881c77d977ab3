"""Python sources by the standard library's syntax tree.

Where a file as a whole does not parse, its top-level blocks are parsed one by one and those that fail
are left out. A file of which nothing parses is an error."""

from __future__ import annotations

import ast
import hashlib
import re

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_QUOTED = re.compile(
    r"""#[^\n]*|\"{3}(?:\\.|[^\\])*?\"{3}|'{3}(?:\\.|[^\\])*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S
)
_GOES_ON = re.compile(r"[\s)\]}#]|(?:else|elif|except|finally)\b")


def _segment(node: ast.AST, lines: list[str]) -> str:
    """A node's own text; columns are offsets into a line's UTF-8 bytes."""
    first, last = node.lineno - 1, (node.end_lineno or node.lineno) - 1
    if first == last:
        return lines[first].encode()[node.col_offset : node.end_col_offset].decode("utf-8", "replace")
    ends = lines[first].encode()[node.col_offset :], lines[last].encode()[: node.end_col_offset]
    return ends[0].decode("utf-8", "replace") + "".join(lines[first + 1 : last]) + ends[1].decode("utf-8", "replace")


def _blocks(source: str, lines: list[str]) -> list[tuple[int, int]]:
    """Bounds of top-level statements, found without parsing: decorators and branches stay with what
    they belong to, and what stands inside strings begins nothing."""
    bare = _QUOTED.sub(lambda m: " " * len(m[0]) if m[0][0] == "#" else "\x01" + re.sub(r"[^\r\n]", "\x00", m[0][1:]), source)
    starts, after_decorator = [], False
    for n, line in enumerate(_LINE.findall(bare)):
        if line[:1] == "\x00" or not line.strip() or _GOES_ON.match(line):
            continue
        if not after_decorator:
            starts.append(n)
        after_decorator = line.startswith("@")
    return list(zip(starts, [*starts[1:], len(lines)], strict=True))


def _tree(source: str, lines: list[str]) -> tuple[ast.Module | None, str | None]:
    """The tree, whole or of the blocks that parse, and what was wrong."""
    try:
        return ast.parse(source), None
    except (SyntaxError, ValueError, RecursionError) as error:
        wrong = str(error)
    body: list[ast.stmt] = []
    for start, end in _blocks(source, lines):
        try:
            part = ast.parse("".join(lines[start:end]))
        except (SyntaxError, ValueError, RecursionError):
            continue
        body += ast.increment_lineno(part, start).body
    return (ast.Module(body=body, type_ignores=[]) if body else None), wrong


def _reference(kind: str, name: str, node: ast.AST, lines: list[str]) -> dict:
    return {
        "kind": kind, "name": name, "start_line": node.lineno, "end_line": node.end_lineno or node.lineno,
        "text": _segment(node, lines) or name,
    }


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return None


def _calls(body: list[ast.stmt], lines: list[str]) -> list[dict]:
    """Calls by terminal name; nested functions keep their own."""
    out, stack = [], list(reversed(body))
    while stack:
        node = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        if isinstance(node, ast.Call) and (name := _dotted(node.func)):
            out.append(_reference("calls", name.rpartition(".")[2], node, lines))
        stack.extend(reversed(list(ast.iter_child_nodes(node))))
    return out


def _symbol(kind: str, name: str, parent: str | None, node, lines: list[str], test: bool) -> dict:
    start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    end = node.end_lineno or node.lineno
    text = "".join(lines[start - 1 : end])
    refs = []
    for d in node.decorator_list:
        target = d.func if isinstance(d, ast.Call) else d
        if dotted := _dotted(target):
            refs.append(_reference("decorates", dotted, d, lines))
    refs.sort(key=lambda r: (r["start_line"], r["name"]))
    if isinstance(node, ast.ClassDef):
        refs += [_reference("inherits", n, b, lines) for b in node.bases if (n := _dotted(b))]
    refs += _calls(node.body, lines)
    short = name.rpartition(".")[2]
    return {
        "kind": kind, "name": name, "parent": parent, "signature": lines[node.lineno - 1].strip().rstrip("{").rstrip(),
        "docstring": None, "start_line": start, "end_line": end, "source": text,
        "source_hash": hashlib.sha256(text.encode()).hexdigest(),
        "is_test": test and kind in ("function", "method") and short.startswith("test"), "refs": refs,
    }


def _walk(body: list[ast.stmt], lines: list[str], test: bool, out: list[dict], owner: str | None = None) -> None:
    """Definitions at a level, also under if, try and with their branches; loops are not looked into."""
    for node in body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind, name = ("method", f"{owner}.{node.name}") if owner else ("function", node.name)
            out.append(_symbol(kind, name, owner, node, lines, test))
        elif isinstance(node, ast.ClassDef) and owner is None:
            out.append(_symbol("class", node.name, None, node, lines, test))
            _walk(node.body, lines, test, out, node.name)
        elif isinstance(node, ast.If):
            _walk(node.body + node.orelse, lines, test, out, owner)
        elif isinstance(node, ast.Try):
            handlers = [s for h in node.handlers for s in h.body]
            _walk(node.body + handlers + node.orelse + node.finalbody, lines, test, out, owner)


def _imports(tree: ast.Module, lines: list[str]) -> list[dict]:
    out = []
    for node in tree.body:
        place = {"start_line": node.lineno, "end_line": node.end_lineno or node.lineno} if hasattr(node, "lineno") else {}
        text = lambda n=node: _segment(n, lines)
        if isinstance(node, ast.Import):
            for a in node.names:
                bound = {"local": a.asname or a.name, "imported": a.name, "kind": "module"}
                out.append({"name": a.name, "source": text(), "bindings": [bound], **place})
        elif isinstance(node, ast.ImportFrom):
            name = "." * node.level + (node.module or "")
            bound = [
                {"local": a.asname or a.name, "imported": a.name, "kind": "namespace" if a.name == "*" else "named"}
                for a in node.names
            ]
            out.append({"name": name, "source": text(), "bindings": bound, **place})
    return out


def _literals(tree: ast.Module) -> list[dict]:
    """Dispatch through literals: getattr(x, "n")(), d["k"]() and dictionaries of names."""
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Call) and getattr(f.func, "id", "") == "getattr" and len(f.args) > 1:
                if isinstance(f.args[1], ast.Constant) and isinstance(f.args[1].value, str):
                    out.append({"name": f.args[1].value, "relation": "dispatches", "line": node.lineno})
            elif isinstance(f, ast.Subscript) and isinstance(f.slice, ast.Constant) and isinstance(f.slice.value, str):
                out.append({"name": f.slice.value, "relation": "dispatches", "line": node.lineno})
        elif isinstance(node, ast.Dict):
            for k, v in zip(node.keys, node.values, strict=True):
                if isinstance(k, ast.Constant) and isinstance(k.value, str) and (name := _dotted(v)):
                    out.append({"name": name.rpartition(".")[2], "relation": "registers", "line": node.lineno})
    return sorted(out, key=lambda x: (x["line"], x["name"]))


def parse(source: str, is_test_file: bool) -> dict:
    lines = _LINE.findall(source)
    tree, wrong = _tree(source, lines)
    if tree is None:
        return {"status": "error", "error": wrong, "symbols": [], "imports": [], "literals": []}
    symbols: list[dict] = []
    _walk(tree.body, lines, is_test_file, symbols)
    return {"status": "ok", "error": wrong, "symbols": symbols, "imports": _imports(tree, lines), "literals": _literals(tree)}
