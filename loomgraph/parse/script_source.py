"""JavaScript and TypeScript sources by a scanner: comments and strings are masked, braces matched.

Found are classes, interfaces, enums and type aliases (all of kind class), functions, methods, arrow
functions bound to constants, calls, `new`, heritage clauses, imports and requires at top level."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

#: Comments, strings, templates, and regular expressions where a value may begin.
_MASK = re.compile(
    r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`"
    r"|(?:(?<=[(,=:\[!&|?{};])|(?<=\breturn))[ \t]*/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*",
    re.S,
)
_CLASS = re.compile(r"\b(?:class|interface|enum)\s+([A-Za-z_$][\w$]*)([^{;]*)\{")
_ALIAS = re.compile(r"\btype\s+([A-Za-z_$][\w$]*)[^=;\n]*=")
_FUNCTION = re.compile(r"\b(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)[^{;]*?\{")
_ARROW = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)[^=;\n]*=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)[^=;{\n]*=>\s*")
_METHOD = re.compile(r"(?:^|[;{}\n])[ \t]*(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*\*?([A-Za-z_$#][\w$]*)\s*(?:<[^>]*>)?\([^(){}]*(?:\([^()]*\)[^(){}]*)*\)[^;{}=]*\{")
_CALL = re.compile(r"(?:\bnew\s+)?([A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$#][\w$]*)*)\s*(?:<[\w\s,.$\[\]]*>)?\(")
_IMPORT = re.compile(r"^[ \t]*import\b([^'\"`;]*?)(?:\bfrom\s*)?(['\"])([^'\"\n]+)\2", re.M)
_REQUIRE = re.compile(r"^[ \t]*(?:const|let|var)\s+([^=;]+?)\s*=\s*require\(\s*(['\"])([^'\"\n]+)\2\s*\)", re.M)
_OBJECT = re.compile(r"(?:['\"]([^'\"\n]+)['\"]|([A-Za-z_$][\w$]*))\s*:\s*([A-Za-z_$][\w$.]*)\s*(?=[,}])")
#: Words that stand before a parenthesis without being called.
_NO_CALL = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "super", "constructor", "await"}


def _masked(source: str) -> tuple[str, dict[int, str]]:
    """The source with comments, strings and regular expressions blanked; documentation by its end."""
    docs: dict[int, str] = {}

    def blank(m: re.Match) -> str:
        if m[0].startswith("/**") and len(m[0]) > 4:
            docs[m.end()] = m[0][3:-2]
        return re.sub(r"[^\n]", " ", m[0])

    return _MASK.sub(blank, source), docs


def _closings(text: str) -> dict[int, int]:
    """For each brace and parenthesis the place after the one that closes it."""
    out: dict[int, int] = {}
    stacks: dict[str, list[int]] = {"}": [], ")": []}
    for m in re.finditer(r"[{}()]", text):
        if m[0] in stacks:
            if stacks[m[0]]:
                out[stacks[m[0]].pop()] = m.end()
        else:
            stacks["}" if m[0] == "{" else ")"].append(m.start())
    return out


def _bindings(clause: str) -> list[dict]:
    clause = re.sub(r"^\s*type\b", "", clause).strip()
    out = []
    if named := re.search(r"\{([^}]*)\}", clause):
        for part in filter(None, (p.strip() for p in named[1].split(","))):
            names = re.split(r"\s+as\s+|\s*:\s*", re.sub(r"^type\s+", "", part))
            out.append({"local": names[-1], "imported": names[0], "kind": "named"})
        clause = clause.replace(named[0], "")
    if space := re.search(r"\*\s*as\s+([\w$]+)", clause):
        out.append({"local": space[1], "imported": "*", "kind": "namespace"})
        clause = clause.replace(space[0], "")
    if default := clause.strip(" ,\n"):
        out.append({"local": default, "imported": "default", "kind": "default"})
    return out


def parse(source: str, is_test_file: bool) -> dict:
    code, docs = _masked(source)
    closings = _closings(code)
    closing = lambda at: closings.get(at, len(code))
    lines = re.findall(r"[^\n]*\n|[^\n]+", source)
    breaks = [m.start() for m in re.finditer("\n", source)]
    line_of = lambda at: bisect_left(breaks, at) + 1
    line_end = lambda at: breaks[k] if (k := bisect_left(breaks, at)) < len(breaks) else len(source)
    found: list[dict] = []
    covered = bytearray(len(code) + 1)

    def inside(at: int) -> bool:
        return bool(covered[at])

    def cover(start: int, end: int) -> None:
        covered[start + 1 : end] = b"\1" * max(0, end - start - 1)

    def calls(start: int, end: int) -> list[dict]:
        out = []
        for m in _CALL.finditer(code, start, end):
            name = m[1].replace("?.", ".").rpartition(".")[2]
            if name not in _NO_CALL and m[1] not in _NO_CALL:
                close = min(closing(m.end() - 1), end)
                out.append({"kind": "calls", "name": name, "start_line": line_of(m.start(1)), "end_line": line_of(close - 1), "text": source[m.start() : close]})
        return out

    def doc(start: int) -> str | None:
        """Of the documentation comment that stands before a definition and its leading words."""
        at = start
        while at:
            word = next((w for w in ("export", "default", "async") if source.endswith(w, 0, at)), "")
            if source[at - 1].isspace():
                at -= 1
            elif word:
                at -= len(word)
            else:
                break
        return " ".join(filter(None, (x.strip().lstrip("*").strip() for x in docs.get(at, "").splitlines()))) or None

    def add(kind: str, name: str, parent: str | None, start: int, end: int, refs: list[dict]) -> None:
        a, b = line_of(start), line_of(max(start, end - 1))
        text = "".join(lines[a - 1 : b])
        short = name.rpartition(".")[2]
        found.append(
            {
                "kind": kind, "name": name, "parent": parent,
                "signature": source[start : line_end(start)].strip().rstrip("{").rstrip(), "docstring": doc(start),
                "start_line": a, "end_line": b, "source": text, "source_hash": hashlib.sha256(text.encode()).hexdigest(),
                "is_test": is_test_file and kind != "class" and short.startswith(("test", "it", "describe")), "refs": refs,
            }
        )

    for m in _CLASS.finditer(code):
        if inside(m.start()):
            continue
        end = closing(m.end() - 1)
        refs = []
        for clause in re.finditer(r"\b(?:extends|implements)\s+([^{]*?)(?=\bimplements\b|\bextends\b|$)", m[2]):
            for base in re.split(r",(?![^<]*>)", clause[1]):
                if base := re.sub(r"<.*", "", base).strip():
                    row = line_of(m.start())
                    refs.append({"kind": "inherits", "name": base, "start_line": row, "end_line": row, "text": base})
        add("class", m[1], None, m.start(), end, refs)
        cover(m.start(), end)
        if not code.startswith("class", m.start()):
            continue
        at = m.end() - 1
        while method := _METHOD.search(code, at, end):
            close = closing(method.end() - 1)
            if method[1] not in _NO_CALL - {"constructor"}:
                add("method", f"{m[1]}.{method[1]}", m[1], method.start(1), close, calls(method.end(), close))
            at = close - 1
    for m in _ALIAS.finditer(code):
        if not inside(m.start()):
            add("class", m[1], None, m.start(), line_end(m.end()), [])
    for pattern in (_FUNCTION, _ARROW):
        for m in pattern.finditer(code):
            if inside(m.start()):
                continue
            if code[m.end() - 1 : m.end()] == "{":
                close = closing(m.end() - 1)
            elif code[m.end() : m.end() + 1] == "{":
                close = closing(m.end())
            else:
                close = line_end(m.end())
            add("function", m[1], None, m.start(), close, calls(m.end(), close))
            cover(m.start(), close)
    imports = []
    for pattern in (_IMPORT, _REQUIRE):
        for m in pattern.finditer(source):
            if code[m.start() : m.end()].strip() and not inside(m.start()):
                row = line_of(m.start())
                row_end = line_of(m.end())
                imports.append({"name": m[3], "source": m[0].strip(), "start_line": row, "end_line": row_end, "bindings": _bindings(m[1])})
    literals = [
        {"name": m[3].rpartition(".")[2], "relation": "registers", "line": line_of(m.start())}
        for m in _OBJECT.finditer(source)
        if code[m.start(3)] != " "
    ]
    imports.sort(key=lambda i: (i["start_line"], i["name"]))
    found.sort(key=lambda s: (s["start_line"], s["name"]))
    return {"status": "ok", "error": None, "symbols": found, "imports": imports, "literals": literals}
