"""Answers of the engine as text: one-line summaries, and Markdown for a context."""

from __future__ import annotations

import json


def _place(part: dict) -> str:
    lines = part.get("lines") or ([part["line"]] if part.get("line") else [])
    return f"{part.get('path', '')}:{'-'.join(str(n) for n in lines)}" if lines else str(part.get("path", ""))


def index_summary(answer: dict) -> str:
    return f"Indexed {answer['files']:,} files, {answer['symbols']:,} symbols (revision {answer['revision']})\n"


def refresh_summary(answer: dict) -> str:
    return f"Refreshed: {answer['changed']:,} changed, {answer['rebuilt']:,} rebuilt (revision {answer['revision']})\n"


def status_summary(answer: dict) -> str:
    languages = ", ".join(answer.get("languages") or []) or "none"
    head = f"{answer['files']:,} files, {answer['symbols']:,} symbols, {answer['edges']:,} edges (revision {answer['revision']})"
    wrong = f"Not parsed: {answer['errors']:,}\n" if answer.get("errors") else ""
    return f"{head}\nLanguages: {languages}\n{wrong}"


def context_markdown(answer: dict) -> str:
    """A context: warnings, candidates, slices with their code, what is missing and what to do next.
    Parts that are empty get no heading."""
    out = ["# Context", "", f"Status: `{answer.get('status', '')}`"]

    def section(title: str, lines: list[str]) -> None:
        if lines:
            out.extend(["", f"## {title}", "", *lines])

    section("Warnings", [f"- {w}" for w in answer.get("warnings") or []])
    section("Candidates", [f"- `{c['id']}` at `{_place(c)}`" for c in answer.get("candidates") or []])
    shown: list[str] = []
    for part in answer.get("slices") or []:
        code = (part.get("code") or "").rstrip()
        fence = "`" * max([3, *(len(run) + 1 for run in "".join(c if c == "`" else " " for c in code).split())])
        shown += [f"### `{_place(part)}` `{part.get('symbol', '')}` ({part.get('role') or 'context'})", ""]
        shown += [fence, code, fence, ""] if code else []
    section("Slices", shown[:-1] if shown and not shown[-1] else shown)
    section("Missing", [f"- `{json.dumps(m, sort_keys=True)}`" for m in answer.get("missing") or []])
    step = answer.get("next")
    section("Next", [f"- `{step['tool']}` with `{json.dumps(step.get('arguments', {}), sort_keys=True)}`"] if step else [])
    return "\n".join(out) + "\n"


RENDERERS = {"index": index_summary, "refresh": refresh_summary, "status": status_summary, "context": context_markdown}
