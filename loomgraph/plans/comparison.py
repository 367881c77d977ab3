"""A plain search-and-read loop over a repository, to compare contexts with: it looks for the words of
a request, ranks the lines that have them, and reads windows around the best until the budget is used."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import lexical, resolution, retrieval

#: Words that are not searched for, windows that are tried, limits of the loop.
PLAIN_WORDS = frozenset(
    "a an and around architecture complete describe explain find function implementation inspect the this trace update with".split()
)
WINDOWS, MOST_MATCHES, MOST_READS = (80, 40, 20), 40, 12


def request_terms(request: str, target: str | None = None) -> list[str]:
    """The words to search for, the target's first, each once."""
    words = re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", request)
    aimed = list(reversed(re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", target or "")))
    return list(dict.fromkeys(aimed + [w for w in words if w.lower() not in PLAIN_WORDS])) or [request.strip()]


def retrieve(files: DataFrame, request: str, read: Callable[[str, int, int], str | None], target: str | None = None, token_budget: int = 800) -> dict:
    """files: (path, text); read gives lines of a path. All terms are searched in one scan; matches and
    reads are limits of the loop. Files that the first match imports are read after the matches."""
    terms = request_terms(request, target)
    matches = [(r["path"], r["line"]) for r in lexical.ranked_matches(files, terms, MOST_MATCHES).collect()]
    best: dict[str, int] = {}
    for path, line in matches:
        best.setdefault(path, line)
    places = list(best.items())
    if places:
        asked = files.sparkSession.createDataFrame([(places[0][0], 0)], "path string, position int")
        near = resolution.one_hop_imports(files, asked).orderBy("position", "line").limit(MOST_READS).collect()
        places += [(r["path"], 1) for r in near if r["path"] not in {p for p, _ in places}]
    answer: dict = {"slices": []}
    for path, line in places[:MOST_READS]:
        for window in WINDOWS:
            start = max(1, line - window // 2)
            code = read(path, start, line + window // 2)
            if code is None:
                break
            role = "target" if not answer["slices"] else "context"
            part = {"path": path, "lines": [start, start + code.rstrip("\n").count("\n")], "role": role, "code": code}
            answer["slices"].append(part)
            if retrieval.fits(answer, token_budget):
                break
            answer["slices"].pop()
    return answer | {"terms": terms, "matches": len(matches), "tokens": retrieval.tokens_needed(answer)}
