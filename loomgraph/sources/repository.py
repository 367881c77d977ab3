"""Source trees: what belongs to a repository, read as (path, content) rows."""

from __future__ import annotations

import os
import re
import subprocess
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import IgnoreRule, effective_rules, enters, ignored_path, is_ignored, parse_rule
from ..operators.parsing import language_of

#: Directories that a walk never enters.
EXCLUDED_DIRS = frozenset(
    (".git", ".svn", ".hg", "__pycache__", "node_modules", ".venv", "venv", "build", "dist", ".mypy_cache", ".pytest_cache")
)
IGNORE_FILE, VCS_IGNORE_FILE = ".loomignore", ".gitignore"


def git(root: str, *args: str) -> bytes | None:
    """What git prints; None where it fails or there is none."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=60, stdin=subprocess.DEVNULL)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return None if done.returncode else done.stdout


def _names(printed: bytes | None) -> list[str] | None:
    return None if printed is None else sorted(p for p in printed.decode("utf-8", "replace").split("\0") if p)


def vcs_paths(root: str) -> list[str] | None:
    """Tracked paths by git, submodules' too, relative to root and sorted; None where there is no git tree."""
    found = _names(git(root, "ls-files", "-z", "--recurse-submodules", "--", "."))
    return _names(git(root, "ls-files", "-z", "--", ".")) if found is None else found


def untracked_paths(root: str, among: list[str] | None = None) -> list[str] | None:
    """Paths that git neither tracks nor ignores, all or among those given; None without git."""
    if among is not None and not among:
        return []
    return _names(git(root, "ls-files", "-z", "--others", "--exclude-standard", "--", *(among or ["."])))


def _git_folder(root: str) -> Path | None:
    """The folder with HEAD: that of the nearest tree upwards, or where a worktree's file points."""
    for at in (Path(root).resolve(), *Path(root).resolve().parents):
        mark = at / ".git"
        if mark.is_dir():
            return mark
        if mark.is_file():
            named = re.match(r"gitdir:\s*(.+)", mark.read_text("utf-8", "replace"))
            return (at / named[1].strip()).resolve() if named else None
    return None


def _head_from_files(root: str) -> tuple[str, str] | None:
    """Branch and commit as the repository's own files state them, loose or packed."""
    try:
        if (folder := _git_folder(root)) is None:
            return None
        head = (folder / "HEAD").read_text("utf-8").strip()
        if not head.startswith("ref:"):
            return ("HEAD", head) if re.fullmatch("[0-9a-f]{40,64}", head) else None
        ref = head[4:].strip()
        shared = folder / "commondir"
        bases = [folder, (folder / shared.read_text("utf-8").strip()).resolve()] if shared.is_file() else [folder]
        found = [(b / ref).read_text("utf-8").strip() for b in bases if (b / ref).is_file()]
        for packed in (b / "packed-refs" for b in bases):
            lines = packed.read_text("utf-8").splitlines() if packed.is_file() else []
            found += [line.partition(" ")[0] for line in lines if line.partition(" ")[2] == ref]
        return (ref.removeprefix("refs/heads/"), found[0]) if found else None
    except (OSError, UnicodeDecodeError):
        return None


def git_head(root: str) -> tuple[str | None, str | None]:
    """Branch and the commit's first 12 digits: from the repository's files, else from git."""
    if (found := _head_from_files(root)) is not None:
        return found[0], found[1][:12]
    commit, branch = git(root, "rev-parse", "HEAD"), git(root, "rev-parse", "--abbrev-ref", "HEAD")
    return branch and (branch.decode().strip() or None), commit and (commit.decode().strip()[:12] or None)


def walked_paths(root: str, rules: list[IgnoreRule] | None = None) -> list[str]:
    """Paths by a walk that leaves out excluded, hidden and ignored directories, sorted."""
    out = []
    for at, dirs, names in os.walk(root):
        below = lambda n, at=at: PurePosixPath(at, n).relative_to(PurePosixPath(root)).as_posix()
        dirs[:] = sorted(d for d in dirs if d not in EXCLUDED_DIRS and not d.startswith(".") and enters(below(d), rules or []))
        out += [below(n) for n in names]
    return sorted(out)


def ignore_rules(root: str, extra: tuple[str, ...] = ()) -> list[IgnoreRule]:
    """Rules of the ignore files from the top of version control down to root, then the extra ones."""
    here = Path(root).resolve()
    top = next((p for p in (here, *here.parents) if (p / ".git").exists() or (p / ".svn").is_dir()), here)
    folders = [p for p in (*reversed(here.parents), here) if p.is_relative_to(top)]
    lines = []
    for folder in folders:
        under = here.relative_to(folder).as_posix().removeprefix(".")
        for name, source in ((VCS_IGNORE_FILE, "vcsignore"), (IGNORE_FILE, "ignorefile")):
            file = folder / name
            lines += [(source, under, x) for x in (file.read_text("utf-8", "replace").splitlines() if file.is_file() else ())]
    lines += [("runtime", "", x) for x in extra]
    return [r for source, under, line in lines if (r := parse_rule(line, source, under))]


def include_roots(roots: tuple[str, ...]) -> tuple[str, ...]:
    """Normalised and distinct; roots outside the repository are refused."""
    out = []
    for root in roots:
        parts = PurePosixPath(root.replace("\\", "/")).parts
        if not root.strip() or ".." in parts or root.startswith("/"):
            raise ValueError(f"include root outside the repository: {root!r}")
        out.append(PurePosixPath(*[p for p in parts if p != "."]).as_posix())
    return tuple(dict.fromkeys(r for r in out if r != "."))


def _held_paths(root: str) -> list[str] | None:
    """What version control tracks; None without it."""
    listed = vcs_paths(root)
    return svn_paths(root) if listed is None else listed


def _wanted(root: str, path: str, roots: tuple[str, ...]) -> bool:
    """A source file of a known language below the wanted roots, and no link."""
    if language_of(path) is None or "node_modules" in path.split("/"):
        return False
    if roots and not any(path == r or path.startswith(r + "/") for r in roots):
        return False
    file = os.path.join(root, path)
    return os.path.isfile(file) and not os.path.islink(file)


def is_discoverable(root: str, path: str, exclude: tuple[str, ...] = ()) -> bool:
    """Whether discovery would find one path."""
    root = os.path.realpath(root)
    held = _held_paths(root)
    rules = ignore_rules(root, exclude)
    if held is None and not all(enters(p.as_posix(), rules) for p in list(PurePosixPath(path).parents)[:-1]):
        return False
    folders = PurePosixPath(path).parts[:-1]
    there = path in held if held is not None else not any(d in EXCLUDED_DIRS or d.startswith(".") for d in folders)
    return there and _wanted(root, path, ()) and not ignored_path(path, effective_rules(rules, held is not None))


def source_names(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), roots: tuple[str, ...] = ()) -> DataFrame:
    """(path) of a repository's source files. Listing is driver work on names alone."""
    root = os.path.realpath(root)
    rules, roots, held = ignore_rules(root, exclude), include_roots(roots), _held_paths(root)
    firm = effective_rules(rules, True)

    def frame(paths: list[str], rules: list[IgnoreRule]) -> DataFrame:
        names = spark.createDataFrame([(p,) for p in paths if _wanted(root, p, roots)], "path string")
        return names.where(~is_ignored(F.col("path"), rules)) if rules else names

    named = [path for path, _, decision in _include_decisions(root) if decision == "included"]
    listed = frame(walked_paths(root, rules), rules) if held is None else frame(held, firm)
    return listed.unionByName(frame(sorted(set(named)), firm)).distinct() if named else listed


def _found(spark: SparkSession, root: str) -> DataFrame:
    """All files under root by Spark's own listing; contents are read only where they are asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    start = F.length(F.lit(root)) + 2
    relative = F.substr(F.regexp_replace(F.col("path"), "^file:/*", "/"), start)
    return found.select(
        F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("path"), "content", F.col("length").alias("size"),
        F.col("modificationTime").cast("double").alias("mtime"),
    )


def source_stats(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), roots: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, mtime) of a repository's source files; no content is read."""
    names = source_names(spark, root, exclude, roots)
    return _found(spark, os.path.realpath(root)).select("path", "size", "mtime").join(names, "path", "left_semi")


def source_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), roots: tuple[str, ...] = ()) -> DataFrame:
    """(path, content, size, mtime) of a repository's source files.

    Contents are read by the executors, so on a cluster root has to be a folder that they share."""
    names = source_names(spark, root, exclude, roots)
    return _found(spark, os.path.realpath(root)).join(names, "path", "left_semi")


def source_lines(content: str | None, start: int, end: int) -> str | None:
    """Lines start..end (from 1, both included) with their line ends; None without content."""
    if content is None:
        return None
    return "".join(re.split(r"(?<=\n)", content)[max(0, start - 1) : end])


def read_lines(root: str, path: str, start: int, end: int) -> str | None:
    """Lines of a file of the repository; None where there is no such file inside it, or no UTF-8."""
    base, file = Path(root).resolve(), Path(root, path)
    try:
        if not file.resolve().is_relative_to(base) or not file.is_file():
            return None
        return source_lines(file.read_bytes().decode("utf-8"), start, end)
    except (OSError, UnicodeDecodeError):
        return None


#: What an explicit include may never bring in, and how large a file may be.
INCLUDE_FILE = ".loominclude"
SENSITIVE_NAMES = frozenset(
    (".env", ".npmrc", ".pypirc", "credentials", "credentials.json", "id_dsa", "id_ed25519", "id_rsa", "secrets", "secrets.json")
)
SENSITIVE_SUFFIXES = (".key", ".pem", ".p12", ".pfx", ".jks", ".keystore")
SENSITIVE_FOLDERS = frozenset(("secret", "secrets", "credential", "credentials", "private-keys"))
MOST_INCLUDED_BYTES = 2 * 1024 * 1024


def include_decision(root: str, path: Path) -> str:
    """included, or why an explicitly named path is not: outside_repo, symlink, not_file, too_large,
    sensitive_path."""
    base, real = Path(root).resolve(), path.resolve()
    if not real.is_relative_to(base):
        return "outside_repo"
    if path.is_symlink():
        return "symlink"
    if not real.is_file():
        return "not_file"
    if real.stat().st_size > MOST_INCLUDED_BYTES:
        return "too_large"
    low = PurePosixPath(real.relative_to(base).as_posix().lower())
    secret = low.name in SENSITIVE_NAMES or low.name.startswith(".env.") or low.name.endswith(SENSITIVE_SUFFIXES)
    return "sensitive_path" if secret or SENSITIVE_FOLDERS & set(low.parts) else "included"


def _include_decisions(root: str) -> list[tuple[str | None, str, str]]:
    file, rows = Path(root, INCLUDE_FILE), []
    lines = file.read_text("utf-8", "replace").splitlines() if file.is_file() else []
    for pattern in (x.strip().lstrip("/") for x in lines if x.strip() and x.strip()[0] not in "#!"):
        found = [p for hit in Path(root).glob(pattern) for p in (hit.rglob("*") if hit.is_dir() else (hit,))]
        rows += [(os.path.relpath(p, root), pattern, include_decision(root, p)) for p in found] or [(None, pattern, "unmatched")]
    return sorted(set(rows), key=str)


def explicit_includes(spark: SparkSession, root: str) -> DataFrame:
    """(path, pattern, decision) for what the include file's patterns name; unmatched ones have no
    path. Names and sizes are looked at, never contents."""
    return spark.createDataFrame(_include_decisions(root), "path string, pattern string, decision string")


def svn_paths(root: str) -> list[str] | None:
    """Versioned paths of a Subversion working copy that exist as files; None where there is none."""
    if not any(os.path.isdir(os.path.join(p, ".svn")) for p in (root, *map(str, Path(root).resolve().parents))):
        return None
    try:
        done = subprocess.run(["svn", "list", "--recursive", root], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    if done.returncode:
        return None
    return sorted(p for p in done.stdout.splitlines() if p and not p.endswith("/") and os.path.isfile(os.path.join(root, p)))
