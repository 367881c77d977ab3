"""What has changed in a repository since a snapshot, reading as few contents as can be.

A small index is compared by hashing all its files. Otherwise git names the suspects where there is
git: what is not as committed now, what was not when the snapshot was built, and what differs between
the two commits. Without git, files of another size or time than recorded are the suspects. Suspects
alone are read and hashed, by the executors."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import detect_changes
from . import repository

#: Files and bytes up to which all files are hashed.
TINY_FILES, TINY_BYTES = 256, 16 * 1024 * 1024


def hashes(names: DataFrame, root: str) -> DataFrame:
    """(path, sha256) of files below root; those that are gone or no UTF-8 are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sums = [], []
            for path in batch.column(0).to_pylist():
                try:
                    content = Path(root, path).read_bytes()
                    content.decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    continue
                paths.append(path)
                sums.append(hashlib.sha256(content).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sums, pa.string())], names=["path", "sha256"])

    return names.select("path").mapInArrow(read, "path string, sha256 string")


def uncommitted(root: str) -> list[str] | None:
    """Paths that are not as committed, untracked ones too; None without git or where it names folders,
    such as a submodule with changes of its own."""
    printed = repository.git(root, "status", "--porcelain=v1", "-z", "--untracked-files=all", "--no-renames", "--", ".")
    prefix = repository.git(root, "rev-parse", "--show-prefix")
    if printed is None or prefix is None:
        return None
    start = prefix.decode("utf-8", "replace").rstrip("\n")
    paths = [x[3:].decode("utf-8", "replace").removeprefix(start) for x in printed.split(b"\0") if x]
    return None if any(os.path.isdir(os.path.join(root, p)) for p in paths) else sorted(set(paths))


def control_digest(root: str) -> str:
    """A digest of the files that decide what belongs to the repository."""
    parts = [repr(r) for r in repository.ignore_rules(root)]
    file = Path(root, repository.INCLUDE_FILE)
    parts.append(file.read_text("utf-8", "replace") if file.is_file() else "")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def git_suspects(root: str, manifest: dict) -> list[str] | None:
    """Paths that git has reason to think changed; None where it cannot tell all of them."""
    at_build, commit = manifest.get("built_dirty"), manifest.get("built_commit")
    if at_build is None or not commit or manifest.get("control") != control_digest(root):
        return None
    # Git's status names submodules as a whole, and says nothing of what it ignores but is included.
    top = repository.git(root, "rev-parse", "--show-toplevel")
    modules = Path(top.decode("utf-8", "replace").rstrip("\n"), ".gitmodules") if top else None
    if modules is None or modules.exists() or ".gitmodules" in at_build or Path(root, repository.INCLUDE_FILE).exists():
        return None
    now = uncommitted(root)
    if now is None or ".gitmodules" in now:
        return None
    between: list[str] = []
    if repository.git_head(root)[1] != commit:
        printed = repository.git(root, "diff", "--name-only", "--no-renames", "--relative", "-z", commit, "HEAD", "--", ".")
        if printed is None:
            return None
        between = [p for p in printed.decode("utf-8", "replace").split("\0") if p]
        if any(p == ".gitmodules" or os.path.isdir(os.path.join(root, p)) for p in between):
            return None
    return sorted({*at_build, *now, *between})


def stat_suspects(stored: DataFrame, stats: DataFrame) -> DataFrame:
    """(path) of files that are new, gone, or of another size or time than recorded."""
    old = stored.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    return old.join(stats, "path", "full_outer").where("NOT (_s <=> size AND _m <=> mtime)").select("path")


def changes(spark: SparkSession, root: str, stored: DataFrame, manifest: dict) -> DataFrame:
    """(path, change) of files that are new, changed or deleted. stored: a snapshot's files."""
    root = os.path.realpath(root)
    scope = tuple(manifest.get("exclude") or ()), tuple(manifest.get("include_roots") or ())
    size = stored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    names = repository.source_names(spark, root, *scope)
    if size["n"] > TINY_FILES or size["bytes"] > TINY_BYTES:
        paths = git_suspects(root, manifest)
        if paths is not None:
            suspects = spark.createDataFrame([(p,) for p in paths], "path string")
        else:
            suspects = stat_suspects(stored, repository.source_stats(spark, root, *scope))
        stored, names = stored.join(suspects, "path", "left_semi"), names.join(suspects, "path", "left_semi")
    return detect_changes(stored, hashes(names, root)).where("change <> 'unchanged'")


def tree_stamp(root: str) -> dict[str, tuple] | None:
    """Times of all folders, sizes and times of all files that a walk of root meets; equal stamps mean
    that nothing was added, removed or written. None where something vanishes meanwhile."""
    root = os.path.realpath(root)
    try:
        out: dict[str, tuple] = {"": (os.stat(root).st_mtime_ns, control_digest(root))}
        for path in repository.walked_paths(root):
            found = os.lstat(os.path.join(root, path))
            folder = os.path.dirname(path)
            out[path] = (found.st_size, found.st_mtime_ns)
            out.setdefault(folder + "/", (os.stat(os.path.join(root, folder)).st_mtime_ns,))
        return out
    except OSError:
        return None
