"""Keeps answers from being stale: detects changes, takes a lease, refreshes within a time limit."""

from __future__ import annotations

import concurrent.futures
import json
import os
import threading
import time
import uuid
from dataclasses import dataclass, field

from .engine import Engine

#: Seconds a lease and an automatic refresh may last, files an automatic build may have.
LEASE_SECONDS, REFRESH_SECONDS, AUTO_INDEX_FILES = 30.0, 5.0, 500


@dataclass
class Freshness:
    state: str
    revision: int | None = None
    warnings: list[str] = field(default_factory=list)


class StoredLease:
    """A lease as a file beside the snapshots, named by its term: a term's file is created without
    overwriting, which is atomic, so each term has one owner. A term is over once it has expired or
    was released; the next owner begins the next term and never deletes another's file."""

    def __init__(self, store, seconds: float = LEASE_SECONDS):
        self.store, self.seconds = store, seconds
        self.folder = f"{store.root}/LEASE"

    def _term_path(self, term: int) -> str:
        return f"{self.folder}/{term:012d}"

    def _latest(self) -> int:
        if not self.store._fs.exists(self.store._path(self.folder)):
            return 0
        names = [f.getPath().getName() for f in self.store._fs.listStatus(self.store._path(self.folder))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _held(self, term: int) -> dict | None:
        path = self.store._path(self._term_path(term))
        if not term or not self.store._fs.exists(path):
            return None
        rows = self.store.spark.read.text(path.toString()).collect()
        try:
            return json.loads("".join(r["value"] for r in rows))
        except ValueError:  # being written: somebody has just begun this term
            return {"owner": None, "expires_at": time.time() + self.seconds}

    def _text(self, owner: str, seconds: float) -> str:
        return json.dumps({"owner": owner, "expires_at": time.time() + seconds})

    def acquire(self, owner: str) -> bool:
        term = self._latest()
        held = self._held(term)
        if held and held["expires_at"] > time.time():
            return held["owner"] == owner
        try:
            out = self.store._fs.create(self.store._path(self._term_path(term + 1)), False)
        except Exception:  # another process began the term first
            return False
        out.write(bytearray(self._text(owner, self.seconds), "utf-8"))
        out.close()
        for old in range(max(1, term - 8), term):
            self.store._fs.delete(self.store._path(self._term_path(old)), False)
        return True

    def renew(self, owner: str) -> bool:
        """Only while it is held: what has expired may be another's by now."""
        term = self._latest()
        held = self._held(term)
        if not held or held["owner"] != owner or held["expires_at"] <= time.time():
            return False
        self.store.replace_file(self._term_path(term), self._text(owner, self.seconds))
        return self._latest() == term

    def release(self, owner: str) -> None:
        term = self._latest()
        held = self._held(term)
        if held and held["owner"] == owner:
            self.store.replace_file(self._term_path(term), self._text(owner, -1.0))


class Coordinator:
    """Serves only what is current: it refreshes under a lease, or says that it could not."""

    def __init__(self, engine: Engine, refresh_seconds: float = REFRESH_SECONDS, lease_seconds: float = LEASE_SECONDS):
        self.engine, self.refresh_seconds = engine, refresh_seconds
        self.lease = StoredLease(engine.store, lease_seconds)
        self.pool = concurrent.futures.ThreadPoolExecutor(2)

    def ensure_current(self, repo: str) -> Freshness:
        manifest = self.engine.store.manifest()
        if manifest is None:
            from ..sources.repository import source_names

            n = source_names(self.engine.spark, repo).count()
            if n > AUTO_INDEX_FILES:
                return Freshness("index_required", warnings=[f"{n} files; index explicitly"])
            return self._guarded(lambda: self.engine.index(repo, still_owner=self._owner_check()), None, repo)
        if manifest.get("root_dir") != os.path.realpath(repo):
            return Freshness("index_required", manifest["index_revision"], ["the index is of another repository"])
        if self.engine.is_current(repo):
            return Freshness("current", manifest["index_revision"])
        return self._guarded(lambda: self.engine.refresh(repo, still_owner=self._owner_check()), manifest["index_revision"], repo)

    def _owner_check(self):
        return lambda: self.lease.renew(self._owner)

    def _guarded(self, work, revision: int | None, repo: str) -> Freshness:
        self._owner = uuid.uuid4().hex
        if not self.lease.acquire(self._owner):
            return self._wait(revision)
        done = threading.Event()

        def beat() -> None:
            while not done.wait(self.lease.seconds / 3):
                if not self.lease.renew(self._owner):
                    return

        def run() -> dict:
            threading.Thread(target=beat, daemon=True).start()
            try:
                return work()
            finally:
                done.set()
                self.lease.release(self._owner)

        future = self.pool.submit(run)
        try:
            found = future.result(timeout=self.refresh_seconds)
        except concurrent.futures.TimeoutError:
            return Freshness("refreshing", revision, [f"refresh took over {self.refresh_seconds:g} s; nothing stale was served"])
        except Exception as error:
            return Freshness("refresh_failed", revision, [str(error)])
        return Freshness("refreshed", found["revision"])

    def _wait(self, revision: int | None) -> Freshness:
        """Waits for another refresher until the revision moves on or the time is up."""
        until = time.time() + self.refresh_seconds
        while time.time() < until:
            now = (self.engine.store.manifest() or {}).get("index_revision")
            if now is not None and now != revision:
                return Freshness("refreshed", now)
            time.sleep(0.05)
        return Freshness("refreshing", revision, ["another refresh is running"])
