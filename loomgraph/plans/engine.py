"""The engine's entry points: index, refresh, status, minimal, graph, path and context."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, indexing, lexical, maintenance, parsing, resolution, retrieval
from ..operators.scratch import materialise
from ..operators.store import MOST_LAYERS, SnapshotStore, owner_path
from ..sources import change_scan, repository
from . import comparison

#: Budgets of a request.
LEAST_BUDGET, MOST_BUDGET = 256, 16_384
#: Files and symbols up to which one exact target is the only candidate.
TINY_REPO_FILES, TINY_REPO_SYMBOLS = 100, 1_000
#: The order of roles under each intent.
_ROLE_ORDER = {
    "debug": ("caller", "test", "dependency"), "edit": ("dependency", "test", "caller"), "review": ("dependency", "caller", "test"),
}


class Engine:
    """A code graph over a repository, kept as versioned snapshots under `root`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, SnapshotStore(spark, root)
        self._unchanged: dict[str, tuple[int, dict]] = {}

    def index(
        self, repo: str, exclude: tuple[str, ...] = (), include_roots: tuple[str, ...] = (), still_owner: Callable[[], bool] = lambda: True
    ) -> dict:
        """Builds all tables from the whole repository and publishes them. Files that the last
        snapshot has parsed with the same content are not parsed again."""
        began = time.time()
        scope = {"exclude": list(exclude), "include_roots": list(include_roots), "built_dirty": change_scan.uncommitted(os.path.realpath(repo))}
        # Times are noted before contents are read, so what is written in between shows as changed.
        stats = materialise(repository.source_stats(self.spark, repo, exclude, include_roots), "stats")
        files = repository.source_files(self.spark, repo, exclude, include_roots).select("path", "content")
        cache = self.store.read().get("parsed_files") if self.store.manifest() else None
        parsed = materialise(parsing.parse_files(files) if cache is None else parsing.parse_changed(files, cache), "parsed")
        return self._publish(indexing.build_tables(parsed) | {"parsed_files": parsed}, repo, began, still_owner, stats, scope)

    def _publish(
        self, tables: dict[str, DataFrame], repo: str, began: float, still_owner: Callable[[], bool], stats: DataFrame, scope: dict,
        touched: DataFrame | None = None,
    ) -> dict:
        root = os.path.realpath(repo)
        branch, commit = repository.git_head(root)
        dirty = change_scan.uncommitted(root)
        if scope["built_dirty"] is None or dirty is None:
            scope = scope | {"built_dirty": None}
        else:
            scope = scope | {"built_dirty": sorted({*scope["built_dirty"], *dirty})}
        columns = tables["files"].columns
        files = tables["files"].drop("mtime").join(stats.select("path", "mtime"), "path", "left")
        tables = tables | {"files": files.withColumn("mtime", F.coalesce("mtime", F.lit(0.0))).select(*columns)}
        found = self.store.publish(
            tables, still_owner, touched, root_dir=root, built_branch=branch, built_commit=commit, updated_at=began,
            control=change_scan.control_digest(root), **scope,
        )
        now = self.store.read()
        return {
            "files": now["files"].count(), "symbols": now["symbols"].count(), "revision": found["index_revision"],
            "seconds": time.time() - began,
        }

    def changes(self, repo: str) -> DataFrame:
        """(path, change) between the snapshot and the repository as it is."""
        manifest = self.store.manifest()
        return change_scan.changes(self.spark, repo, self.store.read()["files"], manifest)

    def is_current(self, repo: str) -> bool:
        """Whether nothing has changed. A tree without git that bears the same stamp as when it was last
        found unchanged is not looked at again."""
        root, manifest = os.path.realpath(repo), self.store.manifest()
        stamp = change_scan.tree_stamp(root) if manifest.get("built_commit") is None else None
        if stamp is not None and self._unchanged.get(root) == (manifest["index_revision"], stamp):
            return True
        same = self.changes(repo).isEmpty()
        if same and stamp is not None:
            self._unchanged[root] = (manifest["index_revision"], stamp)
        return same

    def refresh(self, repo: str, still_owner: Callable[[], bool] = lambda: True) -> dict:
        """Brings the snapshot up to date; without changes the revision stays.

        Changed files alone are parsed, and the rows of those files alone are built that changed or
        that may resolve otherwise now; they become a layer on the snapshot."""
        began = time.time()
        manifest = self.store.manifest()
        exclude, roots = tuple(manifest.get("exclude") or ()), tuple(manifest.get("include_roots") or ())
        scope = {"exclude": list(exclude), "include_roots": list(roots), "built_dirty": change_scan.uncommitted(os.path.realpath(repo))}
        stats = materialise(repository.source_stats(self.spark, repo, exclude, roots), "stats")
        changes = materialise(self.changes(repo), "changes")
        n = changes.count()
        if not n:
            return {"changed": 0, "rebuilt": 0, "revision": manifest["index_revision"]}
        files = repository.source_files(self.spark, repo, exclude, roots).select("path", "content")
        if len(manifest["layers"]) >= MOST_LAYERS:
            done = self.index(repo, exclude, roots, still_owner)
            return done | {"changed": n, "rebuilt": done["files"]}
        tables = self.store.read()
        fresh = materialise(parsing.parse_files(files.join(changes.where("change <> 'deleted'"), "path", "left_semi")), "parsed")
        touched = materialise(self._affected(tables, changes, fresh), "touched")
        untouched = lambda name, by: tables[name].join(by.select(F.col("path").alias("_p")), owner_path(name) == F.col("_p"), "left_anti")
        same = untouched("parsed_files", changes).join(touched, "path", "left_semi")
        parsed = materialise(fresh.unionByName(same.select(*fresh.columns)), "parsed")
        base = {name: untouched(name, touched) for name in ("files", "symbols", "module_lookup", "symbol_lookup")}
        layer = indexing.build_tables(parsed, base) | {"parsed_files": parsed}
        done = self._publish(layer, repo, began, still_owner, stats, scope, touched)
        return done | {"changed": n, "rebuilt": parsed.count()}

    def _affected(self, tables: dict[str, DataFrame], changes: DataFrame, fresh: DataFrame) -> DataFrame:
        """Paths whose rows have to be built anew: what changed, what depends on it by an edge, what
        mentions a name that it defined or defines, what imports a module that came or went."""
        gone = changes.select(F.col("path").alias("_p"))
        of_changed = lambda name: tables[name].join(gone, owner_path(name) == F.col("_p"), "left_semi")
        nodes = of_changed("symbols").select("id").unionByName(of_changed("files").select("id"))
        depending, _ = graph.dependents(tables["edges"], self._entities(tables), nodes, changes, limit=None)
        defined = fresh.select(F.explode("symbols").alias("s")).select(F.explode(F.array("s.name", T.short_name(F.col("s.name")))).alias("name"))
        names = of_changed("symbol_lookup").select(F.col("lookup_name").alias("name")).unionByName(defined).distinct()
        mentioning = tables["edge_occurrences"].join(names, "name", "left_semi").select(owner_path("edge_occurrences").alias("path"))
        bound = tables["import_bindings"].join(names, F.col("imported_name") == F.col("name"), "left_semi").select(owner_path("import_bindings").alias("path"))
        modules = of_changed("module_lookup").select("module_name").unionByName(indexing._modules(fresh).select("module_name"))
        modules = modules.select(F.explode(F.array("module_name", F.regexp_replace("module_name", r"\.index$", ""))).alias("wanted")).distinct()
        of_file = tables["files"].select(F.col("id").alias("file_id"), "language").join(tables["module_lookup"], "file_id")
        importing = tables["imports"].withColumnRenamed("import_name", "name").join(of_file, "file_id")
        importing = importing.withColumn("wanted", indexing.wanted_module(F.col("language"))).join(modules, "wanted", "left_semi")
        importing = importing.select(owner_path("imports").alias("path"))
        every = changes.select("path")
        for more in (depending, mentioning, bound, importing):
            every = every.unionByName(more.select("path"))
        return every.distinct()

    def _entities(self, tables: dict[str, DataFrame]) -> DataFrame:
        return indexing.entities(tables["files"], tables["symbols"])

    def status(self) -> dict:
        tables, manifest = self.store.read(), self.store.manifest()
        row = tables["files"].agg(
            F.count(F.lit(1)).alias("files"), F.count_if(F.col("parse_status") == "error").alias("errors"),
            F.array_sort(F.collect_set("language")).alias("languages"),
        ).first()
        return row.asDict() | {"symbols": tables["symbols"].count(), "edges": tables["edges"].count(), "revision": manifest["index_revision"]}

    def minimal(self, task: str = "") -> dict:
        """Totals, main languages and the best-connected entities that are no hubs."""
        tables = self.store.read()
        tokens = set(re.findall(r"\w+", task.lower()))
        wants_tests = bool(tokens & {"test", "tests", "pytest", "failing", "failure", "coverage", "debug", "bug", "review"})
        shown = self._entities(tables).where("kind <> 'file'")
        top = graph.top_entities(tables["edges"], shown, include_tests=wants_tests).collect()
        languages = tables["files"].groupBy("language").count().orderBy(F.desc("count"), "language").limit(3).collect()
        return {
            "files": tables["files"].count(), "symbols": tables["symbols"].count(), "edges": tables["edges"].count(),
            "languages": [r["language"] for r in languages], "key_entities": [r.asDict() for r in top],
            "next": list(retrieval.NEXT_STEPS[self.spark.range(1).select(retrieval.overview_intent(F.lit(task)).alias("i")).first()["i"]]),
        }

    def _resolve(self, tables: dict[str, DataFrame], wanted: str) -> str:
        row = graph.resolve_node(self._entities(tables), wanted).first()
        if row is None:
            raise KeyError(f"no such node: {wanted}")
        return row["id"]

    def graph(self, node: str, depth: int = 1, relations: list[str] | None = None, tiers: list[str] | None = None) -> graph.Neighbourhood:
        tables = self.store.read()
        return graph.neighbourhood(tables["edges"], self._resolve(tables, node), depth, relations, tiers)

    def path(self, source: str, target: str, relations: list[str] | None = None) -> list[tuple[str, str | None]] | None:
        tables = self.store.read()
        return graph.shortest_path(tables["edges"], self._resolve(tables, source), self._resolve(tables, target), relations)

    def _scope(self, tables: dict[str, DataFrame], task: str) -> DataFrame:
        """(file_id, scope): files that a task names (0) and files that those import (1)."""
        low = F.lit(task.lower())
        own = tables["files"].where(F.contains(low, F.lower("path"))).select("id").orderBy("id").limit(16)
        ids = [r["id"] for r in own.collect()]
        rows = [(i, 0) for i in ids]
        if ids:
            imported = tables["imports"].where(F.col("file_id").isin(ids) & F.col("resolved_file_id").isNotNull())
            more = imported.select("resolved_file_id").distinct().orderBy("resolved_file_id").limit(retrieval.MAX_CANDIDATES).collect()
            rows += [(r["resolved_file_id"], 1) for r in more if r["resolved_file_id"] not in ids]
        return self.spark.createDataFrame(rows, "file_id string, scope int")

    def candidates(self, task: str, target: str | None = None, limit: int = retrieval.MAX_CANDIDATES) -> DataFrame:
        """Scored candidates of a task in rank order, the same content at the same place once."""
        tables = self.store.read()
        everything = self._entities(tables)
        symbols = everything.where("kind <> 'file'")
        aimed = []
        if target:
            found = retrieval.target_cascade(symbols, target, self._reexported(tables, target)).collect()
            sure = len(found) == 1 and found[0]["stage"] < 5
            aimed = [(r["id"], k, sure) for k, r in enumerate(found)]
        alone = bool(aimed) and aimed[0][2] and self._is_tiny(tables)
        tokens = [] if alone else [t for t in retrieval._tokens(task) if len(t) > 1]
        corpus = lexical.totals(tables["lexical_lengths"])
        hits = lexical.top_documents(lexical.ranked(tables["postings"], corpus, tokens), limit).collect()
        fts = self.spark.createDataFrame([(r["node_id"], k) for k, r in enumerate(hits)], "id string, fts_position int")
        names = [] if alone else sorted({x.lower() for x in re.findall(T.IDENTIFIER, task) if len(x) > 2})
        exact = symbols.where(F.lower("name").isin(names)).orderBy("id").limit(limit) if names else symbols.limit(0)
        targets = self.spark.createDataFrame(aimed, "id string, target_position int, target_exact boolean")
        anchors = targets.select("id") if aimed else exact.select("id") if names else fts.where("fts_position = 0").select("id")
        evidence = fts.join(targets, "id", "full").join(exact.select("id", F.lit(True).alias("exact_name")), "id", "full")
        near = graph.connected_candidates(tables["edges"], [r["id"] for r in anchors.collect()], evidence).select("id", F.lit(True).alias("graph_near"))
        rows = (
            symbols.join(evidence, "id").join(near, "id", "left").join(F.broadcast(self._scope(tables, task)), "file_id", "left")  # 272 rows at most
            .withColumn("exact_name", F.coalesce("exact_name", F.lit(False))).withColumn("graph_near", F.coalesce("graph_near", F.lit(False)))
        )
        # Some hundred rows at most from here on, so one ordered partition is bounded.
        scored = retrieval.score_candidates(rows, task, target, len(hits))
        placed = scored.withColumn("rank", F.row_number().over(W.orderBy(*retrieval.rank_order())))
        return retrieval.deduplicated(placed).orderBy("rank").limit(limit)

    def _is_tiny(self, tables: dict[str, DataFrame]) -> bool:
        return tables["files"].count() <= TINY_REPO_FILES and tables["symbols"].count() <= TINY_REPO_SYMBOLS

    def _reexported(self, tables: dict[str, DataFrame], target: str) -> DataFrame:
        """Symbols that a name stands for through imports, re-exports included."""
        b = tables["import_bindings"]
        key = lambda f, n: F.concat_ws("|", f, F.lower(n))
        steps = b.where("resolved_file_id IS NOT NULL").select(
            key(F.col("file_id"), F.col("local_name")).alias("name"),
            F.coalesce("resolved_symbol_id", key(F.col("resolved_file_id"), F.col("imported_name"))).alias("target"),
        )
        short = target.rpartition(".")[2].lower()
        named = (F.lower("local_name") == short) | (F.lower("qualified_name") == target.lower())
        starts = b.where(named).orderBy("file_id", "start_line", "local_name").limit(16).select(key(F.col("file_id"), F.col("local_name")).alias("start"))
        leaves = resolution.reexport_closure(steps, starts).select(F.col("leaf").alias("id")).distinct()
        return leaves.join(tables["symbols"].select("id"), "id", "left_semi")

    def _dispatched(self, tables: dict[str, DataFrame], target: str) -> DataFrame:
        """Edges from a target to symbols that literals in its file name, where just one symbol fits."""
        own = tables["symbols"].where(F.col("id") == target).select("file_id")
        literals = tables["parsed_files"].select(T.file_id(F.col("path")).alias("file_id"), F.explode("literals").alias("l"))
        names = literals.join(F.broadcast(own), "file_id", "left_semi").select(F.col("l.name").alias("lookup_name"), F.col("l.relation").alias("relation")).distinct()
        found = tables["symbol_lookup"].join(names, "lookup_name").groupBy("lookup_name", "relation").agg(F.min("symbol_id").alias("first"), F.max("symbol_id").alias("last"))
        return found.where("first = last").select(
            F.lit(target).alias("source"), F.col("first").alias("target"), "relation", F.lit(0.55).alias("confidence")
        ).where("source <> target")

    def _plan(self, task: str, budget: int, exact: bool) -> dict:
        """Intent, mode and limits of a request, by the column functions that serve whole tables."""
        manifest = self.store.read()
        files, symbols = manifest["files"].count(), manifest["symbols"].count()
        tokens = F.col("t")
        asked = self.spark.range(1).select(T.identifier_tokens(F.lit(task)).alias("t"))
        asked = asked.select("t", T.infer_intent(tokens).alias("intent"))
        asked = asked.select("t", "intent", T.plan_mode(tokens, F.col("intent")).alias("mode"))
        caps = retrieval.caps_columns(
            tokens, F.col("intent"), F.col("mode"), F.lit(budget), F.lit(retrieval.band(files, symbols)), F.lit(exact)
        )
        return asked.select("intent", "mode", *[c.alias(k) for k, c in caps.items()]).first().asDict()

    def _sureness(self, ranked: list, exact: bool) -> tuple[float, float]:
        scores = [float(r["score"]) for r in ranked[:2]] + [0.0]
        one, two = retrieval.confidence_and_margin(F.lit(scores[0]), F.lit(scores[1]), F.lit(exact))
        return tuple(self.spark.range(1).select(one.alias("a"), two.alias("b")).first())

    def _source(self, row, tables: dict[str, DataFrame]) -> str:
        """A symbol's lines: from the repository, else as they were parsed."""
        root = (self.store.manifest() or {}).get("root_dir")
        text = repository.read_lines(root, row["path"], row["start_line"], row["end_line"]) if root else None
        if text is not None:
            return text
        held = tables["parsed_files"].where(F.col("path") == row["path"]).select(F.explode("symbols").alias("s"))
        found = held.where((F.col("s.name") == row["name"]) & (F.col("s.start_line") == row["start_line"])).select("s.source").first()
        return found["source"] if found else ""

    def compare(self, repo: str, task: str, target: str | None = None, token_budget: int = 800) -> dict:
        """What a plain search-and-read loop finds for a task, to hold contexts against."""
        files = repository.source_files(self.spark, repo).select("path", F.col("content").cast("string").alias("text"))
        read = lambda path, start, end: repository.read_lines(repo, path, start, end)
        return comparison.retrieve(files.where(F.is_valid_utf8("text")), task, read, target, token_budget)

    def context(self, task: str, target: str | None = None, token_budget: int = 800, source: str = "auto") -> dict:
        """The target of a task and what surrounds it, within a budget of tokens. source says whose
        code goes along: the target's (auto), everybody's (always) or nobody's (never)."""
        if not task or not task.strip():
            raise ValueError("a task is needed")
        if not LEAST_BUDGET <= token_budget <= MOST_BUDGET:
            raise ValueError(f"token_budget must be from {LEAST_BUDGET} to {MOST_BUDGET}")
        if source not in ("auto", "always", "never"):
            raise ValueError("source must be auto, always or never")
        tables = self.store.read()
        tokens = retrieval._tokens(task)
        ranked = self.candidates(task, target).collect()
        if not ranked:
            return {"status": "insufficient", "slices": [], "missing": [{"kind": "target"}]}
        top = ranked[0]
        exact = top["precedence"] == 0 or (top["precedence"] == 2 and sum(bool(r["exact_name"]) for r in ranked) == 1)
        plan = self._plan(task, token_budget, exact)
        intent, ranked = plan["intent"], ranked[: plan["candidate_limit"]]
        confidence, margin = self._sureness(ranked, exact)
        if confidence < retrieval.CONFIDENCE and margin < retrieval.MARGIN:
            few = [{"id": r["id"], "path": r["path"], "line": r["start_line"]} for r in ranked[:3]]
            return {"status": "ambiguous", "candidates": few, "slices": []}
        roles = {top["id"]: "target"}
        if intent != "understand" or plan["mode"] == "structural" or retrieval.mentions_role(tokens):
            occurrences = tables["edge_occurrences"].where(F.col("source") == top["id"]).withColumnRenamed("candidate_targets", "candidates")
            weak = retrieval.inferred_edges(occurrences, tables["symbols"]).unionByName(self._dispatched(tables, top["id"]))
            edges = tables["edges"].select("source", "target", "relation").unionByName(weak.select("source", "target", "relation")).distinct()
            for r in retrieval.one_hop(edges, top["id"], intent, plan["relationship_limit"]).orderBy("position").collect():
                roles.setdefault(r["id"], r["role"])
        rows = {r["id"]: r for r in self._entities(tables).where(F.col("kind") != "file").where(F.col("id").isin(list(roles))).collect()}
        order = {"target": 0} | {role: k for k, role in enumerate(_ROLE_ORDER.get(intent, _ROLE_ORDER["review"]), 1)}
        ahead = sorted(((n, r) for n, r in roles.items() if n in rows), key=lambda x: order.get(x[1], 5))
        chosen = retrieval.select_context(ahead, tokens, intent, plan["slice_limit"])
        response = {"status": "ready", "confidence": round(confidence, 4), "intent": intent, "slices": []}
        for node, role in chosen:
            r = rows[node]
            wanted = source == "always" or (source == "auto" and role == "target")
            part = {
                "id": node, "path": r["path"], "lines": [r["start_line"], r["end_line"]], "symbol": r["name"], "role": role,
                "code": self._source(r, tables) if wanted else "",
            }
            response["slices"].append(part)
            if retrieval.fits(response, token_budget):
                continue
            response["slices"].pop()
            if role == "target":
                need = min(MOST_BUDGET, retrieval.tokens_needed(response | {"slices": [part]}))
                missing = {"kind": "target_source", "path": r["path"], "lines": part["lines"], "required_budget": need}
                step = {"tool": "context", "arguments": {"task": task, "target": node, "token_budget": need}}
                return {"status": "insufficient", "slices": [], "missing": [missing], "next": step}
        return retrieval.shrink(response, token_budget)
