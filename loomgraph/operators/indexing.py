"""Builds the code graph's tables from parsed files; every step is a projection or a join by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lexical import WEIGHTS, lengths, stored_postings
from .resolution import binding_status, method_parents, module_files, resolve_references
from .store import last_wins, occurrence_key, occurrence_ordinals


def _files(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        T.file_id(F.col("path")).alias("id"), "path", F.substring_index("path", "/", -1).alias("name"), "language", "sha256",
        F.col("status").alias("parse_status"), F.col("error").alias("parse_error"), "size",
        F.lit(0.0).alias("mtime"), F.lit(0.0).alias("updated_at"),
    )


def _all_symbols(parsed: DataFrame) -> DataFrame:
    """Exploded symbols with ids; of redefinitions the last remains."""
    rows = parsed.select("path", F.posexplode("symbols").alias("seq", "s")).select("path", "seq", "s.*")
    parent = F.when(F.col("parent").isNotNull(), T.symbol_id(F.col("path"), F.lit("class"), F.col("parent")))
    rows = rows.select(
        T.symbol_id(F.col("path"), F.col("kind"), F.col("name")).alias("id"), T.file_id(F.col("path")).alias("file_id"),
        parent.alias("parent_id"), *[c for c in rows.columns if c != "parent"],
    )
    return last_wins(rows, ["id"], "seq")


def _modules(parsed: DataFrame) -> DataFrame:
    path = F.col("path")
    module = F.when(F.col("language") == "python", T.python_module(path)).otherwise(T.script_module(path))
    return parsed.select(module.alias("module_name"), T.file_id(path).alias("file_id"), "path", "language")


def wanted_module(language: Column) -> Column:
    """The module that an import (name) of a module (module_name) means."""
    name, module = F.col("name"), F.col("module_name")
    return F.when(language == "python", T.resolve_dotted(name, module)).otherwise(T.resolve_relative(name, module))


def _resolved_imports(parsed: DataFrame, modules: DataFrame, by_module: DataFrame) -> DataFrame:
    rows = (
        parsed.select(T.file_id(F.col("path")).alias("file_id"), "path", "language", F.explode("imports").alias("i"))
        .select("file_id", "path", "language", "i.*")
        .join(modules.select("file_id", "module_name"), "file_id")
    )
    rows = rows.withColumn("wanted", wanted_module(F.col("language"))).withColumn("index", F.concat("wanted", F.lit(".index")))
    direct = by_module.select(F.col("module_name").alias("wanted"), F.col("file_id").alias("direct"))
    index = by_module.select(F.col("module_name").alias("index"), F.col("file_id").alias("through_index"))
    joined = rows.join(direct, "wanted", "left").join(index, "index", "left")
    script = F.when(F.col("language") != "python", F.col("through_index"))
    return joined.withColumn("resolved_file_id", F.coalesce("direct", script))


def build_tables(parsed: DataFrame, base: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All tables of schemas.TABLES but metadata, of the files in `parsed`. Write `parsed` first: it is
    used often. base: tables of the other files, which names and modules may resolve to."""
    others = lambda name, df, *columns: df if base is None else df.unionByName(base[name].select(*columns))
    files = _files(parsed)
    every = _all_symbols(parsed)
    symbols = every.select(
        "id", "file_id", "parent_id", "kind", "name", "signature", "docstring", "start_line", "end_line", "source_hash",
        "is_test", F.lit(0.0).alias("updated_at"),
    )
    # A parent that was no class at top level is not there; it is no parent then.
    parents = symbols.select(F.col("id").alias("_p"))
    symbols = symbols.join(parents, symbols["parent_id"] == parents["_p"], "left").withColumn("parent_id", F.col("_p")).drop("_p")
    # A method whose class is in another file belongs to the class of that name that is nearest.
    placed = others("symbols", symbols, *symbols.columns).where("kind = 'class'").select("id", "name", owner_of("file_id").alias("path"))
    orphans = symbols.where("kind = 'method' AND parent_id IS NULL").select("id", "name", owner_of("file_id").alias("path"))
    elsewhere = method_parents(orphans, placed).select(F.col("id").alias("_m"), F.col("parent_id").alias("_c"))
    symbols = symbols.join(elsewhere, symbols["id"] == elsewhere["_m"], "left").withColumn("parent_id", F.coalesce("parent_id", "_c")).drop("_m", "_c")
    modules = _modules(parsed)
    by_module = module_files(
        others("module_lookup", modules.select("module_name", "file_id"), "module_name", "file_id"), others("files", files.select("id", "path"), "id", "path")
    )
    names = F.explode(F.array_distinct(F.array("name", T.short_name(F.col("name")))))
    own_lookup = symbols.select(names.alias("name"), "file_id", F.col("id").alias("symbol_id"))
    lookup = own_lookup if base is None else own_lookup.unionByName(
        base["symbol_lookup"].select(F.col("lookup_name").alias("name"), T.file_id(owner_of("symbol_id")).alias("file_id"), "symbol_id")
    )

    found = _resolved_imports(parsed, modules, by_module)
    imports = found.select(
        "file_id", F.col("name").alias("import_name"), "resolved_file_id", "start_line", "end_line", "source"
    ).dropDuplicates(["file_id", "import_name", "start_line", "end_line", "source"])
    bound = found.select("file_id", F.col("name").alias("import_name"), "resolved_file_id", "start_line", "end_line", "source", F.explode("bindings").alias("b"))
    bound = bound.select(
        "file_id", "import_name", "resolved_file_id", "start_line", "end_line", "source", F.col("b.local").alias("local_name"),
        F.col("b.imported").alias("imported_name"), F.col("b.kind").alias("binding_kind"),
    )
    bindings = binding_status(bound, lookup).select(
        "file_id", "import_name", "local_name", "imported_name",
        F.concat_ws(".", "import_name", "imported_name").alias("qualified_name"), "binding_kind", "resolved_file_id",
        "resolved_symbol_id", F.col("status").alias("resolution_status"), "start_line", "end_line", "source",
    )

    refs = every.select(
        F.col("id").alias("symbol_id"), "file_id", "is_test", F.posexplode("refs").alias("ref_seq", "r")
    ).select("symbol_id", "file_id", "is_test", "ref_seq", "r.*")
    known = bindings.select("file_id", F.col("local_name").alias("name"), F.col("resolved_symbol_id").alias("symbol_id"))
    resolved = resolve_references(refs, lookup, known)
    hits = refs.join(resolved, ["file_id", "name"])

    calls = hits.where("kind = 'calls' AND target IS NOT NULL AND target <> symbol_id")
    edge = lambda df, s, t, r: df.select(F.col(s).alias("source"), F.col(t).alias("target"), F.lit(r).alias("relation"))
    edges = (
        edge(imports.where("resolved_file_id IS NOT NULL AND resolved_file_id <> file_id"), "file_id", "resolved_file_id", "imports")
        .unionByName(edge(calls, "symbol_id", "target", "calls"))
        .unionByName(edge(hits.where("kind = 'inherits' AND target <> symbol_id"), "symbol_id", "target", "inherits"))
        .unionByName(edge(hits.where("kind = 'decorates' AND target <> symbol_id"), "target", "symbol_id", "decorates"))
        .unionByName(edge(calls.where("is_test"), "target", "symbol_id", "tested_by"))
        .distinct()
        .select("*", F.lit(1.0).alias("confidence"), F.lit("EXTRACTED").alias("confidence_tier"))
    )
    place = ["symbol_id", "kind", "name", "start_line", "end_line", "text"]
    numbered = occurrence_ordinals(hits, place, "ref_seq")
    occurrences = numbered.select(
        occurrence_key(*[F.col(c) for c in [*place, "ordinal"]]).alias("occurrence_key"), F.col("symbol_id").alias("source"),
        "target", F.col("kind").alias("relation"), F.col("file_id").alias("source_file_id"),
        F.col("symbol_id").alias("enclosing_symbol_id"), "name", "start_line", "end_line", F.col("text").alias("source_text"),
        F.col("status").alias("resolution_status"), F.col("strategy").alias("resolution_strategy"),
        F.col("candidates").alias("candidate_targets"),
    )

    of_kind = lambda k, n: F.array_join(F.slice(F.array_sort(F.array_distinct(F.transform(F.filter("refs", lambda r: r["kind"] == k), lambda r: r["name"]))), 1, n), ", ")
    part = lambda text, head="": F.when(text != "", F.concat(F.lit(head), text))
    sentence = F.substring_index(F.coalesce("docstring", F.lit("")), ". ", 1)
    summary = F.concat_ws(" - ", part(F.col("signature")), part(sentence), part(of_kind("inherits", 4), "inherits "), part(of_kind("calls", 8), "calls "))
    source_tokens = F.array_join(T.identifier_tokens(F.col("source")), " ")
    path_of = parsed.select(T.file_id(F.col("path")).alias("file_id"), F.col("path").alias("_path"))
    symbol_docs = every.join(path_of, "file_id").select(
        F.col("id").alias("node_id"), "name", F.col("_path").alias("path"), F.coalesce("signature", F.lit("")).alias("signature"),
        F.coalesce("docstring", F.lit("")).alias("docstring"), summary.alias("summary"), source_tokens.alias("source"), "source_hash", "kind",
    )
    listed = F.array_join(F.slice(F.transform("symbols", lambda s: s["name"]), 1, 8), ", ")
    file_docs = parsed.select(
        T.file_id(F.col("path")).alias("node_id"), F.substring_index("path", "/", -1).alias("name"), "path", F.lit("").alias("signature"),
        F.lit("").alias("docstring"), listed.alias("summary"), F.lit("").alias("source"), F.col("sha256").alias("source_hash"), F.lit("file").alias("kind"),
    )
    documents = symbol_docs.unionByName(file_docs)
    return {
        "files": files,
        "symbols": symbols,
        "module_lookup": modules.select("module_name", "file_id").distinct(),
        "symbol_lookup": own_lookup.select(F.col("name").alias("lookup_name"), "symbol_id").distinct(),
        "edges": edges.select("source", "target", "relation", "confidence", "confidence_tier"),
        "imports": imports,
        "import_bindings": bindings,
        "edge_occurrences": occurrences,
        "summaries": documents.select("node_id", "source_hash", "summary", "kind", F.lit(0.0).alias("updated_at")),
        "lexical_documents": documents.select("node_id", "name", "path", "signature", "docstring", "summary", "source"),
        "postings": stored_postings(documents),
        "lexical_lengths": lengths(documents, list(WEIGHTS)),
    }


def owner_of(column: str) -> Column:
    """The path inside an id of a file or symbol."""
    return F.split(F.col(column), "::")[1]


def entities(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files and symbols as one relation: id, kind, name, path, is_test, start_line, end_line, source_hash, file_id."""
    paths = files.select(F.col("id").alias("file_id"), "path")
    own = files.select(
        "id", F.lit("file").alias("kind"), "name", "path", F.lit(False).alias("is_test"), F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"), F.col("sha256").alias("source_hash"), F.col("id").alias("file_id"),
    )
    return own.unionByName(symbols.join(paths, "file_id").select(*own.columns))
