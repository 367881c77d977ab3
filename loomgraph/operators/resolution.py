"""Name resolution as joins: modules, imports, bindings, references and re-exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def module_files(lookup: DataFrame, files: DataFrame) -> DataFrame:
    """module_name, file_id: of several files of one module, that with the greatest path."""
    return (
        lookup.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
        .groupBy("module_name")
        .agg(F.max(F.struct("path", "file_id")).alias("best"))
        .select("module_name", "best.file_id")
    )


def _sets(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(name))


def resolve_references(references: DataFrame, lookup: DataFrame, bindings: DataFrame) -> DataFrame:
    """(file_id, name, target, status, strategy, candidates) for each distinct reference.

    references: (file_id, name); lookup: (name, file_id, symbol_id); bindings: (file_id, name,
    symbol_id) with what an imported name stands for. The cascade: the one symbol of that name in
    the same file, else the one that the name is bound to, else nothing, with all candidates. It
    depends on the pair alone, so repeated references are resolved once.
    """
    asked = references.select("file_id", "name").distinct()
    wanted = lookup.join(asked.select("name").distinct(), "name", "left_semi")
    local = _sets(wanted, ["file_id", "name"], "symbol_id", "local")
    every = _sets(wanted, ["name"], "symbol_id", "every")
    bound = _sets(bindings.where("symbol_id IS NOT NULL"), ["file_id", "name"], "symbol_id", "bound")
    joined = (
        asked.join(local, ["file_id", "name"], "left").join(bound, ["file_id", "name"], "left").join(every, "name", "left")
    )
    none = F.array().cast("array<string>")
    local, bound, every = (F.coalesce(F.col(c), none) for c in ("local", "bound", "every"))
    one = lambda xs: F.size(xs) == 1
    return joined.select(
        "file_id",
        "name",
        F.when(one(local), F.get(local, 0)).when((F.size(local) == 0) & one(bound), F.get(bound, 0)).alias("target"),
        F.when(F.size(local) > 0, F.when(one(local), "resolved").otherwise("ambiguous"))
        .when(F.size(bound) > 0, F.when(one(bound), "resolved").otherwise("ambiguous"))
        .otherwise(F.when(F.size(every) > 1, "ambiguous").otherwise("unresolved")).alias("status"),
        F.when(F.size(local) > 0, "same_file").when(F.size(bound) > 0, "explicit_import").otherwise("unbound_name").alias("strategy"),
        F.when(F.size(local) > 0, local).when(F.size(bound) > 0, bound).otherwise(every).alias("candidates"),
    )


def binding_status(bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """bindings: (.., resolved_file_id, imported_name); symbols: (file_id, name, symbol_id). Adds
    resolved_symbol_id and status: resolved, ambiguous, file_resolved or external."""
    found = _sets(symbols, ["file_id", "name"], "symbol_id", "found").select(
        F.col("file_id").alias("resolved_file_id"), F.col("name").alias("imported_name"), "found"
    )
    joined = bindings.join(found, ["resolved_file_id", "imported_name"], "left")
    n = F.coalesce(F.size("found"), F.lit(0))
    n = F.when(F.col("found").isNull(), 0).otherwise(n)
    return joined.select(
        *bindings.columns,
        F.when(n == 1, F.get("found", 0)).alias("resolved_symbol_id"),
        F.when(F.col("resolved_file_id").isNull(), "external").when(n == 1, "resolved").when(n > 1, "ambiguous")
        .otherwise("file_resolved").alias("status"),
    )


def reexport_closure(bindings: DataFrame, starts: DataFrame, depth: int = 4) -> DataFrame:
    """(start, leaf, hops): follows name -> target bindings from each start, at most depth steps,
    without going round in circles; a leaf is bound to nothing further (or at the last step).

    bindings: (name, target), starts: (start). The joins are unrolled; paths visited are a column."""
    step = bindings.select(F.col("name").alias("at"), F.col("target").alias("next"))
    walk = starts.select("start", F.col("start").alias("at"), F.array("start").alias("seen"))
    leaves = []
    for hop in range(depth + 1):
        onward = walk.join(step, "at", "left")
        leaves.append(onward.where("next IS NULL").select("start", F.col("at").alias("leaf"), F.lit(hop).alias("hops")))
        fresh = onward.where(F.col("next").isNotNull() & ~F.array_contains("seen", F.col("next")))
        walk = fresh.select("start", F.col("next").alias("at"), F.concat("seen", F.array("next")).alias("seen"))
        if hop == depth:
            break
    return reduce(DataFrame.unionByName, leaves).distinct()


def method_parents(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, parent_id): a method's class by the name before its dot, from the same top directory if
    there is one, then by id."""
    top = lambda c: F.substring_index(c, "/", 1)
    m = methods.where(F.instr("name", ".") > 0).select(
        "id", F.substring_index("name", ".", 1).alias("class_name"), top(F.col("path")).alias("m_top")
    )
    c = classes.select(F.col("id").alias("parent_id"), F.col("name").alias("class_name"), top(F.col("path")).alias("c_top"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.col("m_top") == F.col("c_top")), "parent_id"))
    return m.join(c, "class_name").withColumn("r", rank).where("r = 1").select("id", "parent_id")


#: Lines of a file that are searched for imports, and what an import looks like.
IMPORT_LINES = 120
IMPORT_LINE = r"^\s*(?:from\s+([A-Za-z_][A-Za-z0-9_.]*)\s+import|import\s+([A-Za-z_][A-Za-z0-9_.]*))"


def one_hop_imports(files: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, position, line) of Python files that those asked for import, at the first place that does.

    files: (path, text); asked: (path, position). A module is its file, else its package. The head of
    a file is searched by lines, as the feature has it, so nothing is parsed."""
    own = files.join(asked.withColumnRenamed("position", "_at"), "path", "left_semi").where(F.col("path").endswith(".py"))
    heads = own.select("path", F.posexplode(F.slice(F.split("text", r"\r\n|\r|\n"), 1, IMPORT_LINES)).alias("line", "content"))
    module = F.concat(F.regexp_extract("content", IMPORT_LINE, 1), F.regexp_extract("content", IMPORT_LINE, 2))
    wanted = heads.select("path", "line", F.replace(module, F.lit("."), F.lit("/")).alias("module")).where("module <> ''")
    wanted = wanted.join(asked, "path").select(F.struct("position", "line").alias("at"), "module").groupBy("module").agg(F.min("at").alias("at"))
    there = files.select(F.col("path").alias("found"))
    options = wanted.select("at", "module", F.posexplode(F.array(F.concat("module", F.lit(".py")), F.concat("module", F.lit("/__init__.py")))).alias("choice", "found"))
    best = options.join(there, "found", "left_semi").groupBy("module").agg(F.min(F.struct("choice", "found", "at")).alias("b"))
    return best.groupBy(F.col("b.found").alias("path")).agg(F.min("b.at").alias("at")).select("path", "at.position", "at.line")


def tested_by(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """tested -> test edges from the resolved calls of test symbols."""
    tests = symbols.where("is_test").select(F.col("id").alias("_t"))
    return (
        calls.join(tests, calls["source"] == tests["_t"], "left_semi").where("source <> target")
        .select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("tested_by").alias("relation")).distinct()
    )


def decorates(references: DataFrame) -> DataFrame:
    """decorator -> decorated edges from (decorated, decorator) references."""
    return references.where("decorator <> decorated").select(
        F.col("decorator").alias("source"), F.col("decorated").alias("target"), F.lit("decorates").alias("relation")
    ).distinct()
