"""Set operations, upserts, cascades and versioned snapshots of the engine's tables.

A snapshot is a list of layers, each a directory of Parquet tables. A full build is one layer. A
refresh adds one with the rows of the files it touched; reading takes those files' rows from there
and leaves them out of the layers below, so a small change writes few rows. Publishing validates the
tables and then replaces one pointer file: readers see the old snapshot or the new one, never a
mixture, and the layers of the last KEPT_SNAPSHOTS stay for those who still read them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import FOREIGN_KEYS, OWNERS, TABLES

SCHEMA_VERSION = "3"
#: Snapshots whose layers are kept, and layers from which a refresh builds one layer anew.
KEPT_SNAPSHOTS, MOST_LAYERS = 3, 8


class SchemaMismatch(RuntimeError):
    """The snapshot was written under another schema; it has to be built anew."""


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys, the last in order: a combining maximum rather than a window."""
    rest = [c for c in rows.columns if c not in keys]
    held = F.max(F.struct(F.col(order).alias("_o"), *rest)).alias("_r")
    return rows.groupBy(*keys).agg(held).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    held = F.min(F.struct(F.col(order).alias("_o"), *rest)).alias("_r")
    return rows.groupBy(*keys).agg(held).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base with rows of new put in place of, or beside, those with equal keys (new: unique keys)."""
    return base.join(new.select(*keys), keys, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base with those rows of new whose keys it does not have yet."""
    fresh = new.join(base.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return base.unionByName(fresh.select(*base.columns))


def delete_where(base: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """Cascade: rows that refer to something gone go too."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return base.join(ids, base[column] == ids["_gone"], "left_anti")


def set_null_where(base: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """References to something gone become null; the rows stay."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    joined = base.join(ids, base[column] == ids["_gone"], "left")
    return joined.select(
        *[F.when(F.col("_gone").isNull(), base[c]).alias(c) if c == column else base[c] for c in base.columns]
    )


def foreign_key_report(tables: dict[str, DataFrame], keys=FOREIGN_KEYS) -> DataFrame:
    """(table, column, references, violations) for each foreign key whose tables are given."""
    out = None
    for name, column, target, *rest in keys:
        if name not in tables or target not in tables:
            continue
        target_key = rest[0] if rest else "id"
        ids = tables[target].select(F.col(target_key).alias("_id"))
        rows = tables[name].where(F.col(column).isNotNull())
        bad = rows.join(ids, rows[column] == ids["_id"], "left_anti")
        one = bad.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("table"), F.lit(column).alias("column"), F.lit(target).alias("references"), "violations"
        )
        out = one if out is None else out.unionByName(one)
    return out


class SnapshotStore:
    """Versioned snapshots under one root that Spark and its file system can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict | None:
        """What the pointer says; an error if the schema is another one."""
        pointer = f"{self.root}/CURRENT"
        if not self._fs.exists(self._path(pointer)):
            return None
        found = json.loads("".join(r["value"] for r in self.spark.read.text(pointer).collect()))
        if found.get("schema_version") != SCHEMA_VERSION:
            raise SchemaMismatch(f"snapshot has schema {found.get('schema_version')}, not {SCHEMA_VERSION}")
        return found

    def _layer(self, version: str, names: list[str]) -> dict[str, DataFrame]:
        return {name: self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{version}/{name}") for name in names}

    def _merged(self, layers: list[dict]) -> dict[str, DataFrame]:
        """The tables of layers, the oldest first; a layer's touched files hide those below it."""
        out: dict[str, DataFrame] = {}
        hidden = None
        for layer in reversed(layers):
            for name, df in self._layer(layer["version"], layer["tables"]).items():
                if hidden is not None and name in OWNERS:
                    df = df.join(hidden, owner_path(name) == F.col("_touched"), "left_anti")
                out[name] = df if name not in out else out[name].unionByName(df)
            if layer.get("touched"):
                paths = self.spark.read.schema("path string").parquet(f"{self.root}/{layer['version']}/_touched")
                paths = paths.select(F.col("path").alias("_touched"))
                hidden = paths if hidden is None else hidden.unionByName(paths).distinct()
        return out

    def read(self) -> dict[str, DataFrame]:
        found = self.manifest()
        if found is None:
            raise FileNotFoundError(f"no snapshot under {self.root}")
        return self._merged(found["layers"])

    def publish(
        self, tables: dict[str, DataFrame], still_owner: Callable[[], bool] = lambda: True, touched: DataFrame | None = None, **metadata
    ) -> dict:
        """Writes beside the current snapshot, validates, checks the lease, then moves the pointer.

        With `touched` (path) the tables are a layer on the current one, with those files' rows only;
        without it they are the whole snapshot."""
        before = self.manifest()
        version = f"v-{uuid.uuid4().hex}"
        at = f"{self.root}/{version}"
        for name, df in tables.items():
            df.write.parquet(f"{at}/{name}")
        layer = {"version": version, "tables": sorted(tables), "touched": touched is not None}
        if touched is not None:
            touched.select("path").distinct().write.parquet(f"{at}/_touched")
        layers = [*(before["layers"] if touched is not None else ()), layer]
        report = foreign_key_report(self._merged(layers))
        bad = report.where("violations > 0").collect() if report is not None else []
        if bad or not still_owner():
            self._fs.delete(self._path(at), True)
            raise RuntimeError(f"not published: {bad or 'the lease was lost'}")
        kept = [[x["version"] for x in layers], *(before or {}).get("kept", [])]
        found = {
            "schema_version": SCHEMA_VERSION, "version": version, "layers": layers, "kept": kept[:KEPT_SNAPSHOTS],
            "index_revision": (before or {}).get("index_revision", 0) + 1, **metadata,
        }
        self.replace_file(f"{self.root}/CURRENT", json.dumps(found, sort_keys=True))
        held = {v for versions in found["kept"] for v in versions}
        for gone in {v for versions in kept[KEPT_SNAPSHOTS:] for v in versions} - held:
            self._fs.delete(self._path(f"{self.root}/{gone}"), True)
        return found

    def replace_file(self, path: str, text: str) -> None:
        """Writes a file beside its place and moves it there, so readers see the old or the new one."""
        fresh = self._path(f"{path}.{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        context = jvm.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.OVERWRITE
        context.rename(fresh, self._path(path), options)


def owner_path(table: str) -> Column:
    """The file that a row of a table belongs to: that whose parsing gave it."""
    column = OWNERS[table]
    if table == "edges":
        # Decorations and tests are references in the file of the edge's target.
        column = F.when(F.col("relation").isin("decorates", "tested_by"), F.col("target")).otherwise(F.col("source"))
        return F.split(column, "::")[1]
    return F.col(column) if column == "path" else F.split(F.col(column), "::")[1]


def occurrence_ordinals(rows: DataFrame, location: list[str], order: str) -> DataFrame:
    """A running ordinal among rows at the same location, which makes their keys unique."""
    return rows.withColumn("ordinal", F.row_number().over(W.partitionBy(*location).orderBy(order)) - 1)


def occurrence_key(*parts: Column) -> Column:
    """A 128-bit key of a location: the first half of SHA-256 over its parts, which the JVM has."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.unhex(F.sha2(joined, 256)), 1, 16)
