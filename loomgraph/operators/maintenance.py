"""Incremental maintenance: change detection, refresh, leases, debouncing, ignore rules."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def detect_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): changed, new, deleted or unchanged, by a full outer join on path."""
    s, c = stored.select("path", F.col("sha256").alias("old")), current.select("path", F.col("sha256").alias("new"))
    change = (
        F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "new")
        .when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    )
    return s.join(c, "path", "full_outer").select("path", change.alias("change"))


def refresh(stored: DataFrame, current: DataFrame, dependents: DataFrame | None = None) -> DataFrame:
    """(path, sha256, origin): the table after a refresh; changed and dependent rows are written anew."""
    changes = detect_changes(stored, current)
    again = changes.where(F.col("change").isin("changed", "new")).select("path")
    if dependents is not None:
        again = again.unionByName(dependents.select("path")).distinct()
    gone = changes.where("change = 'deleted'").select("path")
    kept = stored.join(gone, "path", "left_anti").join(again, "path", "left_anti").select("path", "sha256")
    fresh = current.join(again, "path", "left_semi").select("path", "sha256")
    return kept.withColumn("origin", F.lit("kept")).unionByName(fresh.withColumn("origin", F.lit("written")))


def debounced(events: DataFrame, root: str, at: str, gap: str) -> DataFrame:
    """(root, started, ended, n): one run at the end of each burst of saves of a root.

    Works on streams too: session windows merge events less than `gap` apart."""
    grouped = events.groupBy(F.col(root).alias("root"), F.session_window(F.col(at), gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last")).select(
        "root", F.col("w.start").alias("started"), F.col("last").alias("ended"), "n"
    )


def latest_revision(statuses: DataFrame, root: str, revision: str) -> DataFrame:
    """The newest status of each root; superseded ones are dropped."""
    rest = [c for c in statuses.columns if c != root]
    return statuses.groupBy(root).agg(F.max(F.struct(F.col(revision).alias("_r"), *rest)).alias("m")).select(
        root, *[F.col(f"m.{c}").alias(c) for c in rest]
    )


@dataclass
class Lease:
    """Who may refresh a root and until when; acquiring drops what has expired."""

    seconds: float = 30.0
    owner: str | None = None
    expires_at: float = float("-inf")

    def acquire(self, owner: str, now: float) -> bool:
        if self.owner is not None and self.expires_at > now:
            return self.owner == owner
        self.owner, self.expires_at = owner, now + self.seconds
        return True

    def renew(self, owner: str, now: float) -> bool:
        if self.owner != owner or self.expires_at <= now:
            return False
        self.expires_at = now + self.seconds
        return True

    def release(self, owner: str) -> None:
        if self.owner == owner:
            self.owner, self.expires_at = None, float("-inf")


def lease_timeline(attempts: DataFrame, root: str, at: str, order: str, seconds: float) -> DataFrame:
    """Which attempts acquire the lease, when each holds it for `seconds` and nobody releases.

    attempts: root, at (epoch seconds), order. Whether an attempt succeeds hangs on the last that
    did, so a root's attempts are folded in order, streamed through the task that has the root."""
    out = f"{root} long, {order} long, {at} double, acquired boolean"

    def fold(batches):
        import pyarrow as pa

        current, until = object(), float("-inf")
        for batch in batches:
            roots, orders, times = (batch.column(k).to_pylist() for k in range(3))
            won = []
            for r, t in zip(roots, times, strict=True):
                if r != current:
                    current, until = r, float("-inf")
                won.append(t >= until)
                until = t + seconds if won[-1] else until
            yield pa.RecordBatch.from_arrays(
                [pa.array(roots, pa.int64()), pa.array(orders, pa.int64()), pa.array(times, pa.float64()), pa.array(won)],
                names=[root, order, at, "acquired"],
            )

    rows = attempts.select(F.col(root).cast("bigint"), F.col(order).cast("bigint"), F.col(at).cast("double"))
    return rows.repartition(root).sortWithinPartitions(root, at, order).mapInArrow(fold, out)


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    negated: bool = False
    anchored: bool = False
    dir_only: bool = False
    source: str = "ignorefile"
    #: Where the tree lies below the folder of the rule's file; anchored patterns begin at that folder.
    under: str = ""


def parse_rule(line: str, source: str = "ignorefile", under: str = "") -> IgnoreRule | None:
    """A line of an ignore file; blank lines and comments are none."""
    body = line.strip()
    if not body or body.startswith("#"):
        return None
    negated, body = body.startswith("!"), body.removeprefix("!")
    dir_only, body = body.endswith("/"), body.rstrip("/") if body.endswith("/") else body
    anchored, body = "/" in body, body.lstrip("/")
    return IgnoreRule(body, negated, anchored, dir_only, source, under) if body else None


def effective_rules(rules: list[IgnoreRule], held: bool) -> list[IgnoreRule]:
    """Files that version control holds, or that are named explicitly, obey no rules of version control."""
    return [r for r in rules if r.source != "vcsignore"] if held else rules


def ignored_path(path: str, rules: list[IgnoreRule], is_dir: bool = False) -> bool:
    """is_ignored for one path on the driver, for walks and questions about single files."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        at, folder, verdict = "/".join(parts[:n]), n < len(parts) or is_dir, False
        for rule in rules:
            if folder or not rule.dir_only:
                target = f"{rule.under}/{at}".lstrip("/") if rule.anchored else parts[n - 1]
                verdict = not rule.negated if fnmatch.fnmatchcase(target, rule.pattern) else verdict
        if verdict:
            return True
    return False


def enters(folder: str, rules: list[IgnoreRule]) -> bool:
    """Whether a walk has to look into a folder: one that is ignored is left out, unless a negated
    rule could bring back something in it."""
    return any(r.negated for r in rules) or not ignored_path(folder, rules, is_dir=True)


def _pattern(glob: str) -> str:
    """A shell pattern as a Java regular expression; * also crosses slashes."""
    python = fnmatch.translate(glob)
    inner = python.removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z")
    return f"(?s)^(?:{inner})$"


def is_ignored(path: Column, rules: list[IgnoreRule]) -> Column:
    """Parents first: an ignored directory takes all below it along. Among rules that match one
    level, the last wins. The rules are a file's few lines, so they are compiled into the plan."""

    def level(target: Column, name: Column, is_dir: Column) -> Column:
        verdict = F.lit(False)
        for rule in rules:
            full = F.concat(F.lit(rule.under + "/"), target) if rule.under else target
            hit = (full if rule.anchored else name).rlike(_pattern(rule.pattern))
            if rule.dir_only:
                hit = hit & is_dir
            verdict = F.when(hit, F.lit(not rule.negated)).otherwise(verdict)
        return verdict

    parts = F.split(path, "/")
    ups = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.struct(
            F.array_join(F.slice(parts, F.lit(1), n), "/").alias("p"), F.get(parts, n - 1).alias("n"),
            (n < F.size(parts)).alias("d"),
        ),
    )
    return F.exists(ups, lambda u: level(u["p"], u["n"], u["d"]))


def range_matches(items: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """items (key, id, lo, hi) that overlap any permitted range (key, lo, hi) of the same key."""
    r = ranges.select(F.col(key).alias("_k"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return items.join(r, (items[key] == r["_k"]) & (items["lo"] <= r["_hi"]) & (items["hi"] >= r["_lo"]), "left_semi")


def metrics(rows: DataFrame, group: str, value: str, good: Column) -> DataFrame:
    """Median, mean, deviation, 95th percentile by nearest rank, and the rate of good rows, by group.

    Median and percentile come from a histogram of values, so a hot group is combined before it moves.
    Without values they are null."""
    hist = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.partitionBy(group))
    ranked = hist.select(F.col(group).alias("_g"), F.col(value).alias("_v"), upto.alias("upto"), total.alias("total"))
    first = lambda reached: F.min(F.when(reached, F.col("_v")))
    low, high = first(2 * F.col("upto") >= F.col("total")), first(2 * F.col("upto") > F.col("total"))
    ranks = ranked.groupBy("_g").agg(
        ((low + high) / 2).cast("double").alias("median"), first(F.col("upto") > F.bround(0.95 * (F.col("total") - 1))).alias("p95")
    )
    base = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"),
        F.avg(good.cast("double")).alias("rate"),
    )
    joined = base.join(ranks, base[group].eqNullSafe(ranks["_g"]), "left")
    return joined.select(group, "n", "median", "mean", "deviation", "rate", "p95")
