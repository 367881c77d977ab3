"""Operators on small frames, against facts stated by hand."""

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import maintenance, store
from loomgraph.parse import python_source, script_source


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_identifier_tokens(spark):
    assert one(spark, T.identifier_tokens(F.lit("parseHTTPResponse in user_name2"))) == ["parse", "http", "response", "user", "name2"]


def test_relative_names(spark):
    assert one(spark, T.resolve_dotted(F.lit(".x"), F.lit("a.b.c"))) == "a.b.x"
    assert one(spark, T.resolve_dotted(F.lit("..x"), F.lit("a.b.c"))) == "a.x"
    assert one(spark, T.resolve_relative(F.lit("../src/service"), F.lit("tests.service.test"))) == "src.service"
    assert one(spark, T.script_module(F.lit("src/lib/index.ts"))) == "src.lib"
    assert one(spark, T.python_module(F.lit("pkg/__init__.py"))) == "pkg"


def test_ignore_rules(spark):
    rules = [maintenance.parse_rule(x) for x in ("build/", "*.log", "!keep.log", "/docs/*.py")]
    frame = spark.createDataFrame([(p,) for p in ("build/x.py", "src/build/x.py", "a.log", "keep.log", "docs/a/b.py", "src/docs/b.py")], "path string")
    got = {r.path for r in frame.where(maintenance.is_ignored(F.col("path"), rules)).collect()}
    assert got == {"build/x.py", "src/build/x.py", "a.log", "docs/a/b.py"}
    assert maintenance.parse_rule("# x") is None and maintenance.parse_rule("  ") is None


def test_lease():
    lease = maintenance.Lease(30.0)
    assert lease.acquire("a", 0.0) and not lease.acquire("b", 10.0) and lease.renew("a", 20.0)
    assert not lease.acquire("b", 45.0) and lease.acquire("b", 50.0) and not lease.renew("a", 51.0)
    lease.release("b")
    assert lease.acquire("a", 52.0)


def test_upsert_and_cascade(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in store.upsert(base, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in store.insert_ignore(base, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    gone = spark.createDataFrame([(1,)], "id int")
    assert {tuple(r) for r in store.delete_where(base, "k", gone, "id").collect()} == {(2, "b")}
    assert {tuple(r) for r in store.set_null_where(base, "k", gone, "id").collect()} == {(None, "a"), (2, "b")}


def test_python_parser():
    source = (
        "from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    def hidden(): ...\n@wrap(1)\n@a.b\nclass K(Base, m.Other):\n"
        "    def run(self):\n        def inner():\n            skipped()\n        self.go()\n        return inner\n"
        "try:\n    def one(): pass\nexcept ImportError:\n    def two(): pass\nfor x in y:\n    def never(): pass\n"
    )
    found = python_source.parse(source, False)
    names = [s["name"] for s in found["symbols"]]
    assert names == ["hidden", "K", "K.run", "one", "two"]
    k = found["symbols"][1]
    assert k["start_line"] == 4 and k["signature"] == "class K(Base, m.Other):"
    assert [(r["kind"], r["name"]) for r in k["refs"]] == [("decorates", "wrap"), ("decorates", "a.b"), ("inherits", "Base"), ("inherits", "m.Other")]
    assert [r["name"] for r in found["symbols"][2]["refs"]] == ["go"]
    assert python_source.parse("def (:", False)["status"] == "error"


def test_script_parser():
    source = (
        "import def, { a as b } from './m';\nconst r = require('./n');\n/** Adds. */\nexport function add(x) { return sum(x, '}'); }\n"
        "export interface Shape extends Base<T> { x: number }\nexport const twice = (x) => add(add(x));\n"
        "class K extends Base implements I, J {\n  static async go(a) { if (a) { return new Thing(a); } }\n  // fake() {\n}\n"
        "type Alias = string;\nenum Color { Red }\n"
    )
    found = script_source.parse(source, False)
    assert [(s["kind"], s["name"]) for s in found["symbols"]] == [
        ("function", "add"), ("class", "Shape"), ("function", "twice"), ("class", "K"), ("method", "K.go"), ("class", "Alias"), ("class", "Color"),
    ]
    by = {s["name"]: s for s in found["symbols"]}
    assert by["add"]["docstring"] == "Adds." and [r["name"] for r in by["add"]["refs"]] == ["sum"]
    assert [r["name"] for r in by["K"]["refs"]] == ["Base", "I", "J"] and [r["name"] for r in by["K.go"]["refs"]] == ["Thing"]
    assert [i["name"] for i in found["imports"]] == ["./m", "./n"]
    assert [b["local"] for b in found["imports"][0]["bindings"]] == ["b", "def"]


def test_streams(spark, tmp_path):
    from loomgraph.streaming import refresh_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.py").write_text("x = 1\n")
    seen = []
    query = refresh_stream.refresh_on_arrival(
        refresh_stream.arriving_files(spark, str(folder)), lambda df, _: seen.extend(r.path for r in df.collect()), str(tmp_path / "c")
    )
    query.awaitTermination(60)
    assert [p.rpartition("/")[2] for p in seen] == ["a.py"]


def test_select_context():
    from loomgraph.operators.retrieval import requested_roles, select_context

    rows = [("t", "target"), ("d1", "dependency"), ("d2", "dependency"), ("c1", "caller"), ("c2", "caller"), ("x1", "test"), ("x2", "test"), ("x3", "test")]
    ids = lambda *a: [i for i, _ in select_context(rows, *a)]
    assert requested_roles(["show", "callers", "dependency"], "review") == ["caller", "dependency"]
    assert ids(["change", "it"], "edit", 16) == ["t", "d1", "c1", "x1"]
    assert ids(["change", "callers"], "edit", 16) == ["t", "c1", "c2", "x1", "x2"]
    assert ids(["crash"], "debug", 16) == ["t", "c1", "c2", "x1", "x2", "x3", "d1", "d2"]
    assert ids(["show", "dependencies"], "review", 2) == ["t", "d1"]
    assert select_context([("t", "target")], ["callers"], "edit", 16) == [("t", "target")]


def test_debounce_stream(spark, tmp_path):
    """The stream gives the bursts that the batch form gives, but for those still open at its end."""
    from loomgraph.streaming import refresh_stream

    path = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(path).schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(path).orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in" / "events"))
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    bursts = refresh_stream.debounced_saves(events.withColumnRenamed("user_id", "root"), gap="30 minutes")
    query = bursts.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.root, r.started, r.n) for r in spark.table("bursts").collect()}
    saves = spark.read.parquet(path).select(F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    want = {(r.root, r.started, r.n) for r in maintenance.debounced(saves, "user_id", "ts", "30 minutes").collect()}
    assert got <= want and len(got) > 0.9 * len(want)


def test_explicit_includes(spark, tmp_path):
    from loomgraph.sources import repository

    (tmp_path / "gen").mkdir()
    (tmp_path / "secrets").mkdir()
    for name in ("gen/a.py", "gen/id_rsa", "secrets/b.py", "c.pem", ".env.local"):
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / "gen" / "link.py").symlink_to(tmp_path / "gen" / "a.py")
    (tmp_path / repository.INCLUDE_FILE).write_text("# these\n/gen\nsecrets/*.py\n*.pem\n.env*\nnothing/*\n")
    got = {(r.path, r.decision) for r in repository.explicit_includes(spark, str(tmp_path)).collect()}
    assert got == {
        ("gen/a.py", "included"), ("gen/id_rsa", "sensitive_path"), ("gen/link.py", "symlink"), ("secrets/b.py", "sensitive_path"),
        ("c.pem", "sensitive_path"), (".env.local", "sensitive_path"), (None, "unmatched"),
    }
    assert repository.svn_paths(str(tmp_path)) is None
    assert repository.source_lines("a\r\nb\nc", 2, 9) == "b\nc" and repository.source_lines(None, 1, 1) is None


def test_include_roots():
    import pytest

    from loomgraph.sources import repository

    assert repository.include_roots(("src/./a", "src/a", "b")) == ("src/a", "b")
    for bad in ("../x", "/etc", " "):
        with pytest.raises(ValueError):
            repository.include_roots((bad,))


def test_broken_python_keeps_what_parses():
    from loomgraph.parse import python_source

    source = (
        'import os\n\n\ndef a():\n    return b("é",\n   1)\n\n\ndef broken(:\n    pass\n\n\n@deco(1)\nclass K(Base):\n    """text\nx = (\n"""\n'
        "    def m(self):\n        try:\n            pass\n        except E:\n            a()\n\n\nif x:\n    def c(): pass\nelse:\n    def d(): pass\n"
    )
    found = python_source.parse(source, False)
    assert found["status"] == "ok" and "line 9" in found["error"] and [i["name"] for i in found["imports"]] == ["os"]
    places = {s["name"]: (s["start_line"], s["end_line"], [r["text"] for r in s["refs"]]) for s in found["symbols"]}
    assert places == {
        "a": (4, 6, ['b("é",\n   1)']), "K": (13, 22, ["deco(1)", "Base"]), "K.m": (18, 22, ["a()"]), "c": (26, 26, []), "d": (28, 28, []),
    }
    assert python_source.parse("def x(:\n", False)["status"] == "error"


def test_script_parser_regular_expressions_and_spans():
    from loomgraph.parse import script_source

    source = "/** Doc. */\nexport class K {\n  m(x) { return a(x, \")\"); }\n}\nconst re = /[\"'{]/g;\nfunction f(x) { return /\\{\"/.test(x) && a(\n  1,\n  2); }\n"
    found = {s["name"]: s for s in script_source.parse(source, False)["symbols"]}
    assert set(found) == {"K", "K.m", "f"} and found["K"]["docstring"] == "Doc." and found["f"]["end_line"] == 8
    assert [r["text"] for r in found["K.m"]["refs"]] == ['a(x, ")")'] and ("a(\n  1,\n  2)", 6, 8) in [(r["text"], r["start_line"], r["end_line"]) for r in found["f"]["refs"]]


def _git(root, *args):
    import subprocess

    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_rules_and_walk(spark, tmp_path):
    from loomgraph.sources import repository

    for name in ("a.py", "gen/b.py", "gen/keep.py", "sub/c.py", "sub/d.py", "dist/e.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("gen/\n/sub/c.py\n")
    names = lambda root, **k: {r.path for r in repository.source_names(spark, str(root), **k).collect()}
    assert names(tmp_path) == {"a.py", "sub/d.py"}  # a walk obeys all rules and does not enter gen
    assert repository.walked_paths(str(tmp_path), repository.ignore_rules(str(tmp_path))) == [".gitignore", "a.py", "sub/c.py", "sub/d.py"]
    assert names(tmp_path, exclude=("a.py",)) == {"sub/d.py"} and names(tmp_path, roots=("sub",)) == {"sub/d.py"}
    (tmp_path / ".gitignore").write_text("gen/*\n!gen/keep.py\n/sub/c.py\n")
    assert names(tmp_path) == {"a.py", "gen/keep.py", "sub/d.py"}
    _git(tmp_path, "init", "-q")
    _git(tmp_path, "add", "-f", "gen/b.py", "a.py", "sub/c.py")
    assert names(tmp_path) == {"a.py", "gen/b.py", "sub/c.py"}  # what git tracks does not obey git's rules
    assert names(tmp_path / "sub") == {"c.py"}
    (tmp_path / repository.IGNORE_FILE).write_text("/sub/c.py\n")
    assert names(tmp_path) == {"a.py", "gen/b.py"} and names(tmp_path / "sub") == set()
    for path in ("a.py", "gen/b.py", "sub/c.py", "sub/d.py", "none.py"):
        assert repository.is_discoverable(str(tmp_path), path) == (path in ("a.py", "gen/b.py"))
    assert repository.untracked_paths(str(tmp_path), []) == [] and "sub/d.py" in repository.untracked_paths(str(tmp_path))


def test_head_and_submodules(tmp_path):
    from loomgraph.sources import repository

    root, inner = tmp_path / "r", tmp_path / "inner"
    for at in (root, inner):
        at.mkdir()
        _git(at, "init", "-q", "-b", "main")
        (at / "m.py").write_text("x = 1\n")
        _git(at, "add", "-A")
        _git(at, "commit", "-qm", "one")
    loose = repository.git_head(str(root))
    assert loose[0] == "main" and loose[1] == repository.git(str(root), "rev-parse", "HEAD").decode()[:12]
    _git(root, "pack-refs", "--all")
    _git(root, "worktree", "add", "-q", str(tmp_path / "w"), "-b", "side")
    assert repository.git_head(str(root)) == loose and repository.git_head(str(tmp_path / "w")) == ("side", loose[1])
    _git(root, "checkout", "-q", "--detach")
    assert repository.git_head(str(root)) == ("HEAD", loose[1]) and repository.git_head(str(tmp_path)) == (None, None)
    _git(root, "-c", "protocol.file.allow=always", "submodule", "add", "-q", str(inner), "lib")
    assert repository.vcs_paths(str(root)) == [".gitmodules", "lib/m.py", "m.py"]


def test_change_scan(spark, tmp_path, monkeypatch):
    """Hashes, git and file times find the same changes, and the latter two read suspects alone."""
    from loomgraph.plans.engine import Engine
    from loomgraph.sources import change_scan

    root = tmp_path / "r"
    root.mkdir()
    for name in "abcd":
        (root / f"{name}.py").write_text(f"def {name}():\n    pass\n")
    _git(root, "init", "-q")
    _git(root, "add", "-A")
    _git(root, "commit", "-qm", "one")
    (root / "d.py").write_text("def dirty():\n    pass\n")
    engine = Engine(spark, str(tmp_path / "s"))
    engine.index(str(root))
    stored, manifest = engine.store.read()["files"], engine.store.manifest()
    scan = lambda m=manifest: {(r.path, r.change) for r in change_scan.changes(spark, str(root), stored, m).collect()}
    assert scan() == set() and manifest["built_dirty"] == ["d.py"]
    _git(root, "checkout", "-q", "--", "d.py")  # clean again, but not what was indexed
    (root / "a.py").write_text("def a():\n    return 1\n")
    _git(root, "commit", "-qam", "two")
    (root / "b.py").unlink()
    (root / "e.py").write_text("def e():\n    pass\n")
    _git(root, "add", "e.py")
    want = {("a.py", "changed"), ("b.py", "deleted"), ("d.py", "changed"), ("e.py", "new")}
    assert scan() == want
    monkeypatch.setattr(change_scan, "TINY_FILES", -1)
    assert change_scan.git_suspects(str(root), manifest) == ["a.py", "b.py", "d.py", "e.py"] and scan() == want
    without_git = manifest | {"built_commit": None}
    assert change_scan.git_suspects(str(root), without_git) is None and scan(without_git) == want
    stats = change_scan.repository.source_stats(spark, str(root))
    assert {r.path for r in change_scan.stat_suspects(stored, stats).collect()} == {"a.py", "b.py", "d.py", "e.py"}
    (root / ".gitmodules").write_text("")
    assert change_scan.git_suspects(str(root), manifest) is None
    (root / ".gitmodules").unlink()
    assert change_scan.git_suspects(str(root), manifest) is not None
    (root / ".gitignore").write_text("x\n")  # other rules: git's answer is not enough
    assert change_scan.git_suspects(str(root), manifest) is None and scan() == want


def test_unchanged_trees_are_not_read_again(spark, tmp_path, monkeypatch):
    from loomgraph.plans.engine import Engine

    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("def a():\n    pass\n")
    engine = Engine(spark, str(tmp_path / "s"))
    engine.index(str(root))
    assert engine.is_current(str(root))
    real = engine.changes
    monkeypatch.setattr(engine, "changes", lambda repo: (_ for _ in ()).throw(AssertionError("read again")))
    assert engine.is_current(str(root))
    monkeypatch.setattr(engine, "changes", real)
    (root / "b.py").write_text("def b():\n    pass\n")
    assert not engine.is_current(str(root))


def test_ranked_matches(spark):
    from loomgraph.operators import lexical

    rows = [("src/user.py", "x = 1\ndef save(user):\n    user = 2"), ("tests/a.py", "user"), ("b.py", "class Other:\n    superuser()")]
    found = lexical.ranked_matches(spark.createDataFrame(rows, "path string, text string"), ["User"], 9).collect()
    assert [tuple(r) for r in found] == [("src/user.py", 2, 19), ("src/user.py", 3, 7), ("b.py", 2, 0), ("tests/a.py", 1, -4)]
    assert not lexical.line_search(spark.createDataFrame([(1, "def a():")], "doc_id long, text string"), ["zzz"], 5).collect()
