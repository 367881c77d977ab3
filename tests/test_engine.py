import subprocess

import pytest

from loomgraph.operators import graph
from loomgraph.plans.engine import Engine


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    files = {
        "helpers.py": "def clean_name(value):\n    return value.strip()\n\n\ndef unused():\n    pass\n",
        "service.py": "from helpers import clean_name\n\n\ndef create_user(name):\n    return clean_name(name)\n",
        "tests/test_service.py": "from service import create_user\n\n\ndef test_create():\n    assert create_user(' a ')\n",
        "models.py": "import abc\n\n\nclass Base(abc.ABC):\n    def save(self):\n        self.check()\n\n    def check(self):\n        pass\n\n\nclass User(Base):\n    pass\n",
        "src/text.ts": "/** Trims. */\nexport function trim(x: string): string {\n  return x.trim();\n}\n",
        "src/store.ts": "import { trim } from './text';\n\nexport class Store extends Object {\n  put(x: string) {\n    return trim(x);\n  }\n}\n",
        "broken.py": "def x(:\n",
        "large.py": "def big():\n" + "".join(f"    value_{k} = {k}\n" for k in range(400)),
        "latin.py": None,
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"# \xff\n" if text is None else text.encode())
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    subprocess.run(["git", "-C", str(root), "add", "-A"], check=True)
    return root


@pytest.fixture(scope="module")
def engine(spark, repo, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("snapshots")))
    done = e.index(str(repo))
    assert done["files"] == 8 and done["revision"] == 1
    return e


def edges(engine):
    return {(r.source.rpartition("::")[2], r.relation, r.target.rpartition("::")[2]) for r in engine.store.read()["edges"].collect()}


def test_edges(engine):
    found = edges(engine)
    assert ("create_user", "calls", "clean_name") in found
    assert ("service.py", "imports", "helpers.py") in found
    assert ("create_user", "tested_by", "test_create") in found
    assert ("User", "inherits", "Base") in found
    assert ("Base.save", "calls", "Base.check") in found
    assert ("src/store.ts", "imports", "src/text.ts") in found
    assert ("Store.put", "calls", "trim") in found


def test_status(engine):
    status = engine.status()
    assert status["errors"] == 1 and status["languages"] == ["python", "typescript"]


def test_graph_and_path(engine):
    near = engine.graph("create_user", 1)
    names = {n.rpartition("::")[2] for n, _ in near.nodes}
    assert names == {"create_user", "clean_name", "test_create"}
    assert len(engine.path("create_user", "clean_name")) == 2
    assert engine.path("create_user", "unused") is None
    with pytest.raises(KeyError):
        engine.graph("nothing at all")


def test_minimal_and_context(engine):
    assert engine.minimal()["files"] == 8
    answer = engine.context("Change create_user", "create_user")
    assert answer["status"] == "ready"
    assert answer["slices"][0]["symbol"] == "create_user"
    assert {"clean_name", "test_create"} <= {s["symbol"] for s in answer["slices"]}
    assert answer["slices"][0]["code"] == "def create_user(name):\n    return clean_name(name)\n"
    assert not any(s["code"] for s in answer["slices"][1:])
    always = engine.context("Change create_user", "create_user", source="always")
    assert {s["symbol"]: s["code"] for s in always["slices"]}["clean_name"] == "def clean_name(value):\n    return value.strip()\n"
    never = engine.context("Explain create_user", "create_user", source="never")
    assert never["status"] == "ready" and [s["code"] for s in never["slices"]] == [""]
    large = engine.context("Change big", "big", token_budget=256)
    assert large["status"] == "insufficient" and large["slices"] == [] and large["missing"][0]["kind"] == "target_source"
    assert engine.context("Change big", "big", token_budget=large["missing"][0]["required_budget"])["status"] == "ready"
    with pytest.raises(ValueError):
        engine.context("x", token_budget=1)


def test_tiny_target_and_comparison(engine, repo):
    from loomgraph.plans import renderer

    alone = engine.candidates("Change create_user and clean_name", "create_user").collect()
    assert [r["name"] for r in alone] == ["create_user"]
    assert "clean_name" in {r["name"] for r in engine.candidates("Change create_user and clean_name").collect()}
    found = engine.compare(str(repo), "Explain create_user", "create_user")
    assert found["terms"] == ["create_user"] and found["slices"][0]["path"] == "service.py" and "def create_user" in found["slices"][0]["code"]
    assert {"helpers.py", "tests/test_service.py"} <= {s["path"] for s in found["slices"]} and found["tokens"] <= 800
    assert engine.compare(str(repo), "Explain nothing_like_it")["slices"] == []
    text = renderer.context_markdown(engine.context("Change create_user", "create_user"))
    assert text.startswith("# Context\n\nStatus: `ready`\n") and "### `service.py:4-5` `create_user` (target)\n\n```\ndef create_user" in text
    assert "## Missing" not in text and "## Next" in renderer.context_markdown(engine.context("Change big", "big", token_budget=256))
    assert renderer.status_summary(engine.status()).endswith("Languages: python, typescript\nNot parsed: 1\n")


def test_refresh(engine, repo):
    assert engine.refresh(str(repo))["changed"] == 0
    (repo / "helpers.py").write_text("def tidy_name(value):\n    return value\n")
    done = engine.refresh(str(repo))
    assert done["changed"] == 1 and done["revision"] == 2
    assert ("create_user", "calls", "clean_name") not in edges(engine)
    occurrences = engine.store.read()["edge_occurrences"].where("name = 'clean_name'").collect()
    assert occurrences and all(o.target is None and o.resolution_status == "unresolved" for o in occurrences)


def test_refresh_equals_a_build(spark, tmp_path):
    """After some edits a refreshed snapshot holds what a build from nothing holds."""
    repo = tmp_path / "r"
    files = {
        "a.py": "def one():\n    return two()\n\n\ndef shared():\n    pass\n", "b.py": "from a import one\n\n\ndef call():\n    one()\n    late()\n",
        "c.py": "import later\nfrom b import call\n\n\nclass K:\n    def m(self):\n        call()\n", "tests/test_b.py": "from b import call\n\n\ndef test_call():\n    call()\n",
        "d.py": "def alone():\n    return 1\n",
    }
    edits = [
        {"b.py": "from a import one, two\n\n\ndef call():\n    one()\n    two()\n"},
        {"a.py": None, "later.py": "def late():\n    pass\n", "e.py": "def shared():\n    alone()\n"},
    ]

    def write(part):
        for name, text in part.items():
            (repo / name).parent.mkdir(parents=True, exist_ok=True)
            (repo / name).unlink() if text is None else (repo / name).write_text(text)

    write(files)
    kept = Engine(spark, str(tmp_path / "kept"))
    kept.index(str(repo))
    for part in edits:
        write(part)
        done = kept.refresh(str(repo))
        assert done["changed"] == len(part) and done["rebuilt"] <= done["files"]
    fresh = Engine(spark, str(tmp_path / "fresh"))
    fresh.index(str(repo))
    ours, theirs = kept.store.read(), fresh.store.read()
    for name in theirs:
        if name != "parsed_files":
            assert sorted(map(str, ours[name].collect())) == sorted(map(str, theirs[name].collect())), name
    assert "d.py" not in {r.path for r in spark.read.parquet(f"{kept.store.root}/{kept.store.manifest()['layers'][1]['version']}/_touched").collect()}


def test_bounds(spark):
    frame = spark.createDataFrame([("a", "b", "calls", "EXTRACTED")], "source string, target string, relation string, confidence_tier string")
    with pytest.raises(ValueError):
        graph.neighbourhood(frame, "a", 4)
    with pytest.raises(ValueError):
        graph.edge_filter(None, ["WRONG"])
    assert graph.shortest_path(frame, "a", "a") == [("a", None)]
    assert graph.shortest_path(frame, "b", "a") == [("b", None), ("a", "calls")]


def test_freshness(spark, repo, tmp_path):
    from loomgraph.plans.freshness import Coordinator

    e = Engine(spark, str(tmp_path))
    c = Coordinator(e, refresh_seconds=300.0)
    assert c.ensure_current(str(repo)).state == "refreshed"
    assert c.ensure_current(str(repo)).state == "current"
    assert c.ensure_current("/elsewhere").state == "index_required"
    (repo / "service.py").write_text("def other():\n    pass\n")
    c.refresh_seconds = 0.1
    assert c.lease.acquire("someone") and not c.lease.acquire("else")
    assert c.ensure_current(str(repo)).state == "refreshing"
    c.lease.release("someone")
    c.refresh_seconds = 300.0
    assert c.ensure_current(str(repo)).revision == 2


def test_dispatch_by_literals(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    (repo / "handlers.py").write_text("def on_order():\n    pass\n\n\ndef twice():\n    pass\n")
    (repo / "other.py").write_text("def twice():\n    pass\n")
    (repo / "router.py").write_text(
        "import handlers\n\nTABLE = {'o': handlers.on_order, 't': handlers.twice}\n\n\ndef route(key):\n    return getattr(handlers, 'on_order')() or TABLE[key]()\n"
    )
    e = Engine(spark, str(tmp_path / "s"))
    e.index(str(repo))
    tables = e.store.read()
    found = e._dispatched(tables, "symbol::router.py::function::route").collect()
    want = {("symbol::handlers.py::function::on_order", r) for r in ("dispatches", "registers")}
    assert {(r.target, r.relation) for r in found} == want  # `twice` may be either function
    assert "on_order" in {s["symbol"] for s in e.context("Debug route dependency flow", "route")["slices"]}
