"""Column expressions over identifiers, paths, ids and texts; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that identifier tokens leave out.
STOP_WORDS = (
    "in", "on", "by", "to", "of", "at", "is", "it", "or", "an", "do", "be", "no", "up", "as", "if", "so", "we",
    "my", "py", "the", "and", "for", "with", "from", "that", "this", "into", "are", "was", "has", "had", "not",
    "its",
)

#: Patterns of the tokenizer, in the order they apply, and of names and file mentions.
CAMEL, ACRONYM, NON_ALNUM = "([a-z0-9])([A-Z])", "([A-Z]{2,})([A-Z][a-z])", "[^a-zA-Z0-9]+"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_.]*"

#: Directories whose files count as generated or vendored.
GENERATED_PARTS = (".generated", ".venv", "build", "dist", "generated", "node_modules", "third_party", "vendor")

#: Words that tell what a task wants.
EDIT_WORDS = (
    "add", "change", "edit", "fix", "implement", "migrate", "modify", "refactor", "remove", "rename", "replace",
    "update",
)
DEBUG_WORDS = (
    "bug", "crash", "debug", "error", "exception", "failed", "failing", "failure", "regression", "traceback",
)
STRUCTURAL_WORDS = (
    "architecture", "blast", "callers", "dependency", "dependencies", "graph", "impact", "path", "structure",
)
TEST_WORDS = ("assert", "coverage", "pytest", "test", "tests")
CONTEXT_WORDS = (
    "architecture", "caller", "callers", "dependency", "dependencies", "flow", "impact", "integration", "path",
    "references", "routing", "test", "tests", "usage",
)


def words(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values))


def identifier_tokens(text: Column) -> Column:
    """Lower-case tokens of identifiers and prose: camel humps and acronyms split, short ones dropped."""
    spaced = F.regexp_replace(F.regexp_replace(text, CAMEL, "$1 $2"), ACRONYM, "$1 $2")
    parts = F.split(F.lower(F.regexp_replace(spaced, NON_ALNUM, " ")), " ")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def file_id(path: Column) -> Column:
    return F.concat_ws("::", F.lit("file"), path)


def symbol_id(path: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws("::", F.lit("symbol"), path, kind, name)


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def import_terminal(target: Column) -> Column:
    return F.substring_index(F.substring_index(target, ".", -1), "/", -1)


def task_identifiers(text: Column) -> Column:
    """Distinct identifiers of more than two characters, case folded and sorted."""
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, F.lower), lambda x: F.length(x) > 2)))


def token_estimate(text: Column) -> Column:
    """Tokens at three characters each, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 3)).cast("bigint")


def json_strings(value: Column) -> Column:
    """The distinct strings of a JSON list in order; anything else is the empty list."""
    parsed = F.from_json(value, "array<string>")
    return F.coalesce(F.array_distinct(F.filter(parsed, lambda x: x.isNotNull())), F.array().cast("array<string>"))


def epoch_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def python_module(path: Column) -> Column:
    """Dotted module of a Python path; a package's own file is the package."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", ""), F.lit("/"), F.lit("."))


def script_module(path: Column) -> Column:
    """Dotted module of a JavaScript or TypeScript path: known extensions dropped, index files of a
    directory collapse to it."""
    plain = F.regexp_replace(path, r"\.(ts|tsx|js|jsx|mjs|cjs)$", "")
    index = F.regexp_extract(path, r"^(.*)/index\.(ts|tsx|js|jsx)$", 1)
    return F.replace(F.when(index != "", index).otherwise(plain), F.lit("/"), F.lit("."))


def resolve_dotted(name: Column, module: Column) -> Column:
    """What a dotted import means in a module: one dot is the module's package, each more one up."""
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    parts = F.split(module, r"\.")
    kept = F.greatest(F.size(parts) - dots, F.lit(0))
    rest = F.substr(name, dots + 1)
    base = F.array_join(F.slice(parts, F.lit(1), kept), ".")
    joined = F.when(base == "", rest).when(rest == "", base).otherwise(F.concat_ws(".", base, rest))
    return F.when(dots == 0, name).otherwise(joined)


def resolve_relative(name: Column, module: Column) -> Column:
    """What a `./x` or `../x` import means in a dotted script module; other names give null. A
    module like a.b.test comes from a file b.test, so its last two parts are the file's name."""
    parts = F.split(module, r"\.")
    own = F.when(F.element_at(parts, -1).isin("test", "spec"), 2).otherwise(1)
    walked = F.aggregate(
        F.split(name, "/"),
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - own, F.lit(0))),
        lambda at, part: F.when(part == ".", at)
        .when(part == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))))
        .otherwise(F.concat(at, F.array(part))),
    )
    return F.when(F.startswith(name, F.lit(".")), F.array_join(walked, "."))


def is_generated_path(path: Column) -> Column:
    """A directory of generated or vendored code, or the name of a generated file."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.substring_index(low, "/", -1)
    named = name.contains(".generated.") | name.rlike(r"(\.g\.py|\.g\.ts|\.min\.js)$")
    return F.arrays_overlap(F.split(low, "/"), words(*GENERATED_PARTS)) | named


def is_test_path(path: Column) -> Column:
    """Test directories, `__tests__` folders and test-like file stems."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    return (
        path.rlike("^(tests|test|__tests__)/") | path.contains("/__tests__/") | path.contains("/__test__/")
        | stem.rlike(r"(_test|\.test|\.spec)$") | stem.startswith("test_")
    )


def under_root(path: Column, *roots: str) -> Column:
    """Whether a path is one of these roots or lies under one."""
    out = F.lit(False)
    for root in roots:
        out = out | (path == root) | path.startswith(root + "/")
    return out


def infer_intent(tokens: Column) -> Column:
    """Debugging goes before editing, editing before reviewing; all else is understanding."""
    has = lambda *w: F.arrays_overlap(tokens, words(*w))
    return (
        F.when(has(*DEBUG_WORDS), "debug").when(has(*EDIT_WORDS), "edit").when(has("review", "merge"), "review")
    ).otherwise("understand")


def plan_mode(tokens: Column, intent: Column) -> Column:
    structural = F.arrays_overlap(tokens, words(*STRUCTURAL_WORDS))
    return F.when(intent.isin("edit", "debug", "review"), "impact").when(structural, "structural").otherwise("lexical")


def role_of(relation: Column, outgoing: Column) -> Column:
    """What the other end of an edge is to a target: decorators point the other way round."""
    towards = F.when(relation == "decorates", ~outgoing).otherwise(outgoing)
    return F.when(relation == "tested_by", "test").when(towards, "dependency").otherwise("caller")


def role_rank(role: Column, intent: str) -> Column:
    """Order of roles under an intent; the target always comes first."""
    #: Roles in their order.
    orders = {"debug": ("caller", "test", "dependency", "context"), "edit": ("dependency", "test", "caller", "context")}
    order = orders.get(intent, ("dependency", "caller", "test", "context"))
    out = F.when(role == "target", 0)
    for k, name in enumerate(order, 1):
        out = out.when(role == name, k)
    return out.otherwise(5)
