"""The parser as an operator: source files in, one nested record for each file out.

Files are independent, so the operator is a projection in Python workers; the records are exploded
into tables afterwards, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PARSED_FILES

#: Extensions and the language each stands for.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript",
    ".mjs": "typescript", ".cjs": "typescript",
}

_parsers: dict[str, Callable[[str, bool], dict]] = {}


def register(language: str, extensions: tuple[str, ...], parser: Callable[[str, bool], dict]) -> None:
    """Adds a language. The parser must be importable by workers; it maps (source, is a test file)
    to a record of symbols, imports and literals."""
    _parsers[language] = parser
    LANGUAGES.update(dict.fromkeys(extensions, language))


def _parser_of(language: str) -> Callable[[str, bool], dict]:
    from ..parse import python_source, script_source

    return {"python": python_source.parse, "typescript": script_source.parse, **_parsers}[language]


def language_of(path: str) -> str | None:
    return LANGUAGES.get("." + path.rpartition("/")[2].rpartition(".")[2])


def _is_test(path: str) -> bool:
    stem = path.rpartition("/")[2].rpartition(".")[0]
    return (
        path.startswith(("tests/", "test/", "__tests__/")) or "/__tests__/" in path or "/__test__/" in path
        or stem.startswith("test_") or stem.endswith(("_test", ".test", ".spec"))
    )


def parse_files(files: DataFrame, registered: dict | None = None) -> DataFrame:
    """files: (path, content binary). Files that are no UTF-8 or of no known language are left out;
    a file that cannot be parsed is there with status error and without symbols."""
    own = dict(_parsers if registered is None else registered)
    extensions = dict(LANGUAGES)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        _parsers.update(own)
        LANGUAGES.update(extensions)
        schema = _schema()
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                language = language_of(path or "")
                try:
                    text = (content or b"").decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if language is None:
                    continue
                found = _parser_of(language)(text, _is_test(path))
                rows.append({"path": path, "language": language, "sha256": hashlib.sha256(content or b"").hexdigest(), "size": len(content or b""), **found})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(F.col("path"), F.col("content")).mapInArrow(parse, PARSED_FILES)


def _schema() -> pa.Schema:
    s, i = pa.string(), pa.int32()
    ref = pa.struct([("kind", s), ("name", s), ("start_line", i), ("end_line", i), ("text", s)])
    symbol = pa.struct(
        [("kind", s), ("name", s), ("parent", s), ("signature", s), ("docstring", s), ("start_line", i), ("end_line", i),
         ("source", s), ("source_hash", s), ("is_test", pa.bool_()), ("refs", pa.list_(ref))]
    )
    binding = pa.struct([("local", s), ("imported", s), ("kind", s)])
    import_ = pa.struct([("name", s), ("source", s), ("start_line", i), ("end_line", i), ("bindings", pa.list_(binding))])
    literal = pa.struct([("name", s), ("relation", s), ("line", i)])
    return pa.schema(
        [("path", s), ("language", s), ("sha256", s), ("size", pa.int64()), ("status", s), ("error", s),
         ("symbols", pa.list_(symbol)), ("imports", pa.list_(import_)), ("literals", pa.list_(literal))]
    )


def parse_changed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """As parse_files, but a file whose path and content the cache (PARSED_FILES) has is taken from it."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    hit = cache.join(hashed.select("path", "sha256"), ["path", "sha256"], "left_semi")
    miss = hashed.join(cache.select("path", "sha256"), ["path", "sha256"], "left_anti")
    return hit.select(*cache.columns).unionByName(parse_files(miss.select("path", "content")))
