"""Parsers by language, and the frames they make of a table of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import ship

from . import braces, python

EXTENSIONS = {".py": "python", ".js": "js", ".jsx": "js", ".ts": "ts", ".tsx": "ts", ".java": "java", ".php": "php"}
Parser = Callable[[str], list[dict]]
_ENTITIES: dict[str, Parser] = {}
_IMPORTS: dict[str, Parser] = {}


def register(language: str, entities: Parser, imports: Parser) -> None:
    """Adds or replaces a language."""
    _ENTITIES[language], _IMPORTS[language] = entities, imports


register("python", python.entities, python.imports)
for _l in ("js", "ts", "java", "php"):
    register(_l, lambda t, x=_l: braces.entities(t, x), lambda t, x=_l: braces.imports(t, x))


def supported() -> list[str]:
    return sorted(_ENTITIES)


def language(path: str) -> str | None:
    dot = path.rfind(".")
    return EXTENSIONS.get(path[dot:]) if dot >= 0 else None


def _sources(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, path, content) of the files some parser takes, each once; other texts are not shuffled."""
    ship(files.sparkSession)
    known = F.regexp_extract("path", r"(\.[^./]*)$", 1).isin(*EXTENSIONS)
    f = files.filter(known).select(F.col("id").alias("file_id"), "path").dropDuplicates(["file_id"])
    c = contents.filter(F.col("content").isNotNull()).select("file_id", "content")
    return f.join(c, "file_id").dropDuplicates(["file_id"])


def _parse(files: DataFrame, contents: DataFrame, parser: dict[str, Parser], cols: list[str], schema: str, instead: Callable[[str], list[dict]] = lambda text: []) -> DataFrame:
    """Rows of a parser for each file; of a file that breaks the parser those of ``instead``, while ``report`` has its error."""
    names = ["file_id", *cols]
    parser, kinds = dict(parser), dict(EXTENSIONS)  # as they are on the driver now, registered languages included

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for fid, path, text in zip(pdf.file_id, pdf.path, pdf.content):
                lang = kinds.get(path[path.rfind(".") :])
                if lang in parser:
                    try:
                        got = parser[lang](text)
                    except Exception:  # told by report(); a file must not fail the job
                        got = instead(text)
                    rows += [(fid, *[r.get(c) for c in cols]) for r in got]
            yield pd.DataFrame(rows, columns=names)

    return _sources(files, contents).mapInPandas(run, schema)


def _module(text: str) -> list[dict]:
    """What is left of a file that can't be parsed: the module."""
    return [{"kind": "module", "start_line": 1, "end_line": text.count("\n") + 1}]


def report(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, language, elements, errors): a row for each file that was read; one that breaks its parser has one element, the module, and its error."""
    parser, kinds = dict(_ENTITIES), dict(EXTENSIONS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for fid, path, text in zip(pdf.file_id, pdf.path, pdf.content):
                lang = kinds.get(path[path.rfind(".") :])
                if lang in parser:
                    errors = [e] if lang == "python" and (e := python.tree_of(text)[1]) else []
                    try:
                        n = len(parser[lang](text))
                    except Exception as e:
                        n, errors = 1, [*errors, f"{type(e).__name__}: {e}"]
                    rows.append((fid, lang, n, errors))
            yield pd.DataFrame(rows, columns=["file_id", "language", "elements", "errors"])

    return _sources(files, contents).mapInPandas(run, "file_id long, language string, elements int, errors array<string>")


def entities(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, kind, name, class_name, start_line, end_line, complexity) of all supported files."""
    return _parse(files, contents, _ENTITIES, ["kind", "name", "class_name", "start_line", "end_line", "complexity"], "file_id long, kind string, name string, class_name string, start_line int, end_line int, complexity int", _module)


OUTLINE = "file_id long, kind string, name string, class_name string, start_line int, end_line int, docstring string, decorators array<string>, bases array<string>, parameters array<struct<name: string, type: string, default: string>>, return_type string, is_async boolean, is_abstract boolean, complexity int"


def outlines(files: DataFrame, contents: DataFrame) -> DataFrame:
    """The rows of ``entities`` with documentation, annotations, bases, parameters and return types."""
    return _parse(files, contents, _ENTITIES, ["kind", "name", "class_name", "start_line", "end_line", "docstring", "decorators", "bases", "parameters", "return_type", "is_async", "is_abstract", "complexity"], OUTLINE, _module)


def imports(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, module_name, names, line)."""
    return _parse(files, contents, _IMPORTS, ["module_name", "names", "line"], "file_id long, module_name string, names array<string>, line int")


def references(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, source, target, type, line); a Python file's module is its dotted path."""
    by = {"python": lambda t: python.references(t)} | {x: (lambda t, x=x: braces.references(t, x)) for x in ("js", "ts", "java", "php")}
    return _parse(files, contents, by, ["source", "target", "type", "line"], "file_id long, source string, target string, type string, line int")


def resolve(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs with target_id: the symbol of the target's last segment, of the same file if there is one, else the smallest id.

    symbols: (name, id, file_id). Candidates are reduced to two minima per reference before anything is sorted.
    """
    r = refs.withColumn("last", F.element_at(F.split("target", r"[./\\]"), -1)).withColumn("n", F.monotonically_increasing_id())
    everywhere = symbols.groupBy(F.col("name").alias("last")).agg(F.min("id").alias("any_id"))
    here = symbols.groupBy(F.col("name").alias("last"), "file_id").agg(F.min("id").alias("same_id"))
    return r.join(everywhere, "last", "left").join(here, ["last", "file_id"], "left").withColumn("target_id", F.coalesce("same_id", "any_id")).drop("n", "last", "any_id", "same_id")
