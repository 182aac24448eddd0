"""Source files that do not parse: a generalised LL recogniser per language decides each file.

The dialects of a language are start rules and token classes of one grammar: their scans fold into the same groups, so
what they share is parsed once. The first dialect of DIALECTS is the language's standard; where it rejects a file, the
others are asked too. A file is flagged if every dialect of its extension's language rejects it.

Defined results
* null content and extensions other than .py, .js, .ts, .java and .php: no row;
* an empty file is valid; rows delivered twice count once;
* a text that nests too deep for the recogniser counts as not parsed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import ship

from . import grammars as gr
from .gll import Grammar, Reject

#: extension -> its dialects, the standard first
DIALECTS = {
    "py": ("python 3", "python 2"),
    "js": ("module", "script", "jsx"),
    "ts": ("typescript", "tsx"),
    "java": ("java 17", "java 21"),
    "php": ("php 8", "php 7"),
}


class Recognisers:
    """The grammars and scanners of a worker, with what they have learnt about groups seen so far."""

    def __init__(self) -> None:
        self.ecma, self.java, self.php, self.python = Grammar(gr.ECMA), Grammar(gr.JAVA), Grammar(gr.PHP), Grammar(gr.PYTHON)
        self._scanners()

    def _scanners(self) -> None:
        ecma, java, php, python = gr.Ecma(self.ecma), gr.Java(self.java), gr.Php(self.php), gr.Python(self.python)
        self.dialects = {
            "python 3": (self.python, "File", python.scan),
            "python 2": (self.python, "File", lambda t: python.scan(t, True)),
            "module": (self.ecma, "JsModule", lambda t: ecma.scan(t, False)),
            "script": (self.ecma, "JsScript", lambda t: ecma.scan(t, False, sloppy=True)),
            "jsx": (self.ecma, "JsModule", lambda t: ecma.scan(t, False, jsx=True)),
            "typescript": (self.ecma, "TsModule", lambda t: ecma.scan(t, True)),
            "tsx": (self.ecma, "TsModule", lambda t: ecma.scan(t, True, jsx=True)),
            "java 17": (self.java, "Unit", java.scan),
            "java 21": (self.java, "Unit", lambda t: java.scan(t, True)),
            "php 8": (self.php, "File", php.scan),
            "php 7": (self.php, "File", lambda t: php.scan(t, True)),
        }

    def why_not(self, text: str, dialect: str) -> str | None:
        """None if the text is in the dialect's language, else where that failed."""
        grammar, start, scan = self.dialects[dialect]
        grammar.reset_if_full()
        try:
            ok = grammar.derives(grammar.rule(start), scan(text))
        except Reject as e:
            return str(e)
        except RecursionError:
            return "nested too deep"
        return None if ok else "no derivation"


@functools.cache
def recognisers() -> Recognisers:
    return Recognisers()


def verdict(text: str, extension: str) -> tuple[str | None, str | None]:
    """The first dialect that accepts the text, if any does; why the standard rejects it, if it does."""
    first: str | None = None
    for d in DIALECTS[extension]:
        why = recognisers().why_not(text, d)
        if why is None:
            return d, first
        first = first or f"{d}: {why}"
    return None, first


def broken(text: str, extension: str) -> str | None:
    """Why the standard of the extension's language rejects the text; None if it doesn't."""
    why = recognisers().why_not(text, DIALECTS[extension][0])
    return why and f"{DIALECTS[extension][0]}: {why}"


def flag(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, repository_id, language, invalid, dialect, why): a row per source file with content.

    ``dialect`` is the first that accepts the file, ``why`` says why the standard doesn't; ``invalid``: no dialect does.
    """
    ext = F.regexp_extract("path", r"\.(py|js|ts|java|php)$", 1)
    f = files.select(F.col("id").alias("file_id"), "repository_id", ext.alias("ext")).filter(F.col("ext") != "").dropDuplicates(["file_id"])
    c = contents.filter(F.col("content").isNotNull()).select("file_id", "content")
    src = c.join(f, "file_id")
    ship(files.sparkSession)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            got = [verdict(t, e) for t, e in zip(b.column(at["content"]).to_pylist(), b.column(at["ext"]).to_pylist())]
            dialect, why = pa.array([d for d, _ in got], pa.string()), pa.array([w for _, w in got], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(at["file_id"]), b.column(at["repository_id"]), b.column(at["ext"]), dialect.is_null(), dialect, why], ["file_id", "repository_id", "language", "invalid", "dialect", "why"])

    return src.mapInArrow(check, "file_id long, repository_id long, language string, invalid boolean, dialect string, why string").dropDuplicates(["file_id"])


def rates(flags: DataFrame) -> DataFrame:
    """(repository_id, language, files, invalid, rate)."""
    return flags.groupBy("repository_id", "language").agg(F.count("*").alias("files"), F.count_if("invalid").alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
