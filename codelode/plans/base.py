"""What the query modules share: the registry and the tables by name, each row once."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession

from codelode.tables import once, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The same tables in SQL: rows delivered twice carry the same values.
VIEWS = {
    "repos": "(SELECT DISTINCT ON (id) * FROM repositories)",
    "files": "(SELECT DISTINCT ON (id) * FROM code_files)",
    "modules": "(SELECT DISTINCT ON (id) * FROM code_modules)",
    "classes": "(SELECT DISTINCT ON (id) * FROM code_classes)",
    "functions": "(SELECT DISTINCT ON (id) * FROM code_functions)",
    "embs": "(SELECT DISTINCT ON (id) * FROM code_embeddings)",
    "contents": "(SELECT DISTINCT ON (file_id) * FROM file_contents)",
}


class Data:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    repos = cached_property(lambda s: once(s.raw("repositories")))
    files = cached_property(lambda s: once(s.raw("code_files")))
    modules = cached_property(lambda s: once(s.raw("code_modules")))
    classes = cached_property(lambda s: once(s.raw("code_classes")))
    functions = cached_property(lambda s: once(s.raw("code_functions")))
    embs = cached_property(lambda s: once(s.raw("code_embeddings")))
    contents = cached_property(lambda s: once(s.raw("file_contents"), "file_id"))

    def where(self, name: str, condition: Column | str) -> DataFrame:
        """The rows of a table that meet a condition, each once. Repeats carry the same values, so the condition may come
        first: it reaches the scan, and only what meets it is shuffled."""
        raw = {"repos": "repositories", "contents": "file_contents", "embs": "code_embeddings"}.get(name, f"code_{name}")
        return once(self.raw(raw).filter(condition), "file_id" if name == "contents" else "id")

    def __getattr__(self, name: str) -> DataFrame:
        return self.raw(name)


def query(sql: str | None = None, uses: str = ""):
    """Registers a function of Data under its name. ``uses`` names the views of VIEWS that the SQL reads."""

    def register(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql is not None:
            ctes = ", ".join(f"{v} AS {VIEWS[v]}" for v in uses.split())
            body = sql.strip()
            if ctes and body[:5].upper() == "WITH ":
                rec = body[5:].lstrip().upper().startswith("RECURSIVE ")
                body = ("WITH RECURSIVE " if rec else "WITH ") + ctes + ", " + (body[5:].lstrip()[10:] if rec else body[5:])
            elif ctes:
                body = f"WITH {ctes} {body}"
            ORACLE[f.__name__] = body
        return f

    return register
