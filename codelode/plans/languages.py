"""The parsers against the tables of indexed symbols: each indexed symbol of a language as its parser reads it from the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.parse import registry as rg

from .base import Data, query


def sources(d: Data, ending: str) -> DataFrame:
    return d.raw("code_files").filter(F.col("path").endswith(ending))


def functions_as_read(d: Data, ending: str, returns: bool) -> DataFrame:
    """(id, end_line, class_name, parameters, is_async[, return_type]) of the indexed functions that the parser finds, by what it reads."""
    read = rg.outlines(sources(d, ending), d.raw("file_contents")).filter("kind in ('function', 'method')")
    read = read.select("file_id", "name", "start_line", "end_line", "class_name", F.transform("parameters", lambda p: p["name"]).alias("parameters"), "is_async", "return_type")
    known = d.where("functions", "start_line is not null").select("id", "name", "start_line", "module_id").join(d.modules.select(F.col("id").alias("module_id"), "file_id"), "module_id")
    got = known.join(read, ["file_id", "name", "start_line"]).select("id", "end_line", "class_name", "parameters", "is_async", "return_type")
    return got if returns else got.drop("return_type")


def functions_sql(ending: str, returns: bool) -> str:
    return f"SELECT f.id, f.end_line, k.name AS class_name, list_transform(coalesce(f.parameters, []), lambda p: p.name) AS parameters, f.is_async{', f.return_type' if returns else ''} FROM functions f JOIN modules m ON m.id = f.module_id JOIN files p ON p.id = m.file_id JOIN contents c ON c.file_id = p.id LEFT JOIN classes k ON k.id = f.class_id WHERE suffix(p.path, '{ending}') AND c.content IS NOT NULL AND f.start_line IS NOT NULL"


VIEWS = "functions modules files contents classes"


@query(functions_sql(".php", True), VIEWS)
def par8_php_functions(d: Data):
    return functions_as_read(d, ".php", True)


@query(functions_sql(".java", True), VIEWS)
def par10_java_functions(d: Data):
    return functions_as_read(d, ".java", True)


@query(functions_sql(".ts", False), VIEWS)
def par12_typescript_functions(d: Data):
    return functions_as_read(d, ".ts", False)


@query(functions_sql(".js", False), VIEWS)
def par14_javascript_functions(d: Data):
    return functions_as_read(d, ".js", False)


@query("SELECT k.id, k.end_line, list_sort(coalesce(k.base_classes, [])) AS bases FROM classes k JOIN modules m ON m.id = k.module_id JOIN files p ON p.id = m.file_id JOIN contents c ON c.file_id = p.id WHERE regexp_matches(p.path, '\\.(php|java|ts|js)$') AND c.content IS NOT NULL AND k.start_line IS NOT NULL", "classes modules files contents")
def par16_classes(d: Data):
    files = d.raw("code_files").filter(F.col("path").rlike(r"\.(php|java|ts|js)$"))
    read = rg.outlines(files, d.raw("file_contents")).filter("kind in ('class', 'interface', 'enum', 'trait', 'record')").select("file_id", "name", "start_line", "end_line", F.array_sort(F.coalesce("bases", F.array().cast("array<string>"))).alias("bases"))
    known = d.where("classes", "start_line is not null").select("id", "name", "start_line", "module_id").join(d.modules.select(F.col("id").alias("module_id"), "file_id"), "module_id")
    return known.join(read, ["file_id", "name", "start_line"]).select("id", "end_line", "bases")


@query("SELECT DISTINCT c.file_id, regexp_extract(s, '^import (?:static )?([A-Za-z_][A-Za-z0-9_.]*(?:\\.\\*)?);', 1) AS module_name FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS s FROM contents WHERE content IS NOT NULL) c JOIN files f ON f.id = c.file_id WHERE suffix(f.path, '.java') AND regexp_matches(s, '^import (static )?[A-Za-z_][A-Za-z0-9_.]*(\\.\\*)?;')", "contents files")
def par10_java_imports(d: Data):
    return rg.imports(sources(d, ".java"), d.raw("file_contents")).select("file_id", "module_name").distinct()
