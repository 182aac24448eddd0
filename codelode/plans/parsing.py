"""Parsers, import graphs, chunks. SQL has no parser, so most of these have no SQL beside them."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from codelode.operators import chunks as ch
from codelode.operators import packages as pk
from codelode.parse import registry as rg

from .base import Data, query

#: Modules of the standard library, as the interpreter lists them.
STDLIB = sorted(m for m in sys.stdlib_module_names if not m.startswith("_"))


@query()
def par_entities(d: Data):
    return rg.entities(d.raw("code_files"), d.raw("file_contents"))


@query()
def par19_report(d: Data):
    return rg.report(d.raw("code_files"), d.raw("file_contents"))


@query()
def par_imports(d: Data):
    return rg.imports(d.raw("code_files"), d.raw("file_contents"))


@query()
def par_references_resolved(d: Data):
    m = d.modules.select(F.col("id").alias("module_id"), "file_id")
    sym = d.functions.select("name", "id", "module_id").join(m, "module_id").select("name", "id", "file_id")
    return rg.resolve(rg.references(d.raw("code_files"), d.raw("file_contents")), sym)


@query()
def par_python_udtf(d: Data):
    from codelode.parse.python import ParseEntities

    d.spark.udtf.register("parse_entities", ParseEntities)
    py = d.where("files", F.col("path").endswith(".py")).select(F.col("id").alias("file_id"))
    d.contents.join(py, "file_id", "left_semi").createOrReplaceTempView("py_contents")
    return d.spark.sql("SELECT c.file_id, e.kind, e.name, e.class_name, e.start_line, e.complexity FROM py_contents c, LATERAL parse_entities(c.content) e")


@query(
    f"""SELECT regexp_extract(s, '^(?:import|from) +([A-Za-z_][A-Za-z_0-9]*)', 1) AS top, count(*) AS n, list_contains({STDLIB!r}, regexp_extract(s, '^(?:import|from) +([A-Za-z_][A-Za-z_0-9]*)', 1)) AS is_stdlib
    FROM (SELECT unnest(string_split(c.content, chr(10))) AS s FROM contents c JOIN files f ON f.id = c.file_id WHERE f.path LIKE '%.py') WHERE regexp_matches(s, '^(import|from) +[A-Za-z_]') GROUP BY 1""",
    "contents files",
)
def agg10_import_frequency(d: Data):
    py = d.where("files", F.col("path").endswith(".py")).select(F.col("id").alias("file_id"))
    s = d.contents.join(py, "file_id", "left_semi").select(F.explode(F.split("content", "\n")).alias("s")).filter(F.col("s").rlike("^(import|from) +[A-Za-z_]"))
    return s.groupBy(F.regexp_extract("s", "^(?:import|from) +([A-Za-z_][A-Za-z_0-9]*)", 1).alias("top")).agg(F.count("*").alias("n")).withColumn("is_stdlib", F.col("top").isin(STDLIB))


@query()
def gr20_dependencies(d: Data):
    i = rg.imports(d.raw("code_files"), d.raw("file_contents"))
    f = d.files.select("id", "repository_id", "path")
    local = f.select("repository_id", F.replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), F.lit("/"), F.lit(".")).alias("module_name"), F.col("id").alias("imported_file_id")).groupBy("repository_id", "module_name").agg(F.min("imported_file_id").alias("imported_file_id"))
    j = i.join(f.select(F.col("id").alias("file_id"), "repository_id"), "file_id").join(local, ["repository_id", "module_name"], "left")
    kind = F.when(F.col("imported_file_id").isNotNull() | F.col("module_name").startswith("."), "local").when(F.regexp_extract("module_name", "^([^./]+)", 1).isin(STDLIB), "stdlib").otherwise("third_party")
    return j.select("file_id", "module_name", "imported_file_id", kind.alias("kind"))


@query()
def agg17_package_edges(d: Data):
    return pk.edges(rg.imports(d.raw("code_files"), d.raw("file_contents")).select("file_id", "module_name"), d.files, pk.discover(d.files))


@query()
def agg19_package_coupling(d: Data):
    p = pk.discover(d.files)
    return pk.coupling(pk.edges(rg.imports(d.raw("code_files"), d.raw("file_contents")).select("file_id", "module_name"), d.files, p), p)


@query(
    "SELECT file_id, t.k::INTEGER AS chunk, (1 + 15 * t.k)::INTEGER AS start_line, least(1 + 15 * t.k + 19, n)::INTEGER AS end_line, t.k > 0 AS has_overlap, array_to_string(lines[1 + 15 * t.k : 1 + 15 * t.k + 19], chr(10)) AS code FROM (SELECT file_id, string_split(content, chr(10)) AS lines, len(string_split(content, chr(10))) AS n FROM contents WHERE content IS NOT NULL) c, unnest(range(0, (c.n - 1) // 15 + 1)) AS t(k)",
    "contents",
)
def udtf2_line_chunks(d: Data):
    return ch.by_lines(d.contents, 20, 5)


@query(
    """WITH n AS (SELECT file_id, len(string_split(content, chr(10))) AS n FROM contents WHERE content IS NOT NULL), c AS (SELECT * FROM classes WHERE start_line IS NOT NULL AND end_line IS NOT NULL), f AS (SELECT * FROM functions WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
    r AS (SELECT 'function' AS kind, id, name, module_id, start_line, end_line FROM f WHERE class_id IS NULL UNION ALL SELECT 'class', id, name, module_id, start_line, end_line FROM c UNION ALL SELECT 'method', f.id, f.name, f.module_id, f.start_line, f.end_line FROM f JOIN c ON c.id = f.class_id AND c.end_line - c.start_line + 1 > 40)
    SELECT m.file_id, r.kind, r.id, r.name, greatest(r.start_line - 3, 1) AS start_line, least(r.end_line + 2, n.n)::INTEGER AS end_line FROM r JOIN modules m ON m.id = r.module_id JOIN n ON n.file_id = m.file_id""",
    "contents classes functions modules",
)
def udtf1_entity_chunks(d: Data):
    return ch.by_entity(d.functions, d.classes, d.modules, d.contents, 40)


@query()
def udtf3_prolog_chunks(d: Data):
    return ch.prolog(d.contents)


@query()
def udtf5_character_chunks(d: Data):
    return ch.by_characters(d.contents)


@query("SELECT id, coalesce(content_hash, '') <> '' AS hashed, sha256(coalesce(path, '')) AS path_hash FROM files", "files")
def str14_hashes(d: Data):
    return d.files.select("id", (F.coalesce("content_hash", F.lit("")) != "").alias("hashed"), F.sha2(F.coalesce("path", F.lit("")).cast("binary"), 256).alias("path_hash"))


@query("WITH o AS (SELECT path, max(content_hash) AS h FROM files WHERE branch = 'main' AND repository_id = 1 GROUP BY 1), n AS (SELECT path, max(content_hash) AS h FROM files WHERE branch <> 'main' AND repository_id = 1 GROUP BY 1) SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN n ON n.path = o.path WHERE o.path IS NULL OR n.path IS NULL OR o.h IS DISTINCT FROM n.h", "files")
def src9_branch_diff(d: Data):
    from codelode.operators.tables import snapshot_diff

    f = d.where("files", "repository_id = 1")
    one = lambda c: f.filter(c).groupBy("path").agg(F.max("content_hash").alias("content_hash"))
    return snapshot_diff(one("branch = 'main'"), one("branch <> 'main'"), ["path"], "content_hash")
