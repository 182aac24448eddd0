"""Scans, filters, projections and joins over the code model."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import lookup as lk

from .base import Data, query

SYM = "sym AS (SELECT 'function' AS symbol_type, id, name, docstring, module_id, start_line, end_line FROM functions UNION ALL SELECT 'class', id, name, docstring, module_id, start_line, end_line FROM classes UNION ALL SELECT 'module', id, name, docstring, id, start_line, end_line FROM modules)"


def sym(d: Data):
    """All symbols as delivered; what reads them drops repeats after its filters."""
    return lk.symbols(d.raw("code_functions"), d.raw("code_classes"), d.raw("code_modules"))


def once_each(symbols):
    return symbols.dropDuplicates(["symbol_type", "id"])


@query("SELECT id, github_url, owner, name, is_active FROM repos", "repos")
def src1_list_all(d: Data):
    return d.repos.select("id", "github_url", "owner", "name", "is_active")


@query("SELECT id, path, branch, size FROM files WHERE repository_id = 1 AND branch = 'main' AND path LIKE '%.py'", "files")
def src2_by_repository_branch(d: Data):
    return d.where("files", (F.col("repository_id") == 1) & (F.col("branch") == "main") & F.col("path").endswith(".py")).select("id", "path", "branch", "size")


@query("SELECT r.id, r.github_url FROM repos r WHERE r.github_url = (SELECT min(github_url) FROM repositories)", "repos")
def src2_by_url(d: Data):
    first = d.raw("repositories").agg(F.min("github_url").alias("github_url"))
    return d.repos.join(F.broadcast(first), "github_url", "left_semi").select("id", "github_url")


@query("SELECT id, name, module_id FROM functions WHERE id = 7", "functions")
def src3_entity_by_id(d: Data):
    return lk.entity("function", {"function": d.where("functions", F.col("id") == 7)}, 7).select("id", "name", "module_id")


@query(
    """SELECT f.id, array_to_string(string_split(c.content, chr(10))[greatest(f.start_line, 1) : least(f.end_line, len(string_split(c.content, chr(10))))], chr(10)) AS code
    FROM functions f JOIN modules m ON m.id = f.module_id JOIN contents c ON c.file_id = m.file_id WHERE c.content IS NOT NULL AND f.start_line IS NOT NULL AND f.end_line IS NOT NULL""",
    "functions modules contents",
)
def src15_function_code(d: Data):
    spans = d.where("functions", "start_line is not null and end_line is not null").select("id", "module_id", "start_line", "end_line").join(d.modules.select(F.col("id").alias("module_id"), "file_id"), "module_id")
    return lk.source_lines(d.contents, spans).select("id", "code")


@query(
    """SELECT f.id, array_to_string(string_split(c.content, chr(10))[greatest(f.start_line - 3, 1) : least(f.end_line + 3, len(string_split(c.content, chr(10))))], chr(10)) AS code
    FROM functions f JOIN modules m ON m.id = f.module_id JOIN contents c ON c.file_id = m.file_id WHERE c.content IS NOT NULL AND f.start_line IS NOT NULL AND f.end_line IS NOT NULL""",
    "functions modules contents",
)
def src16_chunk_with_context(d: Data):
    spans = d.where("functions", "start_line is not null and end_line is not null").select("id", "module_id", "start_line", "end_line").join(d.modules.select(F.col("id").alias("module_id"), "file_id"), "module_id")
    return lk.source_lines(d.contents, spans, 3).select("id", "code")


@query(
    """SELECT c.id, array_to_string(string_split(t.content, chr(10))[greatest(coalesce(c.start_line, 1), 1) : least(coalesce(c.end_line, len(string_split(t.content, chr(10)))), len(string_split(t.content, chr(10))))], chr(10)) AS raw,
    array_to_string(string_split(t.content, chr(10))[greatest(coalesce(c.start_line, 1) - 5, 1) : least(coalesce(c.end_line, len(string_split(t.content, chr(10)))) + 5, len(string_split(t.content, chr(10))))], chr(10)) AS contextual
    FROM classes c JOIN modules m ON m.id = c.module_id JOIN contents t ON t.file_id = m.file_id JOIN files f ON f.id = m.file_id WHERE t.content IS NOT NULL AND f.path LIKE '%.py'""",
    "classes modules contents files",
)
def src17_raw_and_contextual(d: Data):
    py = d.where("files", F.col("path").endswith(".py")).select(F.col("id").alias("file_id"))
    spans = d.classes.select("id", "module_id", "start_line", "end_line").join(d.modules.select(F.col("id").alias("module_id"), "file_id"), "module_id").join(py, "file_id", "left_semi")
    raw = lk.source_lines(d.contents, spans).withColumnRenamed("code", "raw")
    return lk.source_lines(d.contents, raw, 5).select("id", "raw", F.col("code").alias("contextual"))


@query("SELECT file_id, length(content) AS n FROM contents WHERE length(content) <= 1000", "contents")
def src18_size_capped(d: Data):
    return d.where("contents", F.length("content") <= 1000).select("file_id", F.length("content").cast("long").alias("n"))


@query("SELECT id, path FROM files WHERE NOT EXISTS (SELECT 1 FROM code_embeddings e WHERE e.file_id = files.id) ORDER BY id LIMIT 100", "files")
def src19_unindexed_files(d: Data):
    return d.files.join(d.raw("code_embeddings").select(F.col("file_id").alias("id")), "id", "left_anti").select("id", "path").orderBy("id").limit(100)


@query("SELECT m.file_id, 'class' AS kind, c.id, c.name FROM classes c JOIN modules m ON m.id = c.module_id UNION ALL SELECT m.file_id, 'function', f.id, f.name FROM functions f JOIN modules m ON m.id = f.module_id WHERE f.class_id IS NULL UNION ALL SELECT file_id, 'module', id, name FROM modules", "functions classes modules")
def src22_file_entities(d: Data):
    m = d.modules.select(F.col("id").alias("module_id"), "file_id")
    one = lambda df, kind: df.join(m, "module_id").select("file_id", F.lit(kind).alias("kind"), "id", "name")
    return one(d.classes, "class").unionByName(one(d.where("functions", "class_id is null"), "function")).unionByName(d.modules.select("file_id", F.lit("module").alias("kind"), "id", "name"))


@query(f"WITH {SYM} SELECT symbol_type, id, name, CASE WHEN contains(lower(name), 'load queue') THEN 0 ELSE 1 END AS rank_group FROM sym WHERE contains(lower(name), 'load') OR contains(lower(name), 'queue') OR contains(lower(coalesce(docstring, '')), 'load') OR contains(lower(coalesce(docstring, '')), 'queue') ORDER BY rank_group, name, symbol_type, id LIMIT 20", "functions classes modules")
def flt1_keyword_search(d: Data):
    return lk.keyword_search(sym(d), "load queue").select("symbol_type", "id", "name", "rank_group")


@query(f"WITH {SYM} SELECT symbol_type, id, name, CASE WHEN strpos(lower(name), 'token') > 0 THEN strpos(lower(name), 'token') ELSE 2147483647 END::INTEGER AS position, 0.8::DOUBLE AS similarity FROM sym WHERE contains(lower(name), 'token') OR contains(lower(coalesce(docstring, '')), 'token') ORDER BY position, name, symbol_type, id LIMIT 20", "functions classes modules")
def flt3_positional_search(d: Data):
    return lk.positional_search(sym(d), "token").select("symbol_type", "id", "name", "position", "similarity")


@query(f"WITH {SYM} SELECT symbol_type, id, module_id FROM sym WHERE name = 'run'", "functions classes modules")
def flt4_exact_name(d: Data):
    return once_each(sym(d).filter(F.col("name") == "run")).select("symbol_type", "id", "module_id")


@query("SELECT f.id, f.name, c.name AS class_name FROM functions f LEFT JOIN classes c ON c.id = f.class_id WHERE f.name LIKE 'parse%'", "functions classes")
def flt5_functions_with_class(d: Data):
    c = d.classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    return d.where("functions", F.col("name").startswith("parse")).select("id", "name", "class_id").join(c, "class_id", "left").select("id", "name", "class_name")


@query(f"WITH {SYM} SELECT id, name FROM sym WHERE symbol_type = 'class'", "functions classes modules")
def flt6_by_type(d: Data):
    return once_each(sym(d).filter(F.col("symbol_type") == "class")).select("id", "name")


@query(f"WITH {SYM} SELECT s.symbol_type, s.id, s.name FROM sym s JOIN modules m ON m.id = s.module_id WHERE m.file_id = 5", "functions classes modules")
def flt7_in_file(d: Data):
    of_file = d.where("modules", F.col("file_id") == 5).select(F.col("id").alias("module_id"))
    return once_each(sym(d).join(of_file, "module_id", "left_semi")).select("symbol_type", "id", "name")


@query("SELECT id FROM functions WHERE name = 'run' AND list_has_all(list_transform(parameters, lambda p: p.type), ['string'])", "functions")
def flt8_by_signature(d: Data):
    return lk.by_signature(d.where("functions", F.col("name") == "run"), "run", ["string"]).select("id")


@query("SELECT id, name FROM classes WHERE list_contains(base_classes, 'Token')", "classes")
def flt9_subclasses(d: Data):
    return lk.has_base(d.where("classes", F.array_contains("base_classes", "Token")), "Token").select("id", "name")


@query("SELECT 'function' AS kind, id, name FROM functions WHERE is_async UNION ALL SELECT 'class', id, name FROM classes WHERE is_abstract", "functions classes")
def flt10_async_and_abstract(d: Data):
    return d.where("functions", "is_async").select(F.lit("function").alias("kind"), "id", "name").unionByName(d.where("classes", "is_abstract").select(F.lit("class").alias("kind"), "id", "name"))


@query(f"WITH {SYM} SELECT symbol_type, id, name FROM sym WHERE regexp_matches(name, '^(load|save)_[a-z]+$')", "functions classes modules")
def flt11_regex(d: Data):
    return once_each(sym(d).filter(F.col("name").rlike("^(load|save)_[a-z]+$"))).select("symbol_type", "id", "name")


@query("SELECT id, path, last_modified FROM files WHERE repository_id = 1 AND last_modified > TIMESTAMP '2023-06-01'", "files")
def flt12_modified_since(d: Data):
    return d.where("files", (F.col("repository_id") == 1) & (F.col("last_modified") > F.to_timestamp_ntz(F.lit("2023-06-01 00:00:00")))).select("id", "path", "last_modified")


@query("SELECT id, embedding_type FROM embs WHERE entity_type = 'function' ORDER BY id LIMIT 100", "embs")
def flt13_embeddings_by_entity_type(d: Data):
    return d.where("embs", F.col("entity_type") == "function").select("id", "embedding_type").orderBy("id").limit(100)


@query("SELECT e.id FROM embs e WHERE e.entity_type IN ('function', 'class') AND (contains(lower(e.content), 'index') OR contains(lower(e.content), 'queue')) ORDER BY e.id LIMIT 20", "embs")
def flt14_relevant_entities(d: Data):
    return d.where("embs", F.col("entity_type").isin("function", "class") & (lk.contains("content", "index") | lk.contains("content", "queue"))).select("id").orderBy("id").limit(20)


@query("SELECT id, path FROM files WHERE suffix(path, '_queue.py') OR suffix(path, '/queue.py')", "files")
def flt15_path_suffix(d: Data):
    return d.where("files", F.col("path").endswith("_queue.py") | F.col("path").endswith("/queue.py")).select("id", "path")


@query("SELECT id, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module FROM files WHERE path LIKE 'src/%' AND path LIKE '%.py'", "files")
def flt16_submodules(d: Data):
    return d.where("files", F.col("path").endswith(".py")).select("id", F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit(".")).alias("module")).filter(F.col("module").startswith("src."))


@query("SELECT id, name FROM functions WHERE list_contains(decorators, 'staticmethod')", "functions")
def flt17_array_contains(d: Data):
    return d.where("functions", F.array_contains("decorators", "staticmethod")).select("id", "name")


@query("SELECT id, len(parameters)::INTEGER AS n FROM functions WHERE len(parameters) = 0 OR len(parameters) > 2", "functions")
def flt18_array_length(d: Data):
    return d.functions.select("id", F.size("parameters").alias("n")).filter("n = 0 or n > 2")


@query("SELECT id, name FROM functions WHERE class_id IS NULL", "functions")
def flt19_module_level(d: Data):
    return d.where("functions", "class_id is null").select("id", "name")


@query("SELECT id, path FROM files WHERE NOT starts_with(path, 'tests/') AND size >= 2000", "files")
def flt20_post_filters(d: Data):
    return d.where("files", ~F.col("path").startswith("tests/") & (F.col("size") >= 2000)).select("id", "path")


@query(
    """WITH named AS (SELECT 'function' AS entity_type, id AS entity_id, name, class_id FROM functions UNION ALL SELECT 'class', id, name, NULL FROM classes UNION ALL SELECT 'module', id, name, NULL FROM modules)
    SELECT e.id, e.entity_type, e.entity_id, e.embedding_type, coalesce(n.name, f.path) AS name, c.name AS class_name, f.path, concat_ws('/', r.owner, r.name) AS repository
    FROM embs e LEFT JOIN named n ON n.entity_type = e.entity_type AND n.entity_id = e.entity_id LEFT JOIN classes c ON c.id = n.class_id LEFT JOIN files f ON f.id = e.file_id LEFT JOIN repos r ON r.id = f.repository_id""",
    "embs functions classes modules files repos",
)
def prj1_hydrated_embeddings(d: Data):
    return lk.hydrate(d.embs, d.functions, d.classes, d.modules, d.files, d.repos)


@query("SELECT id, CASE WHEN docstring IS NULL THEN 'undocumented' ELSE 'documented' END AS match_type, concat(name, ':', coalesce(start_line::VARCHAR, '?')) AS location FROM functions", "functions")
def prj2_presentation(d: Data):
    return d.functions.select("id", F.when(F.col("docstring").isNull(), "undocumented").otherwise("documented").alias("match_type"), F.concat("name", F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("?"))).alias("location"))


@query("SELECT id, CASE WHEN list_contains(map_keys(repo_metadata), 'topic') THEN '***REDACTED***' END AS topic, repo_metadata['stars'] AS stars FROM repos", "repos")
def prj3_redaction(d: Data):
    m = lk.redact("repo_metadata", ("topic", "token"))
    return d.repos.select("id", F.try_element_at(m, F.lit("topic")).alias("topic"), F.try_element_at(m, F.lit("stars")).alias("stars"))


@query("SELECT id, name FROM functions ORDER BY name, id LIMIT 20 OFFSET 40", "functions")
def prj4_page(d: Data):
    return lk.page(d.functions.select("id", "name"), ["name", "id"], 3)


@query("SELECT count(*) AS total, 3 AS page, ceil(count(*) / 20.0)::BIGINT AS pages, 3 < ceil(count(*) / 20.0) AS has_next, true AS has_prev FROM functions", "functions")
def prj4_page_info(d: Data):
    return lk.page_info(d.functions, 3)


# --- joins ---
@query("SELECT f.id, f.name, m.name AS module, l.path FROM functions f JOIN modules m ON m.id = f.module_id JOIN files l ON l.id = m.file_id WHERE f.name = 'run'", "functions modules files")
def jn1_find_definitions(d: Data):
    m = d.modules.select(F.col("id").alias("module_id"), F.col("name").alias("module"), "file_id")
    return d.where("functions", F.col("name") == "run").select("id", "name", "module_id").join(m, "module_id").join(d.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "name", "module", "path")


@query("SELECT c.id, c.name, m.name AS module, f.path FROM classes c JOIN modules m ON m.id = c.module_id JOIN files f ON f.id = m.file_id", "classes modules files")
def jn2_class_details(d: Data):
    m = d.modules.select(F.col("id").alias("module_id"), F.col("name").alias("module"), "file_id")
    return d.classes.select("id", "name", "module_id").join(m, "module_id").join(d.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "name", "module", "path")


@query("SELECT e.id, f.path, r.name AS repository FROM embs e LEFT JOIN files f ON f.id = e.file_id LEFT JOIN repos r ON r.id = f.repository_id", "embs files repos")
def jn3_left_hydrate(d: Data):
    f = d.files.select(F.col("id").alias("file_id"), "path", "repository_id")
    r = d.repos.select(F.col("id").alias("repository_id"), F.col("name").alias("repository"))
    return d.embs.select("id", "file_id").join(f, "file_id", "left").join(r, "repository_id", "left").select("id", "path", "repository")


@query("SELECT id FROM embs WHERE file_id IN (SELECT id FROM code_files WHERE repository_id = 1)", "embs")
def jn4_embeddings_of_repository(d: Data):
    f = d.raw("code_files").filter(F.col("repository_id") == 1).select(F.col("id").alias("file_id"))
    return d.embs.join(f, "file_id", "left_semi").select("id")


@query(
    """SELECT s.s_nationkey AS source, c.c_nationkey AS target, count(*) AS relations FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
    WHERE s.s_nationkey <> c.c_nationkey GROUP BY ALL""",
)
def jn6_cross_context(d: Data):
    from .rules import relations

    return relations(d).filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("relations"))


@query("SELECT r.id, count(*) AS n FROM (SELECT id, unnest(decorators) AS decorator FROM functions) r WHERE decorator <> '' GROUP BY r.id", "functions")
def jn7_array_join(d: Data):
    return d.functions.select("id", F.explode("decorators").alias("decorator")).filter("decorator <> ''").groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT id, path FROM files WHERE id NOT IN (SELECT m.file_id FROM code_modules m JOIN code_classes c ON c.module_id = m.id WHERE m.file_id IS NOT NULL)", "files")
def jn10_files_without_classes(d: Data):
    return d.files.join(d.raw("code_modules").select(F.col("file_id"), F.col("id").alias("module_id")).join(d.raw("code_classes").select("module_id"), "module_id", "left_semi").select(F.col("file_id").alias("id")), "id", "left_anti").select("id", "path")


@query("SELECT id, name FROM modules WHERE id IN (SELECT module_id FROM code_classes WHERE is_abstract)", "modules")
def jn11_semi(d: Data):
    return d.modules.join(d.raw("code_classes").filter("is_abstract").select(F.col("module_id").alias("id")), "id", "left_semi").select("id", "name")


@query(
    """SELECT s.s_nationkey AS context, count(*) FILTER (WHERE c.c_nationkey = s.s_nationkey) AS internal, count(*) FILTER (WHERE c.c_nationkey <> s.s_nationkey) AS external_relations
    FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1""",
)
def jn12_internal_external(d: Data):
    from .rules import relations

    return relations(d).groupBy(F.col("source").alias("context")).agg(F.count_if(F.col("source") == F.col("target")).alias("internal"), F.count_if(F.col("source") != F.col("target")).alias("external_relations"))


@query(
    """WITH pk AS (SELECT DISTINCT repository_id, regexp_replace(path, '/[^/]*$', '') AS dir FROM code_files WHERE path LIKE '%/__init__.py'),
    up AS (SELECT f.id, f.repository_id, array_to_string(string_split(f.path, '/')[1 : n], '/') AS dir, n FROM files f, unnest(range(1, len(string_split(f.path, '/')))) AS t(n) WHERE f.path LIKE '%.py')
    SELECT u.id, max_by(u.dir, u.n) AS package FROM up u JOIN pk ON pk.repository_id = u.repository_id AND pk.dir = u.dir GROUP BY u.id""",
    "files",
)
def jn14_nearest_package(d: Data):
    from codelode.operators.packages import nearest_package, package_dirs

    return nearest_package(d.where("files", F.col("path").endswith(".py")), package_dirs(d.raw("code_files"))).select("id", "package")


# --- sinks, as what the tables hold after them ---
@query(
    """SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM (SELECT * FROM files WHERE branch = 'main') o
    FULL JOIN (SELECT * FROM files WHERE size > 1500) n ON n.repository_id = o.repository_id AND n.path = o.path AND n.branch = o.branch""",
    "files",
)
def snk2_upsert(d: Data):
    from codelode.operators.tables import upsert

    return upsert(d.where("files", "branch = 'main'"), d.where("files", "size > 1500"), ["repository_id", "path", "branch"]).select("id", "outcome")


@query("SELECT id FROM files WHERE id % 2 = 1 AND id NOT IN (SELECT id FROM code_files WHERE size > 1500)", "files")
def snk4_insert_if_absent(d: Data):
    from codelode.operators.tables import insert_if_absent

    return insert_if_absent(d.where("files", "size > 1500"), d.where("files", "id % 2 = 1"), ["id"]).select("id")


@query("SELECT f.id, coalesce(m.name, f.branch) AS branch FROM files f LEFT JOIN (SELECT file_id, min(name) AS name FROM code_modules GROUP BY 1) m ON m.file_id = f.id", "files")
def snk5_bulk_update(d: Data):
    from codelode.operators.tables import bulk_update

    new = d.raw("code_modules").groupBy(F.col("file_id").alias("id")).agg(F.min("name").alias("branch"))
    return bulk_update(d.files.select("id", "branch"), new, ["id"])


@query("SELECT f.id FROM functions f JOIN modules m ON m.id = f.module_id WHERE m.file_id NOT IN (SELECT id FROM code_files WHERE is_deleted)", "functions modules")
def snk6_cascade_delete(d: Data):
    from codelode.operators.tables import cascade_delete

    gone = d.raw("code_files").filter("is_deleted").select("id")
    return cascade_delete(gone, [(d.modules, "file_id"), (d.functions, "module_id")])[-1].join(d.modules.select(F.col("id").alias("module_id")), "module_id", "left_semi").select("id")


@query("SELECT id, size IS NULL OR size <= 1000 AS is_deleted FROM files", "files")
def snk7_soft_delete(d: Data):
    from codelode.operators.tables import soft_delete

    return soft_delete(d.files, d.where("files", "size > 1000").select("id"), ["id"]).select("id", "is_deleted")


@query("SELECT name, kind, list_sort(list_distinct(flatten(list(bases)))) AS bases FROM (SELECT name, is_abstract AS kind, base_classes AS bases FROM classes WHERE base_classes IS NOT NULL) GROUP BY ALL", "classes")
def snk10_merge_entities(d: Data):
    from codelode.operators.tables import merge_lists

    return merge_lists(d.classes.select("name", F.col("is_abstract").alias("kind"), F.col("base_classes").alias("bases")).filter("bases is not null"), ["name", "kind"], ["bases"])
