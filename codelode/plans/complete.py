"""Queries over element trees, references, cycles of any kind of vertex, summaries, validation and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelode.functions import text as tx
from codelode.operators import domain as dm
from codelode.operators import graph as gr
from codelode.operators import lookup as lk
from codelode.operators import tables as tb
from codelode.operators import temporal as tp
from codelode.operators import vectors as vx

from .base import Data, query
from .more import FROM, OK, from_imports, good
from .rules import PAIRS, relations


def cycle_sql(edges: str, longest: int) -> str:
    """CTEs that end in ``found`` (path, length): elementary cycles of up to ``longest`` edges, from their smallest vertex."""
    return f"""{edges}, p AS (SELECT s AS first, t AS last, [s, t] AS path FROM e WHERE s < t UNION ALL SELECT p.first, e.t, list_append(p.path, e.t) FROM p JOIN e ON e.s = p.last WHERE e.t > p.first AND NOT list_contains(p.path, e.t) AND len(p.path) < {longest}),
    found AS (SELECT p.path, len(p.path)::INTEGER AS length FROM p JOIN e ON e.s = p.last AND e.t = p.first)"""


MODEL = "mods AS (SELECT id, name, file_id, start_line, end_line FROM modules)"


@query(
    """SELECT concat('m', id) AS element_id, NULL AS parent_id, 'module' AS kind, name AS full_name, (end_line - coalesce(start_line, 1) + 1)::INTEGER AS line_count FROM modules
    UNION ALL SELECT concat('c', c.id), concat('m', m.id), 'class', concat(m.name, '.', c.name), (c.end_line - c.start_line + 1)::INTEGER FROM classes c JOIN modules m ON m.id = c.module_id
    UNION ALL SELECT concat('f', f.id), CASE WHEN c.id IS NULL THEN concat('m', m.id) ELSE concat('c', c.id) END, CASE WHEN c.id IS NULL THEN 'function' ELSE 'method' END, CASE WHEN c.id IS NULL THEN concat(m.name, '.', f.name) ELSE concat(m.name, '.', c.name, '.', f.name) END, (f.end_line - f.start_line + 1)::INTEGER FROM functions f JOIN modules m ON m.id = f.module_id LEFT JOIN classes c ON c.id = f.class_id""",
    "modules classes functions",
)
def par17_elements(d: Data):
    return lk.elements(d.modules, d.classes, d.functions).drop("module")


@query("SELECT m.name AS module, count(*) FILTER (WHERE f.class_id IS NULL) AS functions, count(*) FILTER (WHERE f.class_id IS NOT NULL) AS methods FROM functions f JOIN modules m ON m.id = f.module_id GROUP BY 1", "functions modules")
def par17_elements_by_type(d: Data):
    e = lk.elements(d.modules, d.classes, d.functions).filter("kind in ('function', 'method')")
    return e.groupBy(F.col("module")).agg(F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "method").alias("methods"))


# --- references -------------------------------------------------------------------------------------------------------
CALLS = """lines AS (SELECT file_id, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM contents WHERE content IS NOT NULL),
    words AS (SELECT DISTINCT file_id, line, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*) ?\\(', 1)) AS name FROM lines),
    defs AS (SELECT DISTINCT m.file_id, f.start_line AS line, f.name FROM functions f JOIN modules m ON m.id = f.module_id),
    refs AS (SELECT w.name, w.file_id, w.line FROM words w WHERE w.name IN (SELECT name FROM functions) AND NOT EXISTS (SELECT 1 FROM defs x WHERE x.file_id = w.file_id AND x.line = w.line AND x.name = w.name))"""


def call_references(d: Data):
    """(name, file_id, line) of every place a function's name stands before a parenthesis, but for its definitions."""
    defs = d.functions.select("module_id", "name", F.col("start_line").alias("line")).join(d.modules.select(F.col("id").alias("module_id"), "file_id"), "module_id").select("file_id", "line", "name")
    return lk.calls(d.contents, d.functions.select("name"), defs)


@query(f"WITH {CALLS} SELECT name, count(*) AS uses, count(DISTINCT file_id) AS files FROM refs GROUP BY 1", "contents functions modules")
def gr24_references(d: Data):
    return call_references(d).groupBy("name").agg(F.count("*").alias("uses"), F.count_distinct("file_id").alias("files"))


@query(f"WITH {CALLS} SELECT id FROM functions WHERE NOT starts_with(name, '_') AND name NOT IN (SELECT name FROM refs)", "contents functions modules")
def gr24_unreferenced(d: Data):
    return d.where("functions", ~F.col("name").startswith("_")).select("id", "name").join(call_references(d).select("name"), "name", "left_anti").select("id")


# --- cycles -----------------------------------------------------------------------------------------------------------
LOCAL = f"{FROM}, loc AS (SELECT repository_id, replace(regexp_replace(path, '(/__init__)?\\.py$', ''), '/', '.') AS module_name, min(id) AS id FROM files WHERE path LIKE '%.py' GROUP BY 1, 2), e AS (SELECT DISTINCT i.file_id AS s, l.id AS t FROM imp i JOIN loc l ON l.repository_id = i.repository_id AND l.module_name = i.module_name WHERE i.file_id <> l.id)"


def file_edges(d: Data):
    """(source, target) file ids: a Python file imports a module that another file of its repository is."""
    return gr.import_edges(from_imports(d), d.where("files", F.col("path").endswith(".py")))


@query(f"WITH {LOCAL} SELECT s AS source, t AS target FROM e", "contents files")
def gr13_local_imports(d: Data):
    return file_edges(d)


@query(f"WITH RECURSIVE {cycle_sql(LOCAL, 6)} SELECT list_transform(list_append(path, path[1]), lambda i: i) AS cycle, length FROM found", "contents files")
def gr13_file_cycles(d: Data):
    return gr.cycles(file_edges(d), 6).select(F.array_append("path", F.col("path")[0]).alias("cycle"), "length")


BASES = "e AS (SELECT DISTINCT c.id AS s, b.id AS t FROM (SELECT id, unnest(base_classes) AS base FROM classes) c JOIN (SELECT name, min(id) AS id FROM classes GROUP BY 1) b ON b.name = c.base WHERE c.id <> b.id)"


@query(f"WITH RECURSIVE {cycle_sql(BASES, 6)} SELECT list_transform(path, lambda i: i) AS cycle, length FROM found", "classes")
def gr11_reference_cycles(d: Data):
    c = d.classes.select(F.col("id").alias("source"), F.explode("base_classes").alias("name"))
    to = d.classes.groupBy("name").agg(F.min("id").alias("target"))
    return gr.cycles(c.join(to, "name").select("source", "target"), 6).select(F.col("path").alias("cycle"), "length")


STRONG12 = f"{PAIRS}, e AS (SELECT source AS s, target AS t FROM pair WHERE n > 1.2 * (SELECT avg(n) FROM pair))"


@query(f"WITH RECURSIVE {cycle_sql(STRONG12, 4)} SELECT path, length FROM found")
def gr10_entity_cycles(d: Data):
    from codelode.operators.rules import _with_mean, pair_counts

    return gr.cycles(_with_mean(pair_counts(relations(d))).filter("n > 1.2 * mean").select("source", "target"), 4)


@query(
    f"""WITH RECURSIVE {STRONG12}, r AS (SELECT s AS x, t AS y FROM e UNION SELECT r.x, e.t FROM r JOIN e ON e.s = r.y), o AS (SELECT x FROM r WHERE x = y)
    SELECT v.x AS id FROM (SELECT x FROM r UNION SELECT y FROM r) v WHERE (v.x IN (SELECT x FROM o) OR EXISTS (SELECT 1 FROM r WHERE r.y = v.x AND r.x IN (SELECT x FROM o))) AND (v.x IN (SELECT x FROM o) OR EXISTS (SELECT 1 FROM r WHERE r.x = v.x AND r.y IN (SELECT x FROM o)))"""
)
def gr14_cycle_core(d: Data):
    from codelode.operators.rules import _with_mean, pair_counts

    return gr.cycle_core(_with_mean(pair_counts(relations(d))).filter("n > 1.2 * mean").select("source", "target"))


# --- domain model -----------------------------------------------------------------------------------------------------
@query(
    """WITH n AS (SELECT class_id, count(*) AS methods FROM functions WHERE class_id IS NOT NULL GROUP BY 1), x AS (SELECT c.id, coalesce(n.methods, 0) AS methods, len(c.base_classes) AS bases, c.docstring FROM classes c LEFT JOIN n ON n.class_id = c.id),
    a AS (SELECT 'medium' AS severity FROM x WHERE methods = 0 UNION ALL SELECT 'high' FROM x WHERE methods > 7 UNION ALL SELECT 'medium' FROM x WHERE coalesce(bases, 0) = 0 AND methods > 0 AND docstring IS NULL)
    SELECT v.severity, count(a.severity) AS issues FROM (VALUES ('high'), ('medium'), ('low')) AS v(severity) LEFT JOIN a ON a.severity = v.severity GROUP BY 1""",
    "classes functions",
)
def agg28_severities(d: Data):
    from codelode.operators.rules import anti_patterns

    levels = d.spark.createDataFrame([("high",), ("medium",), ("low",)], "severity string")
    n = anti_patterns(d.classes, d.functions).groupBy("severity").agg(F.count("*").alias("issues"))
    return levels.join(n, "severity", "left").select("severity", F.coalesce("issues", F.lit(0)).alias("issues"))


@query("SELECT id, concat('Function ', name, ' implementation') AS business_summary, coalesce(nullif(docstring, ''), 'No description available') AS technical_summary FROM functions", "functions")
def agg25b_function_summaries(d: Data):
    return dm.function_summaries(d.functions)


@query(
    """WITH w AS (SELECT DISTINCT module_id, lower(unnest(string_split(name, '_'))) AS word FROM functions), c AS (SELECT module_id, list_sort(list(word))[1:10] AS domain_concepts FROM w WHERE length(word) > 3 GROUP BY 1)
    SELECT m.id, concat('Module ', m.name) AS business_summary, coalesce(nullif(m.docstring, ''), 'Module implementation') AS technical_summary, coalesce(c.domain_concepts, []) AS domain_concepts FROM modules m LEFT JOIN c ON c.module_id = m.id""",
    "functions modules",
)
def agg25b_module_summaries(d: Data):
    return dm.module_summaries(d.modules, d.functions)


@query(
    """SELECT 'function' AS kind, id, concat('Function ', name, ' that takes ', len(coalesce(parameters, [])), ' parameters') AS interpretation FROM functions
    UNION ALL SELECT 'class', c.id, concat('Class ', c.name, ' with ', count(f.id), ' methods') FROM classes c LEFT JOIN functions f ON f.class_id = c.id GROUP BY c.id, c.name
    UNION ALL SELECT 'module', m.id, concat('Module ', m.name, ' containing ', (SELECT count(*) FROM classes c WHERE c.module_id = m.id), ' classes and ', (SELECT count(*) FROM functions f WHERE f.module_id = m.id AND f.class_id IS NULL), ' functions') FROM modules m""",
    "functions classes modules",
)
def udtf7_interpretations(d: Data):
    return dm.interpretations(d.functions, d.classes, d.modules)


RAW_SQL = "raw AS (SELECT c.id, c.name, CASE WHEN c.is_abstract THEN 'aggregate_root' WHEN c.docstring IS NOT NULL THEN 'domain_entity' END AS type, c.docstring AS description, t.content AS source_code_sample FROM classes c LEFT JOIN modules m ON m.id = c.module_id LEFT JOIN contents t ON t.file_id = m.file_id)"


def extracted(d: Data):
    """What an extractor may hand over for the classes: some without a type, some without a description."""
    m, t = d.modules.select(F.col("id").alias("module_id"), "file_id"), d.contents.select("file_id", F.col("content").alias("source_code_sample"))
    kind = F.when(F.col("is_abstract"), "aggregate_root").when(F.col("docstring").isNotNull(), "domain_entity")
    return d.classes.select("id", "name", kind.alias("type"), F.col("docstring").alias("description"), "module_id").join(m, "module_id", "left").join(t, "file_id", "left").select("id", "name", "type", "description", "source_code_sample")


@query(f"WITH {RAW_SQL} SELECT id, name, type, coalesce(description, '') AS description, 1.0::DOUBLE AS confidence_score, substr(source_code_sample, 1, 500) AS source_code_sample FROM raw WHERE coalesce(name, '') <> '' AND coalesce(type, '') <> ''", "classes modules contents")
def udtf6_validated_entities(d: Data):
    return dm.validated_entities(extracted(d)).select("id", "name", "type", "description", "confidence_score", "source_code_sample")


@query("WITH r AS (SELECT c.name AS source, b.base AS target, CASE WHEN c.is_abstract THEN 'extends' END AS type FROM classes c, unnest(c.base_classes) AS b(base)) SELECT DISTINCT source, target, type, '' AS description, 1.0::DOUBLE AS strength FROM r WHERE source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL", "classes")
def udtf6_validated_relationships(d: Data):
    raw = d.classes.select(F.col("name").alias("source"), F.explode("base_classes").alias("target"), F.when(F.col("is_abstract"), "extends").alias("type"))
    return dm.validated_relationships(raw).select("source", "target", "type", "description", "strength").distinct()


@query(
    "WITH s AS (SELECT DISTINCT file_id, entity_id FROM embs WHERE entity_type = 'class' AND embedding_type = 'interpreted' AND file_id IS NOT NULL), x AS (SELECT m.file_id, c.id AS entity_id FROM classes c JOIN modules m ON m.id = c.module_id) SELECT file_id, entity_id, 'stored' AS origin FROM s UNION ALL SELECT file_id, entity_id, 'extracted' FROM x WHERE file_id NOT IN (SELECT file_id FROM s)",
    "embs classes modules",
)
def dom10_fetch_or_extract(d: Data):
    stored = d.where("embs", "entity_type = 'class' and embedding_type = 'interpreted' and file_id is not null").select("file_id", "entity_id").distinct()
    fresh = d.classes.select(F.col("id").alias("entity_id"), "module_id").join(d.modules.select(F.col("id").alias("module_id"), "file_id"), "module_id").select("file_id", "entity_id")
    return dm.fetch_or_extract(stored, fresh)


REL6 = f"{PAIRS}, t AS (SELECT least(source, target) AS a, greatest(source, target) AS b, sum(n)::BIGINT AS n, list_distinct(flatten(list(types))) AS types FROM pair GROUP BY 1, 2), k AS (SELECT a, b, n, CASE WHEN list_contains(types, 'R') THEN 'published_language' WHEN list_contains(types, 'A') THEN 'customer_supplier' WHEN n > 5 THEN 'shared_kernel' ELSE 'partnership' END AS kind FROM t)"


@query(
    f"""WITH {REL6} SELECT a, b, kind AS relationship_type, CASE kind WHEN 'shared_kernel' THEN concat('Shared kernel with ', n, ' shared domain concepts') WHEN 'customer_supplier' THEN 'Customer-supplier relationship where one context drives the other' WHEN 'published_language' THEN 'Published language for inter-context communication' WHEN 'partnership' THEN concat('Partnership with ', n, ' collaborative interactions') END AS description FROM k WHERE (a + b) % 3 <> 0"""
)
def snk12_context_relationships(d: Data):
    from codelode.operators.rules import pair_counts

    names = F.create_map(*[F.lit(x) for x in ("R", "publishes", "A", "orchestrates", "N", "uses")])
    t = pair_counts(relations(d)).groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"))
    found = t.select("a", "b", "n", gr.relationship_type(F.transform("types", lambda x: names[x]), F.col("n")).alias("relationship_type"))
    # the stored ones, a third of all pairs, are not written again
    stored = found.filter((F.col("a") + F.col("b")) % 3 == 0).select("a", "b", "relationship_type")
    return tb.insert_if_absent(stored, found, ["a", "b", "relationship_type"]).select("a", "b", "relationship_type", dm.relationship_description(F.col("relationship_type"), F.col("n")).alias("description"))


@query("WITH m AS (SELECT c_nationkey AS context, c_custkey AS entity, c_mktsegment AS kind, c_name AS name FROM customer), f AS (SELECT context, coalesce(arg_min(name, entity) FILTER (WHERE kind = 'BUILDING'), arg_min(name, entity)) AS first, count(*) AS n FROM m GROUP BY 1), t AS (SELECT context, name, row_number() OVER (PARTITION BY context ORDER BY entity) AS r FROM m) SELECT f.context, concat(f.first, ' Context') AS name, concat('Context containing ', f.n, ' related entities') AS description, (SELECT list(t.name ORDER BY t.r) FROM t WHERE t.context = f.context AND t.r <= 5) AS core_concepts FROM f")
def gr4_context_descriptions(d: Data):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "aggregate_root").otherwise("entity")
    return dm.context_descriptions(d.customer.select(F.col("c_nationkey").alias("context"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), kind.alias("kind")))


@query("WITH v AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0), r AS (SELECT o_custkey AS source, l_suppkey AS target, max(l_discount * 10) AS strength, max(1.0 - l_tax) AS confidence, l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey, l_orderkey * 10 + l_linenumber), k AS (SELECT r.* FROM r JOIN v x ON x.id = r.source JOIN v y ON y.id = r.target WHERE confidence >= 0.95 AND strength >= 0.5) SELECT least(source, target) AS a, greatest(source, target) AS b, round(arg_max(strength * confidence, id), 6) AS weight FROM k WHERE source <> target GROUP BY 1, 2")
def gr1_build(d: Data):
    v = d.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0).alias("confidence"))
    o = d.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    r = d.lineitem.select("l_orderkey", "l_suppkey", "l_discount", "l_tax", "l_linenumber").join(o, "l_orderkey")
    key = [F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")]
    r = r.groupBy(*key).agg(F.max(F.col("l_discount") * 10).alias("strength"), F.max(1.0 - F.col("l_tax")).alias("confidence"))
    return gr.build(v, r, 0.95, 0.5).select("a", "b", F.round("weight", 6).alias("weight"))


@query("WITH n AS (SELECT DISTINCT s_nationkey AS source, s_suppkey % 7 AS target, 'uses' AS type FROM supplier) SELECT source, target, type FROM n WHERE source NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def snk11_relationships(d: Data):
    new = d.supplier.select(F.col("s_nationkey").alias("source"), (F.col("s_suppkey") % 7).alias("target"), F.lit("uses").alias("type")).distinct()
    old = new.join(d.nation.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("source")), "source", "left_semi").select("source", "target", "type")
    return tb.insert_if_absent(old, new, ["source", "target", "type"]).select("source", "target", "type")


# --- vectors ----------------------------------------------------------------------------------------------------------
@query(
    f"""WITH g AS (SELECT * FROM embs WHERE {OK} AND entity_type IN ('function', 'class')), q AS (SELECT * FROM g WHERE id = (SELECT min(id) FROM g)), s AS (SELECT g.id, g.entity_type, g.entity_id, g.file_id, round(list_cosine_similarity(g.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM g CROSS JOIN q WHERE g.id <> q.id AND g.file_id <> q.file_id)
    SELECT s.id, s.entity_type, coalesce(f.name, c.name) AS name, s.similarity, l.path FROM (SELECT * FROM s WHERE similarity >= 0.2 ORDER BY similarity DESC, id LIMIT 10) s LEFT JOIN functions f ON s.entity_type = 'function' AND f.id = s.entity_id LEFT JOIN classes c ON s.entity_type = 'class' AND c.id = s.entity_id LEFT JOIN files l ON l.id = s.file_id""",
    "embs functions classes files",
)
def vec7_similar_entities(d: Data):
    g = good(d).filter("entity_type in ('function', 'class')")
    first = g.agg(F.min("id")).first()[0]
    got = vx.similar_to(g, first, 10, 0.2, lambda r: F.col("file_id") != r["file_id"], key="id") if first is not None else g.withColumn("similarity", F.lit(0.0)).limit(0)
    names = d.functions.select(F.lit("function").alias("entity_type"), F.col("id").alias("entity_id"), "name").unionByName(d.classes.select(F.lit("class").alias("entity_type"), F.col("id").alias("entity_id"), "name"))
    return got.join(names, ["entity_type", "entity_id"], "left").join(d.files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").select("id", "entity_type", "name", "similarity", "path")


@query("WITH e AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), p AS (SELECT a, b, CASE WHEN s >= 0.8 THEN 'duplicate' ELSE 'similar' END AS pattern_type, s AS confidence FROM e WHERE s >= 0.3) SELECT a, b, confidence FROM p WHERE pattern_type = 'similar' AND confidence >= 0.35")
def vec9_patterns(d: Data):
    p = vx.pairs_above(d.embeddings, 0.3).select("a", "b", F.when(F.col("similarity") >= 0.8, "duplicate").otherwise("similar").alias("pattern_type"), F.col("similarity").alias("confidence"))
    return vx.similar_patterns(p, "similar", 0.35).select("a", "b", "confidence")


@query("WITH e AS (SELECT round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) SELECT count(*) AS pairs, round(avg(s), 4) AS mean, max(s) AS highest FROM e WHERE s >= 0.3")
def vec9_metrics(d: Data):
    return vx.similarity_metrics(vx.pairs_above(d.embeddings, 0.3))


@query("SELECT DISTINCT sha256(docstring) AS digest FROM functions WHERE docstring IS NOT NULL AND docstring NOT IN (SELECT docstring FROM classes WHERE docstring IS NOT NULL)", "functions classes")
def vec17_cache_misses(d: Data):
    cache = d.where("classes", "docstring is not null").select(F.sha2(F.col("docstring").cast("binary"), 256).alias("digest"))
    return vx.embed_missing(d.where("functions", "docstring is not null").select(F.col("docstring").alias("text")), cache).select("digest")


# --- scalars, times, tools --------------------------------------------------------------------------------------------
@query("SELECT id, lower(name) LIKE '%load%' AS has, name LIKE 'load%' AS begins, name LIKE '%queue' AS ends, contains(name, '_') AS underscore FROM functions", "functions")
def str1_matching(d: Data):
    return d.functions.select("id", lk.contains("name", "load").alias("has"), F.col("name").startswith("load").alias("begins"), F.col("name").endswith("queue").alias("ends"), lk.contains("name", "_").alias("underscore"))


@query("SELECT id, trim(path) <> '' AND len(string_split(path, '..')) - 1 <= 3 AS valid FROM (SELECT id, CASE id % 4 WHEN 0 THEN path WHEN 1 THEN '  ' WHEN 2 THEN concat('../../../../', path) ELSE concat('../', path) END AS path FROM files)", "files")
def str8_valid_paths(d: Data):
    p = F.when(F.col("id") % 4 == 0, F.col("path")).when(F.col("id") % 4 == 1, F.lit("  ")).when(F.col("id") % 4 == 2, F.concat(F.lit("../../../../"), "path")).otherwise(F.concat(F.lit("../"), "path"))
    return d.files.select("id", tx.valid_path(p).alias("valid"))


@query("SELECT id, 'error' AS status, concat('File not found: ', path) AS error, 'deleted' AS code FROM files WHERE is_deleted", "files")
def prj5_error_envelopes(d: Data):
    e = tx.error_response(F.concat(F.lit("File not found: "), "path"), F.lit("deleted"))
    return d.where("files", "is_deleted").select("id", e.alias("e")).select("id", "e.status", "e.error", "e.code")


@query("WITH p AS (SELECT id, string_split(regexp_replace(path, '(/__init__)?\\.py$', ''), '/') AS parts, 1 + id % 3 AS dots FROM files WHERE path LIKE '%.py') SELECT id, concat_ws('.', nullif(array_to_string(parts[1 : greatest(len(parts) - dots, 0)], '.'), ''), 'util') AS module FROM p", "files")
def str15_relative_modules(d: Data):
    py = d.where("files", F.col("path").endswith(".py"))
    return py.select("id", tx.relative_module("path", (F.col("id") % 3 + 1).cast("int"), F.lit("util")).alias("module"))


@query("SELECT id, strftime(last_synced, '%Y-%m-%dT%H:%M:%S.%f') AS iso, last_synced - INTERVAL 2 HOUR AS utc FROM repos WHERE last_synced IS NOT NULL", "repos")
def dt3_iso(d: Data):
    r = d.where("repos", "last_synced is not null").select("id", tx.iso(F.col("last_synced")).alias("iso"))
    return r.select("id", "iso", tx.parse_iso(F.concat("iso", F.lit("+02:00"))).alias("utc"))


@query("SELECT 'codelode' AS name, '0.2.0' AS version, 'Apache Spark' AS engine")
def ver1_server_info(d: Data):
    from codelode import info

    return d.spark.createDataFrame([info()], "name string, version string, engine string")


@query("SELECT o.o_orderkey, (SELECT max(e.ts) FROM events e WHERE e.user_id = o.o_custkey AND e.ts <= o.o_orderdate) AS last_event FROM orders o")
def jn18_as_of(d: Data):
    return tp.as_of(d.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at")), d.events.select("user_id", F.col("ts").alias("at"), F.col("ts").alias("last_event")), ["user_id"], "at", ["last_event"]).select("o_orderkey", "last_event")


@query("WITH s AS (SELECT s_suppkey AS id, s_acctbal AS lo, s_acctbal + 50 AS hi FROM supplier) SELECT s.id, count(c.c_custkey) AS customers FROM s JOIN customer c ON c.c_acctbal >= s.lo AND c.c_acctbal < s.hi GROUP BY 1")
def jn18_range(d: Data):
    s = d.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 50).alias("hi"))
    return tp.range_join(d.customer.select(F.col("c_acctbal").alias("x")), s, "x", "lo", "hi", 50.0).groupBy("id").agg(F.count("*").alias("customers"))


@query("SELECT r.id, count(DISTINCT f.path) AS changed_files FROM repos r LEFT JOIN files f ON f.repository_id = r.id AND f.last_modified >= r.last_synced GROUP BY 1", "repos files")
def stm2c_changed_since_sync(d: Data):
    f = d.files.select(F.col("repository_id").alias("id"), "path", "last_modified")
    hit = f.join(d.repos.select("id", "last_synced"), "id").filter("last_modified >= last_synced").groupBy("id").agg(F.count_distinct("path").alias("changed_files"))
    return d.repos.select("id").join(hit, "id", "left").fillna(0, ["changed_files"])


@query("WITH s AS (SELECT 'function' AS symbol_type, id, name, docstring FROM functions UNION ALL SELECT 'class', id, name, docstring FROM classes UNION ALL SELECT 'module', id, name, docstring FROM modules) SELECT symbol_type, id, name, contains(lower(name), 'index') OR contains(lower(name), 'shard') AS in_name FROM s WHERE contains(lower(name), 'index') OR contains(lower(name), 'shard') OR contains(lower(coalesce(docstring, '')), 'index') OR contains(lower(coalesce(docstring, '')), 'shard')", "functions classes modules")
def flt2_keyword_list(d: Data):
    sym = lk.symbols(d.functions, d.classes, d.modules)
    return lk.any_keyword(sym, ["index", "shard"]).select("symbol_type", "id", "name", "in_name")


@query("SELECT f.id AS file_id, c.name AS class_name, n.name AS function_name FROM files f JOIN modules m ON m.file_id = f.id JOIN functions n ON n.module_id = m.id LEFT JOIN classes c ON c.id = n.class_id WHERE f.repository_id = 1", "files modules functions classes")
def agg15b_file_structure(d: Data):
    f = d.where("files", "repository_id = 1").select(F.col("id").alias("file_id"))
    m = d.modules.select(F.col("id").alias("module_id"), "file_id").join(f, "file_id", "left_semi")
    c = d.classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    return d.functions.select("module_id", "class_id", F.col("name").alias("function_name")).join(m, "module_id").join(c, "class_id", "left").select("file_id", "class_name", "function_name")
