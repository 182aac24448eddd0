"""Domain-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import domain as dm

from .base import Data, query
from .rules import PAIRS, relations


@query("SELECT id, list_transform(list_filter(regexp_split_to_array(replace(name, '_', ' '), ' +'), lambda w: length(w) > 3), lambda w: concat(upper(w[1]), lower(w[2:]))) AS concepts FROM functions WHERE regexp_full_match(name, '[a-z_]+')", "functions")
def vec12_concepts(d: Data):
    return d.where("functions", F.col("name").rlike("^[a-z_]+$")).select("id", dm.concepts(F.replace("name", F.lit("_"), F.lit(" "))).alias("concepts"))


@query("SELECT name, is_abstract AS kind, list_sort(list_distinct(flatten(list(base_classes)))) AS base_classes, max(end_line) AS end_line FROM classes WHERE base_classes IS NOT NULL GROUP BY ALL", "classes")
def agg26_merge_entities(d: Data):
    return dm.merge_entities(d.where("classes", "base_classes is not null").withColumn("kind", F.col("is_abstract")), ["name", "kind"], ["base_classes"], numbers=["end_line"])


@query(
    """WITH m AS (SELECT c_nationkey AS cluster, c_custkey AS id, concat(lower(c_mktsegment), '_', c_custkey % 3) AS name FROM customer), w AS (SELECT cluster, lower(unnest(string_split(name, '_'))) AS word FROM m), n AS (SELECT cluster, word, count(*) AS n FROM w GROUP BY ALL)
    SELECT cluster, concat(upper(word[1]), word[2:], ' Context') AS name FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word) AS r FROM n) WHERE r = 1"""
)
def gr8_cluster_names(d: Data):
    m = d.customer.select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("id"), F.concat(F.lower("c_mktsegment"), F.lit("_"), (F.col("c_custkey") % 3).cast("string")).alias("name"), F.lit("entity").alias("kind"))
    return dm.cluster_names(m)


@query(
    """WITH RECURSIVE m AS (SELECT s_suppkey AS id, s_nationkey % 5 AS context FROM supplier), e AS (SELECT id AS x, id + 10 AS y FROM m UNION SELECT id + 10, id FROM m), u AS (SELECT x, y FROM e JOIN m a ON a.id = e.x JOIN m b ON b.id = e.y WHERE a.context = b.context),
    r AS (SELECT id, id AS reach FROM m UNION SELECT r.id, u.y FROM r JOIN u ON u.x = r.reach), c AS (SELECT id, min(reach) AS component FROM r GROUP BY id), p AS (SELECT m.context, c.component, count(*) AS size FROM c JOIN m ON m.id = c.id GROUP BY ALL)
    SELECT context, component, size FROM p WHERE context IN (SELECT context FROM m GROUP BY 1 HAVING count(*) >= 5) AND context IN (SELECT context FROM p GROUP BY 1 HAVING count(*) > 1)"""
)
def gr9_context_splits(d: Data):
    m = d.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("context"))
    e = m.select(F.col("id").alias("source"), (F.col("id") + 10).alias("target"))
    return dm.context_splits(m, e, m.select("context", F.lit(0.1).alias("cohesion")).distinct(), 5)


@query(
    """WITH l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM contents WHERE contains(content, 'report_failure')), d AS (SELECT m.file_id, f.start_line AS line FROM functions f JOIN modules m ON m.id = f.module_id WHERE f.name = 'report_failure')
    SELECT file_id, line::INTEGER AS line, text FROM l WHERE regexp_matches(text, '(^|\\W)report_failure(\\W|$)') AND NOT EXISTS (SELECT 1 FROM d WHERE d.file_id = l.file_id AND d.line = l.line)""",
    "contents functions modules",
)
def gr23_usages(d: Data):
    defs = d.where("functions", "name = 'report_failure'").select("module_id", F.col("start_line").alias("line")).join(d.modules.select(F.col("id").alias("module_id"), "file_id"), "module_id").select("file_id", "line")
    return dm.usages(d.contents, "report_failure", defs)


@query("WITH x AS (SELECT id, name, CASE WHEN regexp_extract(name, '^(.*?)(\\d+)$', 1) <> '' THEN regexp_extract(name, '^(.*?)(\\d+)$', 1) ELSE name END AS stem FROM (SELECT c_custkey AS id, concat(c_mktsegment, c_custkey % 7) AS name FROM customer)) SELECT id, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN stem ELSE name END AS base FROM x")
def dom9_numbered_names(d: Data):
    c = d.customer.select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", (F.col("c_custkey") % 7).cast("string")).alias("name"))
    return dm.numbered_names(c).select("id", "base")


@query("SELECT id, array_to_string(list_filter(list_transform(string_split(regexp_replace(docstring, '^\\s*/\\*+|\\*+/\\s*$', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '^\\s*\\*+\\s?', ''))), lambda x: x <> '' AND NOT starts_with(x, '@')), ' ') AS prose FROM functions WHERE starts_with(docstring, '/**') AND NOT contains(docstring, chr(9)) AND NOT contains(docstring, chr(13))", "functions")
def str10_docblock(d: Data):
    return d.where("functions", F.col("docstring").startswith("/**") & ~F.contains("docstring", F.lit("\t")) & ~F.contains("docstring", F.lit("\r"))).select("id", dm.docblock("docstring").alias("prose"))


@query("SELECT id, concat_ws(chr(10), concat('Function: ', name), CASE WHEN len(parameters) > 0 THEN concat('Parameters: ', array_to_string(list_transform(parameters, lambda p: p.name), ', ')) END, CASE WHEN return_type IS NOT NULL THEN concat('Returns: ', return_type) END, CASE WHEN docstring IS NOT NULL THEN concat('Description: ', substr(docstring, 1, 200)) END) AS text FROM functions", "functions")
def str12_function_text(d: Data):
    return dm.function_text(d.functions)


@query(
    """WITH p AS (SELECT class_id, list(name ORDER BY start_line NULLS FIRST, id, name) AS ms FROM functions WHERE class_id IS NOT NULL AND NOT starts_with(name, '_') GROUP BY 1)
    SELECT c.id, concat_ws(chr(10), concat('Class: ', c.name), CASE WHEN len(base_classes) > 0 THEN concat('Bases: ', array_to_string(base_classes, ', ')) END, CASE WHEN ms IS NOT NULL THEN concat('Methods: ', array_to_string(ms[1:3], ', '), CASE WHEN len(ms) > 3 THEN concat(' ... and ', len(ms) - 3, ' more') ELSE '' END) END) AS text FROM classes c LEFT JOIN p ON p.class_id = c.id""",
    "classes functions",
)
def str12_class_text(d: Data):
    return dm.class_text(d.classes, d.functions, 3)


@query(
    """WITH n AS (SELECT class_id, count(*) AS methods FROM functions WHERE class_id IS NOT NULL GROUP BY 1), x AS (SELECT c.id, c.is_abstract, m.file_id, coalesce(n.methods, 0) AS methods FROM classes c JOIN modules m ON m.id = c.module_id LEFT JOIN n ON n.class_id = c.id)
    SELECT file_id, 'anemic' AS suggestion, id FROM x WHERE methods = 0 UNION ALL SELECT file_id, 'value_object', id FROM x WHERE methods = 1 UNION ALL SELECT file_id, 'bloated', id FROM x WHERE methods > 5 UNION ALL SELECT file_id, 'missing_aggregate', min(id) FROM x GROUP BY 1 HAVING NOT bool_or(is_abstract)""",
    "classes functions modules",
)
def dom8_suggestions(d: Data):
    return dm.suggestions(d.classes, d.functions, d.modules)


@query(f"WITH {PAIRS} SELECT 'imports' AS direction, source AS id, target AS other, n FROM pair UNION ALL SELECT 'imported_by', target, source, n FROM pair")
def jn5_both_directions(d: Data):
    from codelode.operators.rules import pair_counts

    e = pair_counts(relations(d)).select("source", "target", "n")
    return e.select(F.lit("imports").alias("direction"), F.col("source").alias("id"), F.col("target").alias("other"), "n").unionByName(e.select(F.lit("imported_by").alias("direction"), F.col("target").alias("id"), F.col("source").alias("other"), "n"))


@query("SELECT CASE WHEN content IS NULL THEN 'failed' WHEN content = '' THEN 'skipped' ELSE 'success' END AS status, count(*) AS files, coalesce(sum(length(content)), 0)::BIGINT AS characters FROM contents GROUP BY 1", "contents")
def agg27_processing_summary(d: Data):
    status = F.when(F.col("content").isNull(), "failed").when(F.col("content") == "", "skipped").otherwise("success")
    return d.contents.groupBy(status.alias("status")).agg(F.count("*").alias("files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("characters"))


@query("SELECT f.id, f.name, coalesce(c.name, '') AS class_name, m.name AS module, l.path, (SELECT count(*) FROM functions s WHERE s.module_id = f.module_id) AS siblings FROM functions f LEFT JOIN classes c ON c.id = f.class_id JOIN modules m ON m.id = f.module_id JOIN files l ON l.id = m.file_id", "functions classes modules files")
def dom16_entity_context(d: Data):
    c = d.classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    m = d.modules.select(F.col("id").alias("module_id"), F.col("name").alias("module"), "file_id")
    n = d.functions.groupBy("module_id").agg(F.count("*").alias("siblings"))
    l = d.files.select(F.col("id").alias("file_id"), "path")  # noqa: E741
    return d.functions.select("id", "name", "class_id", "module_id").join(c, "class_id", "left").join(m, "module_id").join(l, "file_id").join(n, "module_id").select("id", "name", F.coalesce("class_name", F.lit("")).alias("class_name"), "module", "path", "siblings")


@query(
    """WITH src AS (SELECT DISTINCT m.file_id FROM classes c JOIN modules m ON m.id = c.module_id WHERE contains(lower(c.name), 'token')), q AS (SELECT embedding FROM embs WHERE id = (SELECT min(id) FROM code_embeddings WHERE len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: isnan(x)), true) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0)),
    e AS (SELECT e.id, e.file_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embs e, q WHERE len(e.embedding) = 64 AND NOT list_contains(list_transform(e.embedding, lambda x: isnan(x)), true) AND list_sum(list_transform(e.embedding, lambda x: abs(x))) > 0)
    SELECT id, round(sim * CASE WHEN file_id IN (SELECT file_id FROM src) THEN 1.2 ELSE 1.0 END, 6) AS score FROM e ORDER BY score DESC, id LIMIT 20""",
    "classes modules embs",
)
def vec11_domain_search(d: Data):
    from codelode.operators.vectors import cosine

    src = d.where("classes", F.contains(F.lower("name"), F.lit("token"))).select("module_id").join(d.modules.select(F.col("id").alias("module_id"), "file_id"), "module_id").select("file_id").distinct().withColumn("near", F.lit(True))
    ok = d.where("embs", (F.size("embedding") == 64) & ~F.exists("embedding", lambda x: F.isnan(x)) & F.exists("embedding", lambda x: x != 0)).select("id", "file_id", "embedding")
    e = ok.withColumn("q", ok.agg(F.min_by("embedding", "id")).scalar()).withColumn("sim", cosine("embedding", "q"))
    return e.join(src, "file_id", "left").select("id", F.round(F.col("sim") * F.when(F.col("near"), 1.2).otherwise(1.0), 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)
