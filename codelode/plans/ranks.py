"""Ranking and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import lookup as lk
from codelode.operators import ranking as rk

from .base import Data, query

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.to_timestamp_ntz(F.lit(AS_OF))


@query("SELECT id, CASE WHEN last_modified IS NULL THEN 0.5 WHEN days < 7 THEN 1.0 WHEN days < 30 THEN 0.8 WHEN days < 90 THEN 0.6 WHEN days < 365 THEN 0.4 ELSE 0.2 END::DOUBLE AS recency FROM (SELECT id, last_modified, floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(last_modified))) / 86400) AS days FROM files)", "files")
def rnk1a_recency(d: Data):
    return d.files.select("id", rk.recency(F.col("last_modified").cast("timestamp"), as_of().cast("timestamp")).cast("double").alias("recency"))


@query("SELECT id, least(0.5::DOUBLE + CASE WHEN regexp_matches(lower(name), 'init|main|get|set|create|update|delete|process|handle') THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN docstring IS NOT NULL THEN 0.1::DOUBLE ELSE 0.0 END, 1.0::DOUBLE) AS popularity FROM functions", "functions")
def rnk1b_popularity(d: Data):
    return d.functions.select("id", rk.popularity(F.col("name"), F.col("docstring")).cast("double").alias("popularity"))


REL = """CASE WHEN lower(name) = 'load queue' THEN 1.0::DOUBLE WHEN contains(lower(name), 'load queue') THEN 0.8::DOUBLE
 ELSE least(len(list_intersect(['load', 'queue'], list_distinct(regexp_split_to_array(lower(name), '[_ ]')))) * 0.25::DOUBLE + len(list_intersect(['load', 'queue'], list_distinct(regexp_split_to_array(lower(coalesce(docstring, '')), '\\s+')))) * 0.15::DOUBLE, 1.0::DOUBLE) END"""


@query(f"SELECT id, round({REL}, 6) AS relevance FROM functions", "functions")
def rnk1c_relevance(d: Data):
    return d.functions.select("id", F.round(rk.relevance("load queue", F.col("name"), F.col("docstring")), 6).cast("double").alias("relevance"))


@query("SELECT f.id, least(0.5::DOUBLE + CASE WHEN l.repository_id = 1 THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN l.id = 5 THEN 0.3::DOUBLE ELSE 0.0 END + CASE WHEN len(list_intersect(string_split(lower(f.name), '_'), ['token', 'queue'])) > 0 THEN 0.1::DOUBLE ELSE 0.0 END, 1.0::DOUBLE) AS context FROM functions f LEFT JOIN modules m ON m.id = f.module_id LEFT JOIN files l ON l.id = m.file_id", "functions modules files")
def rnk1d_context(d: Data):
    m = d.modules.select(F.col("id").alias("module_id"), "file_id")
    f = d.files.select(F.col("id").alias("file_id"), "repository_id")
    j = d.functions.select("id", "name", "module_id").join(m, "module_id", "left").join(f, "file_id", "left")
    return j.select("id", rk.context(F.col("repository_id"), F.col("file_id"), F.col("name"), {"repository_id": 1, "file_id": 5, "recent": ["token_queue"]}).cast("double").alias("context"))


@query(
    f"""SELECT id, round(0.8 * 0.6::DOUBLE + {REL} * 0.2::DOUBLE + 0.5::DOUBLE * 0.1 + least(0.5::DOUBLE + CASE WHEN regexp_matches(lower(name), 'init|main|get|set|create|update|delete|process|handle') THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN docstring IS NOT NULL THEN 0.1::DOUBLE ELSE 0.0 END, 1.0) * 0.1::DOUBLE, 5) AS score
    FROM functions ORDER BY score DESC, id LIMIT 50""",
    "functions",
)
def rnk1_final_score(d: Data):
    s = rk.final(F.lit(0.8), rk.relevance("load queue", F.col("name"), F.col("docstring")), F.lit(0.5), rk.popularity(F.col("name"), F.col("docstring")))
    return d.functions.select("id", F.round(s, 5).alias("score")).orderBy(F.desc("score"), "id").limit(50)


def results(d: Data):
    """Files as search results: similarity from the size, complexity and documentation of their functions."""
    m = d.modules.select(F.col("id").alias("module_id"), "file_id")
    g = d.functions.select("module_id", "complexity", "docstring").join(m, "module_id").groupBy("file_id").agg(F.max("complexity").alias("complexity"), F.bool_or(F.col("docstring").isNotNull()).alias("has_docstring"))
    f = d.where("files", "size is not null").select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), (F.col("size") % 1000 / 1000.0).cast("double").alias("similarity"), F.col("size").alias("lines"), F.col("last_modified").cast("timestamp").alias("last_modified"))
    return f.join(g, "file_id").withColumn("imports", F.array(F.regexp_extract("file_path", r"^([^/]+)", 1)))


RES = """res AS (SELECT f.id AS file_id, f.path AS file_path, (f.size % 1000) / 1000.0::DOUBLE AS similarity, f.size AS lines, g.complexity, g.has_docstring FROM files f JOIN (SELECT m.file_id, max(complexity) AS complexity, bool_or(f.docstring IS NOT NULL) AS has_docstring FROM functions f JOIN modules m ON m.id = f.module_id GROUP BY 1) g ON g.file_id = f.id WHERE f.size IS NOT NULL)"""


@query(
    f"""WITH {RES}, r AS (SELECT * FROM res WHERE NOT starts_with(file_path, 'tests/') AND similarity >= 0.2), b AS (SELECT min(similarity) ls, max(similarity) hs, min(complexity) lc, max(complexity) hc FROM r)
    SELECT file_id, round(least(greatest((similarity - ls) / (hs - ls) * 0.6 + coalesce(1 - (complexity - lc)::DOUBLE / (hc - lc), 1.0) * 0.3 + CASE WHEN has_docstring THEN 0.1 ELSE 0.0 END, 0.0), 1.0), 5) AS score FROM r, b""",
    "files functions modules",
)
def rnk2_criteria(d: Data):
    c = rk.Criteria(similarity=0.6, complexity=0.3, docstring=0.1, prefer_simple=True, exclude_tests=True, min_similarity=0.2)
    return rk.rank(results(d), c).select("file_id", F.round("score", 5).alias("score"))


@query()
def rnk4_diversity(d: Data):
    r = rk.rank(results(d), rk.Criteria(similarity=1.0)).withColumn("query_id", F.lit(1).cast("long"))
    return rk.diversify(r, 0.3)


@query("SELECT a.id, CASE WHEN greatest(length(a.name), length(b.name)) = 0 THEN 1.0 ELSE round(len(list_filter(range(1, least(length(a.name), length(b.name)) + 1), lambda i: a.name[i] = b.name[i]))::DOUBLE / greatest(length(a.name), length(b.name)), 6) END AS similarity FROM functions a JOIN functions b ON b.id = a.id + 1", "functions")
def rnk5_char_similarity(d: Data):
    from codelode.functions.text import char_similarity

    a, b = d.functions.select("id", F.col("name").alias("x")), d.functions.select((F.col("id") - 1).alias("id"), F.col("name").alias("y"))
    return a.join(b, "id").select("id", F.round(char_similarity("x", "y"), 6).alias("similarity"))


@query("SELECT 'keyword' AS source, id, name FROM functions WHERE contains(lower(name), 'flush') OR contains(lower(coalesce(docstring, '')), 'flush') ORDER BY CASE WHEN contains(lower(name), 'flush') THEN 0 ELSE 1 END, name, id LIMIT 10", "functions")
def rnk6_search_with_fallback(d: Data):
    semantic = d.where("functions", F.lit(False)).select(F.lit("semantic").alias("source"), "id", "name")
    if semantic.limit(1).count():
        return semantic
    fn = d.functions.select(F.lit("function").alias("symbol_type"), "id", "name", "docstring")
    return lk.keyword_search(fn, "flush", 10).select(F.lit("keyword").alias("source"), "id", "name")


@query("WITH s AS (SELECT 'function' AS symbol_type, id, name FROM functions UNION ALL SELECT 'class', id, name FROM classes UNION ALL SELECT 'module', id, name FROM modules) SELECT symbol_type, id, name, CASE WHEN lower(name) = 'token' THEN 1.0 WHEN starts_with(lower(name), 'token') THEN 0.8 WHEN suffix(lower(name), 'token') THEN 0.6 ELSE 0.4 END::DOUBLE AS score FROM s WHERE contains(lower(name), 'token') ORDER BY score DESC, name, symbol_type, id LIMIT 20", "functions classes modules")
def top3_partial_name(d: Data):
    from .lookups import sym

    return lk.partial_name(sym(d), "token").select("symbol_type", "id", "name", F.col("score").cast("double").alias("score"))


@query("SELECT id, size FROM files WHERE size IS NOT NULL ORDER BY size, id LIMIT 25", "files")
def top5_smallest_files(d: Data):
    return d.where("files", "size is not null").select("id", "size").orderBy("size", "id").limit(25)


@query("SELECT id, name, start_line FROM functions WHERE module_id = 3 ORDER BY start_line NULLS FIRST, name, id", "functions")
def top8_structure_order(d: Data):
    return d.where("functions", "module_id = 3").select("id", "name", "start_line").orderBy(F.asc_nulls_first("start_line"), "name", "id")
