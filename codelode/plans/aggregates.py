"""Aggregations, hierarchies and what became windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions.text import extension
from codelode.operators import packages as pk

from .base import Data, query

EXT = "regexp_extract(path, '(\\.[^./]+)$', 1)"


@query("SELECT f.repository_id, count(*) FILTER (WHERE entity_type = 'function') AS function, count(*) FILTER (WHERE entity_type = 'class') AS class, count(*) FILTER (WHERE entity_type = 'module') AS module, count(*) FILTER (WHERE entity_type = 'file') AS file, count(DISTINCT e.file_id) AS files FROM embs e JOIN files f ON f.id = e.file_id GROUP BY 1", "embs files")
def agg1_embedding_stats(d: Data):
    e = d.embs.select("file_id", "entity_type").join(d.files.select(F.col("id").alias("file_id"), "repository_id"), "file_id")
    kinds = [F.count_if(F.col("entity_type") == k).alias(k) for k in ("function", "class", "module", "file")]
    return e.groupBy("repository_id").agg(*kinds, F.count_distinct("file_id").alias("files"))


@query("SELECT f.repository_id, f.language, count(*) AS files FROM files f WHERE NOT is_deleted AND language IS NOT NULL GROUP BY ALL", "files")
def agg2_language_histogram(d: Data):
    return d.where("files", "not is_deleted and language is not null").groupBy("repository_id", "language").agg(F.count("*").alias("files"))


@query("WITH g AS (SELECT repository_id, language, count(*) AS files FROM files WHERE language IS NOT NULL GROUP BY repository_id, language) SELECT repository_id, language, files, round(100.0::DOUBLE * files / sum(files) OVER (PARTITION BY repository_id), 2) AS percent FROM g", "files")
def agg3_language_percent(d: Data):
    g = d.where("files", "language is not null").groupBy("repository_id", "language").agg(F.count("*").alias("files"))
    return g.withColumn("percent", F.round(100.0 * F.col("files") / F.sum("files").over(Window.partitionBy("repository_id")), 2))


@query("SELECT id, path, size FROM files WHERE size IS NOT NULL ORDER BY size DESC, id LIMIT 10", "files")
def agg3_largest_files(d: Data):
    return d.where("files", "size is not null").select("id", "path", "size").orderBy(F.desc("size"), "id").limit(10)


@query("SELECT r.id, r.name, count(f.id) AS files, max(f.last_modified) AS last_change FROM repos r LEFT JOIN files f ON f.repository_id = r.id AND NOT f.is_deleted GROUP BY ALL", "repos files")
def agg4_repository_listing(d: Data):
    f = d.where("files", "not is_deleted").groupBy(F.col("repository_id").alias("id")).agg(F.count("*").alias("files"), F.max("last_modified").alias("last_change"))
    return d.repos.select("id", "name").join(f, "id", "left").withColumn("files", F.coalesce("files", F.lit(0)))


@query("SELECT count(*) FILTER (WHERE c BETWEEN 1 AND 2) AS low, count(*) FILTER (WHERE c BETWEEN 3 AND 4) AS medium, count(*) FILTER (WHERE c BETWEEN 5 AND 10) AS high, count(*) FILTER (WHERE c BETWEEN 4 AND 6) AS range_3 FROM (SELECT complexity AS c FROM functions)", "functions")
def agg5_complexity_ranges(d: Data):
    ranges = {"low": (1, 2), "medium": (3, 4), "high": (5, 10), "range_3": (4, 6)}
    return d.functions.agg(*[F.count_if(F.col("complexity").between(*r)).alias(n) for n, r in ranges.items()])


@query(f"SELECT {EXT} AS extension, count(*) AS files, sum(size)::BIGINT AS size, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS percent FROM files GROUP BY 1", "files")
def agg6_file_types(d: Data):
    g = d.files.groupBy(extension("path").alias("extension")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))
    return g.withColumn("percent", F.round(100.0 * F.col("files") / g.agg(F.sum("files")).scalar(), 2))


@query("SELECT module_id, count(*) AS function_count, list_sort(list(name)) AS functions FROM functions WHERE name IS NOT NULL GROUP BY 1", "functions")
def agg7_functions_by_module(d: Data):
    return d.where("functions", "name is not null").groupBy("module_id").agg(F.count("*").alias("function_count"), F.array_sort(F.collect_list("name")).alias("functions"))


@query(
    """WITH f AS (SELECT m.file_id, count(*) AS fns FROM functions f JOIN modules m ON m.id = f.module_id GROUP BY 1), c AS (SELECT m.file_id, count(*) AS cls FROM classes c JOIN modules m ON m.id = c.module_id GROUP BY 1)
    SELECT coalesce(f.file_id, c.file_id) AS file_id, coalesce(fns, 0) AS fns, coalesce(cls, 0) AS cls, CASE WHEN coalesce(cls, 0) = 0 THEN 0.0::DOUBLE ELSE round(coalesce(fns, 0)::DOUBLE / cls, 4) END AS per_class FROM f FULL JOIN c ON c.file_id = f.file_id""",
    "functions classes modules",
)
def agg8_functions_per_class(d: Data):
    m = d.modules.select(F.col("id").alias("module_id"), "file_id")
    f = d.functions.join(m, "module_id").groupBy("file_id").agg(F.count("*").alias("fns"))
    c = d.classes.join(m, "module_id").groupBy("file_id").agg(F.count("*").alias("cls"))
    g = f.join(c, "file_id", "full").select("file_id", F.coalesce("fns", F.lit(0)).alias("fns"), F.coalesce("cls", F.lit(0)).alias("cls"))
    return g.withColumn("per_class", F.when(F.col("cls") == 0, 0.0).otherwise(F.round(F.col("fns") / F.col("cls"), 4)))


@query("SELECT user_id, count(*) AS commits, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE -value END), 2) AS net FROM events GROUP BY 1 ORDER BY commits DESC, user_id LIMIT 20")
def agg9_author_contributions(d: Data):
    net = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-F.col("value"))
    return d.events.groupBy("user_id").agg(F.count("*").alias("commits"), F.round(F.sum(net), 2).alias("net")).orderBy(F.desc("commits"), "user_id").limit(20)


@query(
    """SELECT m.id AS module_id, m.file_id, (SELECT list_sort(list({'start_line': c.start_line, 'id': c.id, 'name': c.name})) FROM classes c WHERE c.module_id = m.id) IS NOT NULL AS has_classes,
    (SELECT count(*) FROM classes c WHERE c.module_id = m.id) AS classes, (SELECT count(*) FROM functions f WHERE f.module_id = m.id AND f.class_id IS NOT NULL) AS methods, (SELECT count(*) FROM functions f WHERE f.module_id = m.id AND f.class_id IS NULL) AS functions FROM modules m""",
    "modules classes functions",
)
def agg11_file_hierarchy(d: Data):
    h = file_hierarchy(d)
    return h.select("module_id", "file_id", (F.size("classes") > 0).alias("has_classes"), F.size("classes").cast("long").alias("classes"), F.aggregate("classes", F.lit(0), lambda n, c: n + F.size(c["methods"])).cast("long").alias("methods"), F.size("functions").cast("long").alias("functions"))


def file_hierarchy(d: Data):
    """module -> classes -> methods and functions, nested and ordered by line."""
    none = F.array().cast("array<struct<start_line:int,id:bigint,name:string,complexity:int>>")
    fn = d.functions.select("module_id", "class_id", F.struct("start_line", "id", "name", "complexity").alias("f"))
    methods = fn.filter("class_id is not null").groupBy("class_id").agg(F.array_sort(F.collect_list("f")).alias("methods"))
    loose = fn.filter("class_id is null").groupBy("module_id").agg(F.array_sort(F.collect_list("f")).alias("functions"))
    cls = d.classes.select(F.col("id").alias("class_id"), "module_id", "start_line", "name").join(methods, "class_id", "left").withColumn("methods", F.coalesce("methods", none))
    nested = cls.groupBy("module_id").agg(F.array_sort(F.collect_list(F.struct("start_line", F.col("class_id").alias("id"), "name", "methods"))).alias("classes"))
    m = d.modules.select(F.col("id").alias("module_id"), "file_id", F.col("name").alias("module")).join(nested, "module_id", "left").join(loose, "module_id", "left")
    return m.withColumn("functions", F.coalesce("functions", none)).withColumn("classes", F.coalesce("classes", F.array().cast(nested.schema["classes"].dataType)))


@query("SELECT m.file_id, max(f.end_line) AS total_lines, count(*) FILTER (WHERE f.class_id IS NOT NULL) AS methods, count(*) FILTER (WHERE f.class_id IS NULL) AS functions, sum(coalesce(f.complexity, 1))::BIGINT AS complexity, round(avg(coalesce(f.complexity, 1)), 2) AS avg_complexity FROM functions f JOIN modules m ON m.id = f.module_id GROUP BY 1", "functions modules")
def agg13_file_metrics(d: Data):
    m = d.modules.select(F.col("id").alias("module_id"), "file_id")
    c = F.coalesce("complexity", F.lit(1))
    return d.functions.join(m, "module_id").groupBy("file_id").agg(F.max(d.functions["end_line"]).alias("total_lines"), F.count_if(F.col("class_id").isNotNull()).alias("methods"), F.count_if(F.col("class_id").isNull()).alias("functions"), F.sum(c).alias("complexity"), F.round(F.avg(c), 2).alias("avg_complexity"))


@query("SELECT m.file_id, round(avg(f.complexity), 3) AS avg_c, max(f.complexity) AS max_c, count(*) FILTER (WHERE f.complexity > 20) AS very, list_sort(list(f.name) FILTER (WHERE f.complexity <= 5)) AS simple FROM functions f JOIN modules m ON m.id = f.module_id WHERE f.complexity IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE f.complexity <= 5) > 0", "functions modules")
def agg14_complexity_profile(d: Data):
    m = d.modules.select(F.col("id").alias("module_id"), "file_id")
    g = d.where("functions", "complexity is not null").join(m, "module_id").groupBy("file_id")
    return g.agg(F.round(F.avg("complexity"), 3).alias("avg_c"), F.max("complexity").alias("max_c"), F.count_if(F.col("complexity") > 20).alias("very"), F.array_sort(F.collect_list(F.when(F.col("complexity") <= 5, F.col("name")))).alias("simple")).filter(F.size("simple") > 0)


@query(
    """WITH b(bucket) AS (VALUES ('simple'), ('moderate'), ('complex'), ('very complex')), n AS (SELECT CASE WHEN complexity <= 10 THEN 'simple' WHEN complexity <= 20 THEN 'moderate' WHEN complexity <= 50 THEN 'complex' ELSE 'very complex' END AS bucket, count(*) AS n FROM functions WHERE complexity IS NOT NULL GROUP BY 1)
    SELECT b.bucket, coalesce(n.n, 0) AS functions FROM b LEFT JOIN n ON n.bucket = b.bucket""",
    "functions",
)
def agg15_complexity_distribution(d: Data):
    from codelode.functions.text import complexity_level

    buckets = d.spark.createDataFrame([("simple",), ("moderate",), ("complex",), ("very complex",)], "bucket string")
    n = d.where("functions", "complexity is not null").groupBy(complexity_level("complexity").alias("bucket")).agg(F.count("*").alias("functions"))
    return buckets.join(n, "bucket", "left").withColumn("functions", F.coalesce("functions", F.lit(0)))


DIRS = "py AS (SELECT DISTINCT repository_id, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, regexp_extract(path, '([^/]*)$', 1) AS base FROM code_files WHERE path LIKE '%.py'), pkg AS (SELECT repository_id, dir AS path, CASE WHEN dir = '' THEN 'root' ELSE regexp_extract(dir, '([^/]*)$', 1) END AS name, bool_or(base = '__init__.py') AS has_init, NOT bool_or(base = '__init__.py') AS is_namespace, count(*) FILTER (WHERE base <> '__init__.py') AS module_count FROM py GROUP BY repository_id, dir)"


@query(f"WITH {DIRS} SELECT * FROM pkg")
def gr16_packages(d: Data):
    return pk.discover(d.files)


@query(f"WITH {DIRS} SELECT p.repository_id, p.path, q.path AS parent FROM pkg p LEFT JOIN pkg q ON q.repository_id = p.repository_id AND p.path <> '' AND q.path = CASE WHEN p.path LIKE '%/%' THEN regexp_replace(p.path, '/[^/]*$', '') ELSE '' END")
def gr17_package_hierarchy(d: Data):
    return pk.hierarchy(pk.discover(d.files)).select("repository_id", "path", "parent")


@query(f"WITH {DIRS} SELECT p.repository_id, p.path, p.module_count, count(q.path) AS subpackage_count FROM pkg p LEFT JOIN pkg q ON q.repository_id = p.repository_id AND q.path <> '' AND p.path = CASE WHEN q.path LIKE '%/%' THEN regexp_replace(q.path, '/[^/]*$', '') ELSE '' END GROUP BY ALL")
def agg16_package_contents(d: Data):
    h = pk.hierarchy(pk.discover(d.files))
    subs = h.filter("parent is not null").groupBy("repository_id", F.col("parent").alias("path")).agg(F.count("*").alias("subpackage_count"))
    return h.select("repository_id", "path", "module_count").join(subs, ["repository_id", "path"], "left").withColumn("subpackage_count", F.coalesce("subpackage_count", F.lit(0)))


@query(
    f"""WITH {DIRS}, fn AS (SELECT m.file_id, count(*) AS fns, sum(coalesce(f.complexity, 1)) AS sum_c, max(coalesce(f.complexity, 1)) AS max_c, count(*) FILTER (WHERE f.class_id IS NULL AND NOT starts_with(f.name, '_')) AS pf FROM functions f JOIN modules m ON m.id = f.module_id GROUP BY 1),
    cl AS (SELECT m.file_id, count(*) AS cls, count(*) FILTER (WHERE NOT starts_with(c.name, '_')) AS pc FROM classes c JOIN modules m ON m.id = c.module_id GROUP BY 1),
    fl AS (SELECT f.id, f.repository_id, f.path, f.size, fns, sum_c, max_c, pf, cls, pc FROM files f LEFT JOIN fn ON fn.file_id = f.id LEFT JOIN cl ON cl.file_id = f.id WHERE f.path LIKE '%.py')
    SELECT p.repository_id, p.path, coalesce(sum(size), 0)::BIGINT AS total_size, coalesce(sum(fns), 0)::BIGINT AS total_functions, coalesce(sum(cls), 0)::BIGINT AS total_classes, coalesce(sum(sum_c), 0)::BIGINT AS total_complexity, coalesce(max(max_c), 0) AS max_complexity,
    CASE WHEN coalesce(sum(fns), 0) > 0 THEN floor(sum(sum_c)::DOUBLE / sum(fns)) ELSE 0 END::BIGINT AS avg_complexity, bool_or(contains(fl.path, 'test')) AS has_tests, coalesce(sum(pc), 0)::BIGINT AS public_classes, coalesce(sum(pf), 0)::BIGINT AS public_functions
    FROM pkg p JOIN fl ON fl.repository_id = p.repository_id AND (p.path = '' OR starts_with(fl.path, p.path || '/')) GROUP BY p.repository_id, p.path""",
    "files functions classes modules",
)
def agg18_package_metrics(d: Data):
    return pk.rollup(d.files, d.functions, d.classes, d.modules, pk.discover(d.files))


@query("SELECT m.id, (SELECT count(*) FROM classes c WHERE c.module_id = m.id) AS classes, (SELECT count(*) FROM functions f WHERE f.module_id = m.id AND f.class_id IS NULL) AS functions FROM modules m", "modules classes functions")
def agg21_module_stats(d: Data):
    c = d.classes.groupBy(F.col("module_id").alias("id")).agg(F.count("*").alias("classes"))
    f = d.functions.groupBy(F.col("module_id").alias("id")).agg(F.count_if(F.col("class_id").isNull()).alias("functions"))
    return d.modules.select("id").join(c, "id", "left").join(f, "id", "left").select("id", F.coalesce("classes", F.lit(0)).alias("classes"), F.coalesce("functions", F.lit(0)).alias("functions"))


@query("SELECT module_id, name, count(*) AS overloads, list_sort(list(id)) AS ids FROM functions GROUP BY ALL HAVING count(*) > 1", "functions")
def agg24_overloads(d: Data):
    return d.functions.groupBy("module_id", "name").agg(F.count("*").alias("overloads"), F.array_sort(F.collect_list("id")).alias("ids")).filter("overloads > 1")


@query("SELECT repository_id, regexp_replace(path, '/.*$', '') AS top, grouping(repository_id, regexp_replace(path, '/.*$', ''))::BIGINT AS level, count(*) AS files, sum(size)::BIGINT AS size FROM files GROUP BY ROLLUP (repository_id, regexp_replace(path, '/.*$', ''))", "files")
def agg29_rollup(d: Data):
    f = d.files.withColumn("top", F.regexp_replace("path", "/.*$", ""))
    return f.rollup("repository_id", "top").agg(F.grouping_id().alias("level"), F.count("*").alias("files"), F.sum("size").alias("size"))


@query("SELECT entity_type, count(DISTINCT file_id) AS files FROM embs GROUP BY 1", "embs")
def agg30_distinct_files(d: Data):
    return d.embs.groupBy("entity_type").agg(F.count_distinct("file_id").alias("files"))


# --- windows ---
@query("SELECT id, CASE WHEN max(size) OVER w = min(size) OVER w THEN 0.0::DOUBLE ELSE round((size - min(size) OVER w)::DOUBLE / (max(size) OVER w - min(size) OVER w), 6) END AS norm FROM files WHERE size IS NOT NULL WINDOW w AS (PARTITION BY repository_id)", "files")
def win1_min_max(d: Data):
    # two aggregates joined back: a repository with a third of all files isn't one window partition
    f = d.where("files", "size is not null").select("id", "repository_id", "size")
    b = f.groupBy("repository_id").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    return f.join(b, "repository_id").select("id", F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.round((F.col("size") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6)).alias("norm"))


@query("SELECT repository_id, max_by(id, (last_modified, id)) AS id, max(last_modified) AS last_modified FROM files WHERE last_modified IS NOT NULL GROUP BY 1", "files")
def win2_latest_per_repository(d: Data):
    f = d.where("files", "last_modified is not null")
    return f.groupBy("repository_id").agg(F.max_by("id", F.struct("last_modified", "id")).alias("id"), F.max("last_modified").alias("last_modified"))


@query("SELECT class_id, id, name, rn FROM (SELECT class_id, id, name, row_number() OVER (PARTITION BY class_id ORDER BY start_line NULLS FIRST, id)::INTEGER AS rn FROM functions WHERE class_id IS NOT NULL) WHERE rn <= 5", "functions")
def win3_first_methods(d: Data):
    w = Window.partitionBy("class_id").orderBy(F.asc_nulls_first("start_line"), "id")
    return d.where("functions", "class_id is not null").withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("class_id", "id", "name", "rn")


@query("SELECT branch, count(*) AS files, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 3) AS percent FROM files GROUP BY 1", "files")
def win4_percent_of_total(d: Data):
    g = d.files.groupBy("branch").agg(F.count("*").alias("files"))
    return g.withColumn("percent", F.round(100.0 * F.col("files") / g.agg(F.sum("files")).scalar(), 3))


@query(
    """WITH f AS (SELECT m.file_id, f.id, f.start_line, f.end_line, f.end_line - f.start_line + 1 < 10 AS small FROM functions f JOIN modules m ON m.id = f.module_id WHERE f.start_line IS NOT NULL AND f.end_line IS NOT NULL),
    g AS (SELECT *, CASE WHEN small AND coalesce(lag(small) OVER w, false) THEN 0 ELSE 1 END AS brk FROM f WINDOW w AS (PARTITION BY file_id ORDER BY start_line, id)),
    i AS (SELECT *, sum(brk) OVER (PARTITION BY file_id ORDER BY start_line, id ROWS UNBOUNDED PRECEDING) AS island FROM g)
    SELECT file_id, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS members FROM i GROUP BY file_id, island""",
    "functions modules",
)
def win6_merge_small_chunks(d: Data):
    from codelode.operators.chunks import merge_small

    m = d.modules.select(F.col("id").alias("module_id"), "file_id")
    f = d.where("functions", "start_line is not null and end_line is not null").select("id", "module_id", "start_line", "end_line").join(m, "module_id")
    return merge_small(f, 10)
