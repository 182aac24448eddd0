"""Further lookups, vector searches, summaries and table states, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import graph as gr
from codelode.operators import lookup as lk
from codelode.operators import packages as pk
from codelode.operators import tables as tb
from codelode.operators import vectors as vx
from codelode.parse import registry as rg
from codelode.session import shared_dir

from .aggregates import DIRS
from .base import Data, query
from .rules import PAIRS, relations

OK = "len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: isnan(x)), true) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0"
#: Python's from-imports by line, which SQL can read as well as Spark.
FROM = "imp AS (SELECT c.file_id, f.repository_id, f.path, regexp_extract(s, '^from ([A-Za-z_][A-Za-z_0-9.]*) import', 1) AS module_name FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS s FROM contents WHERE content IS NOT NULL) c JOIN files f ON f.id = c.file_id WHERE f.path LIKE '%.py' AND regexp_matches(s, '^from [A-Za-z_][A-Za-z_0-9.]* import'))"


def from_imports(d: Data):
    f = d.where("files", F.col("path").endswith(".py")).select(F.col("id").alias("file_id"), "repository_id", "path")
    s = d.contents.select("file_id", F.explode(F.split("content", "\n")).alias("s")).filter(F.col("s").rlike("^from [A-Za-z_][A-Za-z_0-9.]* import"))
    return s.join(f, "file_id").select("file_id", "repository_id", "path", F.regexp_extract("s", "^from ([A-Za-z_][A-Za-z_0-9.]*) import", 1).alias("module_name"))


def good(d: Data):
    return d.where("embs", (F.size("embedding") == 64) & ~F.exists("embedding", lambda x: F.isnan(x)) & F.exists("embedding", lambda x: x != 0))


@query(f"WITH {DIRS} SELECT repository_id, path, name, module_count FROM pkg WHERE path IN ('src', 'app', 'core', 'tests', 'docs', 'lib', '')")
def src21_packages_by_path(d: Data):
    return pk.discover(d.files).filter(F.col("path").isin("src", "app", "core", "tests", "docs", "lib", "")).select("repository_id", "path", "name", "module_count")


@query(f"WITH {FROM} SELECT DISTINCT file_id, module_name FROM imp WHERE contains(module_name, 'app.token') OR suffix(module_name, '.queue')", "contents files")
def jn8_import_usages(d: Data):
    return from_imports(d).filter(F.contains("module_name", F.lit("app.token")) | F.col("module_name").endswith(".queue")).select("file_id", "module_name").distinct()


@query(f"WITH {FROM} SELECT DISTINCT path FROM imp WHERE starts_with(module_name, 'app.') ORDER BY path LIMIT 10", "contents files")
def jn9_importers(d: Data):
    return from_imports(d).filter(F.col("module_name").startswith("app.")).select("path").distinct().orderBy("path").limit(10)


@query(
    f"""WITH {FROM}, {DIRS}, i AS (SELECT row_number() OVER () AS n, repository_id, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS source, string_split(replace(module_name, '.', '/'), '/') AS parts FROM imp),
    m AS (SELECT i.n, i.repository_id, i.source, max_by(pkg.path, k) AS target FROM i, unnest(range(1, len(i.parts) + 1)) AS t(k) JOIN pkg ON pkg.repository_id = i.repository_id AND pkg.path = array_to_string(i.parts[1:k], '/') GROUP BY 1, 2, 3),
    o AS (SELECT i.n, i.repository_id, i.source, min(pkg.path) AS target FROM i JOIN pkg ON pkg.repository_id = i.repository_id AND pkg.name = i.parts[1] WHERE i.n NOT IN (SELECT n FROM m) GROUP BY 1, 2, 3)
    SELECT repository_id, source, target, count(*) AS import_count FROM (SELECT * FROM m UNION ALL SELECT * FROM o) WHERE source <> target GROUP BY 1, 2, 3""",
    "contents files",
)
def jn13_longest_prefix(d: Data):
    return pk.edges(from_imports(d).select("file_id", "module_name"), d.files, pk.discover(d.files))


@query("SELECT f.id, d.dir FROM (SELECT id, repository_id, path FROM files WHERE path LIKE '%.py') f JOIN (SELECT DISTINCT repository_id, regexp_replace(path, '/[^/]*$', '') AS dir FROM code_files WHERE path LIKE '%/__init__.py') d ON d.repository_id = f.repository_id AND starts_with(f.path, d.dir || '/')", "files")
def jn15_files_under_packages(d: Data):
    up = pk.ancestors(d.where("files", F.col("path").endswith(".py")).select("id", "repository_id", "path"), "path").filter("depth > 0")
    return up.join(pk.package_dirs(d.raw("code_files")), ["repository_id", "dir"]).select("id", "dir")


@query()
def jn17_references_with_files(d: Data):
    f = d.files.select(F.col("id").alias("file_id"), "path")
    return rg.references(d.raw("code_files"), d.raw("file_contents")).join(f, "file_id").select("path", "source", "target", "type", "line")


STRATEGIES = {"by_type": "entity_type", "by_embedding": "embedding_type"}


@query("SELECT 'by_type' AS strategy, entity_type AS key, count(*) AS n FROM embs GROUP BY 2 UNION ALL SELECT 'by_embedding', embedding_type, count(*) FROM embs GROUP BY 2", "embs")
def agg12_dispatch(d: Data):
    frames = [d.embs.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).select(F.lit(s).alias("strategy"), "key", "n") for s, c in STRATEGIES.items()]
    return frames[0].unionByName(frames[1])


@query("SELECT e.entity_type, count(*) AS entities, list_sort(list(DISTINCT e.embedding_type)) AS kinds, count(DISTINCT e.file_id) AS files FROM embs e GROUP BY 1", "embs")
def agg25_type_histogram(d: Data):
    return d.embs.groupBy("entity_type").agg(F.count("*").alias("entities"), F.array_sort(F.collect_set("embedding_type")).alias("kinds"), F.count_distinct("file_id").alias("files"))


@query("SELECT n_nationkey AS context, count(*) AS entities, round(coalesce(avg(s_acctbal), 0), 4) AS cohesion FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 3 ORDER BY cohesion DESC, context")
def top4_contexts(d: Data):
    g = d.supplier.groupBy(F.col("s_nationkey").alias("context")).agg(F.count("*").alias("entities"), F.round(F.coalesce(F.avg("s_acctbal"), F.lit(0.0)), 4).alias("cohesion"))
    return g.join(d.nation.select(F.col("n_nationkey").alias("context")), "context", "left_semi").filter("entities >= 3").orderBy(F.desc("cohesion"), "context")


@query(f"WITH {PAIRS}, a AS (SELECT 0 AS ordinal, concat(source, '->', target) AS issue, n FROM pair ORDER BY n DESC, source, target LIMIT 3), b AS (SELECT 1 AS ordinal, concat('class ', id) AS issue, methods AS n FROM (SELECT c.id, count(f.id) AS methods FROM classes c JOIN functions f ON f.class_id = c.id GROUP BY 1) ORDER BY n DESC, id LIMIT 7) SELECT * FROM a UNION ALL SELECT * FROM b", "classes functions")
def top6_issues(d: Data):
    from codelode.operators.rules import pair_counts

    a = pair_counts(relations(d)).orderBy(F.desc("n"), "source", "target").limit(3).select(F.lit(0).alias("ordinal"), F.concat(F.col("source").cast("string"), F.lit("->"), F.col("target").cast("string")).alias("issue"), "n")
    c = d.classes.select(F.col("id").alias("class_id"))
    b = d.functions.join(c, "class_id", "left_semi").groupBy("class_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class_id").limit(7).select(F.lit(1).alias("ordinal"), F.concat(F.lit("class "), F.col("class_id").cast("string")).alias("issue"), "n")
    return a.unionByName(b)


@query()
def vec3_by_code_snippet(d: Data):
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array(["Code snippet:\nreturn limit + 1"])], ["id", "text"])
    vector = next(iter(vx.hash_embedder()(iter([batch])))).column(1).to_pylist()[0]
    assert np.any(vector)
    texts = d.functions.select(F.col("id"), F.concat_ws(" ", "name", "docstring").alias("text"))
    return vx.search(vx.embed_texts(texts, "id", "text").withColumnRenamed("id", "vec_id"), vector, 10).select("vec_id", "similarity")


@query(
    f"""WITH g AS (SELECT * FROM embs WHERE {OK}), q AS (SELECT * FROM g WHERE id = (SELECT min(id) FROM g)) SELECT g.id, round(list_cosine_similarity(g.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity, f.path
    FROM g CROSS JOIN q LEFT JOIN files f ON f.id = g.file_id WHERE g.id <> q.id AND round(list_cosine_similarity(g.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) > 0.2 ORDER BY similarity DESC, g.id LIMIT 10""",
    "embs files",
)
def vec5_semantic_hydrated(d: Data):
    g = good(d)
    first = g.agg(F.min("id")).first()[0]
    got = vx.similar_to(g, first, 2**31 - 1, key="id").filter("similarity > 0.2").orderBy(F.desc("similarity"), "id").limit(10) if first is not None else g.limit(0).withColumn("similarity", F.lit(0.0))
    return got.join(d.files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").select("id", "similarity", "path")


@query(
    f"""WITH g AS (SELECT * FROM embs WHERE {OK} AND embedding_type = 'raw'), q AS (SELECT * FROM g WHERE id = (SELECT min(id) FROM g)) SELECT g.id, round(list_cosine_similarity(g.embedding::DOUBLE[], q.embedding::DOUBLE[]), 3) AS similarity, CASE WHEN length(g.content) > 200 THEN concat(substr(g.content, 1, 200), '...') ELSE g.content END AS preview
    FROM g CROSS JOIN q WHERE g.id <> q.id AND g.file_id <> q.file_id AND round(list_cosine_similarity(g.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) >= 0.1 ORDER BY round(list_cosine_similarity(g.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, g.id LIMIT 20""",
    "embs",
)
def vec6_similar_code_preview(d: Data):
    g = good(d).filter("embedding_type = 'raw'")
    first = g.agg(F.min("id")).first()[0]
    if first is None:
        return g.select("id", F.lit(0.0).alias("similarity"), F.col("content").alias("preview")).limit(0)
    got = vx.similar_to(g, first, 20, 0.1, lambda r: F.col("file_id") != r["file_id"], key="id")
    return got.select("id", F.round("similarity", 3).alias("similarity"), F.when(F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("..."))).otherwise(F.col("content")).alias("preview"))


@query("SELECT c.file_id, 'class' AS kind, c.id, c.name FROM (SELECT m.file_id, c.id, c.name, row_number() OVER (PARTITION BY m.file_id ORDER BY c.id) AS r FROM classes c JOIN modules m ON m.id = c.module_id) c WHERE r <= 10 UNION ALL SELECT f.file_id, 'function', f.id, f.name FROM (SELECT m.file_id, f.id, f.name, row_number() OVER (PARTITION BY m.file_id ORDER BY f.id) AS r FROM functions f JOIN modules m ON m.id = f.module_id) f WHERE r <= 10", "classes functions modules")
def vec13_implementations(d: Data):
    from pyspark.sql.window import Window

    m = d.modules.select(F.col("id").alias("module_id"), "file_id")
    w = Window.partitionBy("file_id").orderBy("id")
    one = lambda df, kind: df.select("id", "name", "module_id").join(m, "module_id").withColumn("r", F.row_number().over(w)).filter("r <= 10").select("file_id", F.lit(kind).alias("kind"), "id", "name")
    return one(d.classes, "class").unionByName(one(d.functions, "function"))


@query()
def vec19_entity_embeddings(d: Data):
    from codelode.operators.domain import function_text

    return vx.embed_texts(function_text(d.functions), "id", "text")


@query("WITH b AS (SELECT repository_id, path, branch FROM files) SELECT repository_id, count(DISTINCT path) AS paths, count(DISTINCT branch) AS branches, count(*) AS files FROM b GROUP BY 1", "files")
def agg_distinct_counts(d: Data):
    f = d.files.groupBy("repository_id")
    return f.agg(F.count_distinct("path").alias("paths"), F.count_distinct("branch").alias("branches"), F.count("*").alias("files"))


@query()
def gr12_package_cycles(d: Data):
    e = pk.edges(rg.imports(d.raw("code_files"), d.raw("file_contents")).select("file_id", "module_name"), d.files, pk.discover(d.files))
    name = lambda c: F.concat(F.col("repository_id").cast("string"), F.lit(":"), F.col(c))
    return gr.cycles(e.select(name("source").alias("source"), name("target").alias("target")))


@query("SELECT kind, count(*) AS n, count(DISTINCT s) AS statements FROM (SELECT s, CASE WHEN regexp_matches(s, '^from \\.') THEN 'relative' WHEN regexp_matches(s, '^(from|import) (app|src|core)(\\.| |$)') THEN 'internal' ELSE 'external' END AS kind FROM (SELECT unnest(string_split(c.content, chr(10))) AS s FROM contents c JOIN files f ON f.id = c.file_id WHERE f.path LIKE '%.py') WHERE regexp_matches(s, '^(from|import) [A-Za-z_.]')) GROUP BY 1", "contents files")
def gr21_import_groups(d: Data):
    py = d.where("files", F.col("path").endswith(".py")).select(F.col("id").alias("file_id"))
    s = d.contents.join(py, "file_id", "left_semi").select(F.explode(F.split("content", "\n")).alias("s")).filter(F.col("s").rlike("^(from|import) [A-Za-z_.]"))
    kind = F.when(F.col("s").rlike(r"^from \."), "relative").when(F.col("s").rlike(r"^(from|import) (app|src|core)(\.| |$)"), "internal").otherwise("external")
    return s.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("s").alias("statements"))


@query(
    """SELECT 'function' AS kind, id, 'undocumented' AS smell FROM functions WHERE docstring IS NULL UNION ALL SELECT 'function', id, 'long' FROM functions WHERE end_line - start_line + 1 > 50 UNION ALL SELECT 'class', id, 'undocumented' FROM classes WHERE docstring IS NULL UNION ALL SELECT 'module', id, 'undocumented' FROM modules WHERE docstring IS NULL""",
    "functions classes modules",
)
def dom14_refactoring(d: Data):
    un = lambda df, kind: df.filter("docstring is null").select(F.lit(kind).alias("kind"), "id", F.lit("undocumented").alias("smell"))
    long_ = d.where("functions", "end_line - start_line + 1 > 50").select(F.lit("function").alias("kind"), "id", F.lit("long").alias("smell"))
    return un(d.functions, "function").unionByName(long_).unionByName(un(d.classes, "class")).unionByName(un(d.modules, "module"))


@query("SELECT f.id, f.name, f.is_async, coalesce(len(f.parameters), 0)::INTEGER AS n_parameters, c.name AS class_name, m.name AS module, l.path FROM functions f LEFT JOIN classes c ON c.id = f.class_id LEFT JOIN modules m ON m.id = f.module_id LEFT JOIN files l ON l.id = m.file_id", "functions classes modules files")
def dom17_symbol_info(d: Data):
    c = d.classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    m = d.modules.select(F.col("id").alias("module_id"), F.col("name").alias("module"), "file_id")
    l = d.files.select(F.col("id").alias("file_id"), "path")  # noqa: E741
    f = d.functions.select("id", "name", "is_async", F.coalesce(F.size("parameters"), F.lit(0)).alias("n_parameters"), "class_id", "module_id")
    return f.join(c, "class_id", "left").join(m, "module_id", "left").join(l, "file_id", "left").select("id", "name", "is_async", F.greatest("n_parameters", F.lit(0)).alias("n_parameters"), "class_name", "module", "path")


@query("SELECT id, concat_ws('. ', concat(CASE WHEN is_async THEN 'Async function ' ELSE 'Function ' END, name), CASE WHEN len(parameters) > 0 THEN concat('Takes ', len(parameters), ' parameters') END, CASE WHEN return_type IS NOT NULL THEN concat('Returns ', return_type) END) AS description FROM functions", "functions")
def str11_description(d: Data):
    n = F.size("parameters")
    return d.functions.select("id", F.concat_ws(". ", F.concat(F.when(F.col("is_async"), "Async function ").otherwise("Function "), "name"), F.when(n > 0, F.concat(F.lit("Takes "), n.cast("string"), F.lit(" parameters"))), F.concat(F.lit("Returns "), "return_type")).alias("description"))


@query("SELECT p_partkey, round(p_retailprice / 7, 2) AS rounded, (p_size // 7)::INTEGER AS floored, least(greatest(p_size, 10), 40) AS clamped, round(p_retailprice / nullif(p_size - 1, 0), 4) AS ratio FROM part")
def num1_arithmetic(d: Data):
    return d.part.select("p_partkey", F.round(F.col("p_retailprice") / 7, 2).alias("rounded"), F.floor(F.col("p_size") / 7).cast("int").alias("floored"), F.least(F.greatest("p_size", F.lit(10)), F.lit(40)).alias("clamped"), F.round(F.try_divide(F.col("p_retailprice"), F.col("p_size") - 1), 4).alias("ratio"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-06-01' ELSE last_synced END AS last_synced FROM repos", "repos")
def snk8_touch_synced(d: Data):
    return d.repos.select("id", F.when(F.col("id") % 3 == 0, F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))).otherwise(F.col("last_synced")).alias("last_synced"))


@query()
def snk9_store_parsed(d: Data):
    shared_dir(d.spark)
    e = rg.entities(d.raw("code_files"), d.raw("file_contents")).filter("kind <> 'module'").withColumn("id", F.xxhash64("file_id", "kind", "name", "start_line")).checkpoint()  # parsed once for both sides
    c = e.filter("kind in ('class', 'interface', 'trait', 'enum', 'record')").groupBy("file_id", F.col("name").alias("class_name")).agg(F.min("id").alias("class_id"))
    return e.filter("kind in ('function', 'method')").join(c, ["file_id", "class_name"], "left").select("file_id", "id", "name", "class_id", "complexity")


@query("SELECT r.id FROM repos r WHERE r.github_url NOT IN (SELECT github_url FROM repositories WHERE is_active)", "repos")
def snk17_new_repositories(d: Data):
    return tb.insert_if_absent(d.raw("repositories").filter("is_active"), d.repos, ["github_url"]).select("id")


@query("SELECT f.id FROM files f WHERE f.repository_id NOT IN (SELECT id FROM repositories WHERE NOT is_active)", "files")
def snk17_remove_inactive(d: Data):
    return tb.cascade_delete(d.raw("repositories").filter("not is_active").select("id"), [(d.files, "repository_id")])[0].select("id")


@query("SELECT user_id AS session_id, event_type AS query_type, count(*) AS results_count, round(avg(value) * 10, 6) AS response_time_ms, max(ts) AS created_at FROM events GROUP BY 1, 2")
def snk13_search_log(d: Data):
    return d.events.groupBy(F.col("user_id").alias("session_id"), F.col("event_type").alias("query_type")).agg(F.count("*").alias("results_count"), F.round(F.avg("value") * 10, 6).alias("response_time_ms"), F.max("ts").alias("created_at"))


@query("SELECT t AS table_name, t IN ('repositories', 'code_files', 'code_modules', 'code_classes', 'code_functions', 'code_embeddings', 'file_contents') AS present FROM (VALUES ('repositories'), ('code_files'), ('code_modules'), ('code_classes'), ('code_functions'), ('code_embeddings'), ('file_contents'), ('commits')) AS v(t)")
def snk15_expected_tables(d: Data):
    from codelode.schema import expected_tables

    return expected_tables(d.spark, d.dir, ["repositories", "code_files", "code_modules", "code_classes", "code_functions", "code_embeddings", "file_contents", "commits"])


@query("WITH s AS (SELECT repository_id, path, branch, count(*) AS deliveries FROM code_files GROUP BY 1, 2, 3) SELECT repository_id, count(*) AS files, count(*) FILTER (WHERE deliveries > 1) AS again FROM s GROUP BY 1")
def stm2_redelivered(d: Data):
    s = d.raw("code_files").groupBy("repository_id", "path", "branch").agg(F.count("*").alias("deliveries"))
    return s.groupBy("repository_id").agg(F.count("*").alias("files"), F.count_if(F.col("deliveries") > 1).alias("again"))


@query("SELECT id, path FROM files WHERE id NOT IN (SELECT file_id FROM code_embeddings WHERE file_id IS NOT NULL) AND NOT is_deleted ORDER BY last_modified NULLS FIRST, id LIMIT 100", "files")
def stm5_next_batch(d: Data):
    e = d.raw("code_embeddings").filter("file_id is not null").select(F.col("file_id").alias("id"))
    return d.where("files", "not is_deleted").join(e, "id", "left_anti").orderBy(F.asc_nulls_first("last_modified"), "id").limit(100).select("id", "path")


@query("SELECT id, name, 'type' AS kind FROM classes WHERE regexp_extract('class:' || name, '^([a-z]+):([^@]+)(?:@(.*))?$', 2) = name", "classes")
def str6_typed_names(d: Data):
    ref = F.concat(F.lit("class:"), "name")
    return d.where("classes", F.regexp_extract(ref, r"^([a-z]+):([^@]+)(?:@(.*))?$", 2) == F.col("name")).select("id", "name", F.lit("type").alias("kind"))

