"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions import text as tx

from .base import Data, query


@query("SELECT id, regexp_matches(name, '^[a-z][a-z0-9_]*$') AS snake, regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') AS camel FROM functions", "functions")
def str2_naming(d: Data):
    return d.functions.select("id", tx.is_snake("name").alias("snake"), tx.is_camel("name").alias("camel"))


@query("SELECT id, trim(lower(regexp_replace(name, '([A-Z]+)', '_\\1', 'g')), '_') AS snake FROM classes", "classes")
def str3_to_snake(d: Data):
    return d.classes.select("id", tx.to_snake("name").alias("snake"))


@query("SELECT id, array_to_string(list_transform(string_split(name, '_'), lambda w: concat(upper(w[1:1]), lower(w[2:]))), '') AS camel FROM functions", "functions")
def str3_to_camel(d: Data):
    return d.functions.select("id", tx.to_camel("name").alias("camel"))


@query("SELECT id, concat(name, '(', array_to_string(list_transform(coalesce(parameters, []), lambda p: concat(p.name, coalesce(concat(': ', nullif(p.type, NULL)), ''), CASE WHEN p.\"default\" IS NULL THEN '' ELSE concat(' = ', p.\"default\") END)), ', '), ')', CASE WHEN return_type IS NULL THEN '' ELSE concat(' -> ', return_type) END) AS signature FROM (SELECT id, name, list_transform(parameters, lambda p: {'name': p.name, 'type': CASE WHEN p.type IS NULL THEN NULL ELSE p.type END, 'default': p.\"default\"}) AS parameters, return_type FROM functions WHERE len(list_filter(coalesce(parameters, []), lambda p: p.type IS NULL)) = 0)", "functions")
def str5_signature(d: Data):
    f = d.where("functions", F.size(F.filter(F.coalesce("parameters", F.array().cast("array<struct<name:string,type:string,default:string>>")), lambda p: p["type"].isNull())) == 0)
    return f.select("id", tx.signature("name", "parameters", "return_type").alias("signature"))


@query("SELECT id, regexp_extract(github_url, '[:/]([^/:]+)/[^/]+?(?:\\.git)?/?$', 1) AS owner, regexp_extract(github_url, '/([^/]+?)(?:\\.git)?/?$', 1) AS name FROM repos", "repos")
def str9_url_parts(d: Data):
    return d.repos.select("id", tx.url_owner("github_url").alias("owner"), tx.url_name("github_url").alias("name"))


@query("SELECT doc_id, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3)::INTEGER AS tokens FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[ -~\\n\\r\\t]*')")
def str13_token_estimate(d: Data):
    return d.documents.filter("text is not null").filter(F.col("text").rlike(r"^[ -~\n\r\t]*\z")).select("doc_id", tx.token_estimate("text").alias("tokens"))


@query("SELECT id, CASE WHEN regexp_matches(path, '\\.py$') THEN 'python' WHEN regexp_matches(path, '\\.js$') THEN 'javascript' WHEN regexp_matches(path, '\\.ts$') THEN 'typescript' WHEN regexp_matches(path, '\\.java$') THEN 'java' WHEN regexp_matches(path, '\\.php$') THEN 'php' END AS detected FROM files", "files")
def par24_language_detection(d: Data):
    return d.files.select("id", tx.language_of("path").alias("detected"))


@query("SELECT id, regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') AS path, trim(path) <> '' AS valid FROM files", "files")
def str4_str8_paths(d: Data):
    return d.files.select("id", tx.normal_path("path").alias("path"), tx.valid_path("path").alias("valid"))


@query(
    """SELECT id, CASE WHEN t IS NULL THEN 'never' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(s // 60, ' minute', CASE WHEN s // 60 = 1 THEN '' ELSE 's' END, ' ago') WHEN s < 86400 THEN concat(s // 3600, ' hour', CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END, ' ago') WHEN s // 86400 < 30 THEN concat(s // 86400, ' day', CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END, ' ago') ELSE strftime(t, '%Y-%m-%d %H:%M') END AS ago
    FROM (SELECT id, last_modified AS t, epoch(TIMESTAMP '2024-06-01')::BIGINT - floor(epoch(last_modified))::BIGINT AS s FROM files)""",
    "files",
)
def dt1_relative_time(d: Data):
    return d.files.select("id", tx.relative_time(F.col("last_modified").cast("timestamp"), F.lit("2024-06-01 00:00:00").cast("timestamp")).alias("ago"))


@query("SELECT id, CASE WHEN t IS NULL THEN 'Never synced' WHEN s >= 86400 THEN concat(s // 86400, ' days ago') WHEN s >= 3600 THEN concat(s // 3600, ' hours ago') WHEN s >= 60 THEN concat(s // 60, ' minutes ago') ELSE 'Just now' END AS age FROM (SELECT id, last_synced AS t, epoch(TIMESTAMP '2030-01-01')::BIGINT - floor(epoch(last_synced))::BIGINT AS s FROM repos)", "repos")
def dt2_sync_age(d: Data):
    return d.repos.select("id", tx.sync_age(F.col("last_synced").cast("timestamp"), F.lit("2030-01-01 00:00:00").cast("timestamp")).alias("age"))


@query("SELECT p_partkey, CASE WHEN p_size < 7 THEN -1 WHEN p_size > 7 THEN 1 ELSE 0 END AS compared FROM part")
def num2_versions(d: Data):
    return d.part.select("p_partkey", tx.compare_versions(F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0")), F.lit("1.7.0")).alias("compared"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def jsn1_props(d: Data):
    return d.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT id, list_sort(list_distinct(list_concat(coalesce(base_classes, []), coalesce(decorators, [])))) AS merged, array_to_string(coalesce(base_classes, [])[1:1], ', ') AS first_base FROM classes", "classes")
def arr1_union_and_slice(d: Data):
    none = F.array().cast("array<string>")
    return d.classes.select("id", F.array_sort(F.array_union(F.coalesce("base_classes", none), F.coalesce("decorators", none))).alias("merged"), F.array_join(F.slice(F.coalesce("base_classes", none), 1, 1), ", ").alias("first_base"))


@query("SELECT id, coalesce(repo_metadata['topic'], 'none') AS topic FROM repos", "repos")
def map1_default(d: Data):
    merged = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("topic").alias("key"), F.coalesce(F.try_element_at("repo_metadata", F.lit("topic")), F.lit("none")).alias("value")))))
    return d.repos.select("id", merged["topic"].alias("topic"))


@query("SELECT id, CASE WHEN complexity <= 10 THEN 'simple' WHEN complexity <= 20 THEN 'moderate' WHEN complexity <= 50 THEN 'complex' WHEN complexity IS NOT NULL THEN 'very complex' END AS level FROM functions", "functions")
def par21_complexity_level(d: Data):
    return d.functions.select("id", tx.complexity_level("complexity").alias("level"))


@query("SELECT id, CASE WHEN n < 1 THEN path END AS file, coalesce(n, 0) AS n FROM (SELECT id, path, len(string_split(path, ':')) - 1 AS n FROM files) WHERE n < 1", "files")
def str7_location(d: Data):
    return d.files.select("id", tx.location("path")["file"].alias("file"), (F.size(F.split("path", ":")) - 1).cast("long").alias("n")).filter("n < 1")
