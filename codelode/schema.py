"""Schemas of the tables, their enumerations, ids by natural key, and which tables there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table -> DDL of its columns.
TABLES: dict[str, str] = {
    "repositories": "id long, github_url string, owner string, name string, default_branch string, access_token_id string, last_synced timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, is_active boolean, webhook_id string, repo_metadata map<string,string>",
    "code_files": "id long, repository_id long, path string, content_hash string, git_hash string, branch string, size int, language string, last_modified timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, is_deleted boolean",
    "file_contents": "file_id long, content string",
    "code_modules": "id long, file_id long, name string, docstring string, start_line int, end_line int, created_at timestamp_ntz, updated_at timestamp_ntz",
    "code_classes": "id long, module_id long, name string, docstring string, base_classes array<string>, decorators array<string>, start_line int, end_line int, is_abstract boolean, created_at timestamp_ntz, updated_at timestamp_ntz",
    "code_functions": "id long, module_id long, class_id long, name string, docstring string, parameters array<struct<name:string,type:string,default:string>>, return_type string, decorators array<string>, start_line int, end_line int, is_async boolean, is_generator boolean, is_property boolean, is_static boolean, is_classmethod boolean, complexity int, created_at timestamp_ntz, updated_at timestamp_ntz",
    "code_imports": "id long, file_id long, import_statement string, module_name string, imported_names array<string>, is_relative boolean, level int, line_number int, created_at timestamp_ntz",
    "commits": "id long, repository_id long, sha string, message string, author string, author_email string, timestamp timestamp_ntz, files_changed array<string>, additions int, deletions int, processed boolean, created_at timestamp_ntz",
    "code_references": "id long, source_type string, source_id long, source_file_id long, source_line int, target_type string, target_id long, target_file_id long, reference_type string, context string, is_dynamic boolean, created_at timestamp_ntz",
    "code_embeddings": "id long, entity_type string, entity_id long, file_id long, embedding_type string, embedding array<float>, content string, tokens int, repo_metadata map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "search_history": "id long, query string, query_type string, results_count int, response_time_ms double, user_id string, session_id string, created_at timestamp_ntz",
    "packages": "id long, repository_id long, path string, name string, parent_id long, init_file_id long, has_init boolean, is_namespace boolean, module_count int, subpackage_count int, total_lines int, total_functions int, total_classes int, readme_file_id long, docstring string",
    "package_modules": "package_id long, file_id long, module_name string, is_public boolean, has_main boolean, exports array<string>",
    "package_dependencies": "source_package_id long, target_package_id long, import_count int, dependency_type string, import_details array<struct<module:string,names:array<string>,line:int>>",
    "package_metrics": "package_id long, total_complexity int, avg_complexity int, max_complexity int, cohesion_score double, coupling_score double, total_loc int, total_comments int, total_docstrings int, test_coverage double, has_tests boolean, has_docs boolean, public_classes int, public_functions int, public_constants int",
    "domain_entities": "id long, name string, entity_type string, description string, business_rules array<string>, invariants array<string>, responsibilities array<string>, ubiquitous_language map<string,string>, source_entities array<long>, confidence_score double, concept_embedding array<float>, extraction_metadata map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "domain_relationships": "id long, source_entity_id long, target_entity_id long, relationship_type string, description string, strength double, confidence_score double, evidence array<string>, interaction_patterns array<string>, data_flow map<string,string>",
    "bounded_contexts": "id long, name string, description string, ubiquitous_language map<string,string>, core_concepts array<string>, published_language map<string,string>, anti_corruption_layer map<string,string>, context_type string, summary string, responsibilities array<string>, cohesion_score double, coupling_score double, modularity_score double",
    "bounded_context_memberships": "domain_entity_id long, bounded_context_id long, role string, importance_score double",
    "context_relationships": "id long, source_context_id long, target_context_id long, relationship_type string, description string, interface_description map<string,string>",
    "domain_summaries": "id long, level string, entity_type string, entity_id long, business_summary string, technical_summary string, domain_concepts array<string>, parent_summary_id long",
}
#: Fixed values of the enumerations.
ENTITY_TYPES = ("file", "module", "class", "function")
EMBEDDING_TYPES = ("raw", "interpreted")


def natural_id(*keys: str) -> Column:
    """A row's id by its natural key; the same key gives the same id in any run."""
    return F.xxhash64(*keys)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def expected_tables(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(table_name, present): which tables the folder holds."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda n: (p := jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.parquet")).getFileSystem(conf).exists(p)
    return spark.createDataFrame([(n, bool(there(n))) for n in names], "table_name string, present boolean")
