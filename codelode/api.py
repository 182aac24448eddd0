"""One function per tool: tables in, one small DataFrame out. Trees and text are made from these rows by the caller.

``Code`` holds the tables; each of them is read lazily and each row once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as tx
from codelode.operators import domain as dm
from codelode.operators import graph as gr
from codelode.operators import lookup as lk
from codelode.operators import packages as pk
from codelode.operators import ranking as rk
from codelode.operators import rules as rl
from codelode.operators import tables as tb
from codelode.operators import vectors as vx
from codelode.parse import registry as rg
from codelode.plans.aggregates import file_hierarchy
from codelode.plans.base import Data
from codelode.sources import git as sg


class Code(Data):
    """The code model in a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Callable | None = None) -> None:
        super().__init__(spark, folder)
        self.embedder = embedder or vx.hash_embedder()

    # --- repositories
    def list_repositories(self) -> DataFrame:
        f = self.files.filter("not is_deleted").groupBy(F.col("repository_id").alias("id")).agg(F.count("*").alias("files"), F.max("last_modified").alias("last_change"))
        return self.repos.select("id", "owner", "name", "github_url", "is_active", "last_synced").join(f, "id", "left").fillna(0, ["files"])

    def add_repository(self, new: DataFrame) -> DataFrame:
        """What to append: rows whose url is not there yet."""
        return tb.insert_if_absent(self.repos, new, ["github_url"])

    def remove_repository(self, repository_id: int) -> list[DataFrame]:
        """The files, modules, classes and functions that stay."""
        gone = self.repos.filter(F.col("id") == repository_id).select("id")
        files, modules = tb.cascade_delete(gone, [(self.files, "repository_id"), (self.modules, "file_id")])
        left = modules.select(F.col("id").alias("module_id"))
        return [files, modules, self.classes.join(left, "module_id", "left_semi"), self.functions.join(left, "module_id", "left_semi")]

    def scan_repository(self, repository_id: int, url: str, folder: str, suffixes: tuple[str, ...] = (".py",)) -> DataFrame:
        """The files of a repository's working tree, cloned or brought up to date first."""
        return sg.scan(self.spark, sg.checkout(url, folder), repository_id, suffixes=suffixes)

    def update_repository_settings(self, changes: DataFrame) -> DataFrame:
        return tb.bulk_update(self.repos, changes, ["id"])

    def sync_repository(self, scan: DataFrame, repository_id: int) -> DataFrame:
        """Changes (path, change) between the stored files and a scan (path, content_hash)."""
        return tb.snapshot_diff(self.files.filter((F.col("repository_id") == repository_id) & ~F.col("is_deleted")).select("path", "content_hash"), scan, ["path"], "content_hash")

    # --- search
    def _symbols(self, condition: Column | None = None) -> DataFrame:
        """Symbols as delivered, or those that meet a condition, each once."""
        sym = lk.symbols(self.raw("code_functions"), self.raw("code_classes"), self.raw("code_modules"))
        return sym if condition is None else sym.filter(condition).dropDuplicates(["symbol_type", "id"])

    def keyword_search(self, query: str, repository_id: int | None = None, limit: int = 20) -> DataFrame:
        sym = lk.located(self._symbols(), self.modules, self.files)
        if repository_id is not None:
            sym = sym.filter(F.col("repository_id") == repository_id)
        return lk.keyword_search(sym, query, limit)

    def _vector(self, text: str) -> list[float]:
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([text])], ["id", "text"])
        return next(iter(self.embedder(iter([batch])))).column(1).to_pylist()[0]

    def semantic_search(self, query: str, scope: str = "all", repository_id: int | None = None, limit: int = 10, threshold: float | None = None) -> DataFrame:
        kinds = {"functions": "function", "classes": "class", "modules": "module"}
        e = self.embs.filter(F.col("embedding").isNotNull())
        if scope in kinds:
            e = e.filter(F.col("entity_type") == kinds[scope])
        if repository_id is not None:
            e = e.join(self.files.filter(F.col("repository_id") == repository_id).select(F.col("id").alias("file_id")), "file_id", "left_semi")
        return vx.search(e.select("id", "entity_type", "entity_id", "file_id", "embedding"), self._vector(query), limit, threshold, "id").drop("embedding")

    def search_code(self, query: str, limit: int = 10) -> DataFrame:
        """Semantic hits, ranked; keyword hits if there are none."""
        got = self.semantic_search(query, limit=limit, threshold=0.3)
        return got if got.limit(1).count() else self.keyword_search(query, limit=limit)

    def find_similar_code(self, snippet: str, limit: int = 10, threshold: float | None = None) -> DataFrame:
        return self.semantic_search("Code snippet:\n" + snippet, limit=limit, threshold=threshold)

    def search_by_business_capability(self, capability: str, limit: int = 10) -> DataFrame:
        return self.semantic_search(f"Code that implements: {capability}", limit=limit)

    def find_definition(self, name: str, kind: str | None = None) -> DataFrame:
        sym = lk.located(self._symbols(F.col("name") == name), self.modules, self.files)
        return sym if kind is None else sym.filter(F.col("symbol_type") == kind)

    def find_usage(self, name: str) -> DataFrame:
        m = self.modules.select(F.col("id").alias("module_id"), "file_id")
        at = self._symbols(F.col("name") == name).select("module_id", F.col("start_line").alias("line")).join(m, "module_id").select("file_id", "line")
        return dm.usages(self.contents, name, at)

    def rank(self, results: DataFrame, criteria: rk.Criteria, as_of: Column | None = None) -> DataFrame:
        return rk.rank(results, criteria, as_of)

    # --- code
    def get_code(self, kind: str, entity_id: int, context: int = 0) -> DataFrame:
        frames = {"function": self.functions, "class": self.classes, "module": self.modules.withColumn("module_id", F.col("id"))}
        one = lk.entity(kind, frames, entity_id).select("id", "name", "module_id", "start_line", "end_line")
        return lk.source_lines(self.contents, one.join(self.modules.select(F.col("id").alias("module_id"), "file_id"), "module_id"), context)

    def get_code_structure(self, path: str) -> DataFrame:
        f = self.files.filter(F.col("path") == path).select(F.col("id").alias("file_id"))
        return file_hierarchy(self).join(f, "file_id", "left_semi")

    def get_file_structure(self, path: str) -> DataFrame:
        """(file_id, path, language, size, modules, classes, functions, methods) of the files at a path."""
        f = self.files.filter(F.col("path") == path).select(F.col("id").alias("file_id"), "path", "language", "size")
        m = self.modules.join(f.select("file_id"), "file_id", "left_semi").select(F.col("id").alias("module_id"), "file_id")
        n = m.groupBy("file_id").agg(F.count("*").alias("modules"))
        c = self.classes.join(m, "module_id").groupBy("file_id").agg(F.count("*").alias("classes"))
        k = self.functions.join(m, "module_id").groupBy("file_id").agg(F.count_if(F.col("class_id").isNull()).alias("functions"), F.count_if(F.col("class_id").isNotNull()).alias("methods"))
        return f.join(n, "file_id", "left").join(c, "file_id", "left").join(k, "file_id", "left").fillna(0, ["modules", "classes", "functions", "methods"])

    def analyze_file(self, path: str) -> DataFrame:
        f = self.files.filter(F.col("path") == path).select(F.col("id").alias("file_id"))
        m = self.modules.join(f, "file_id", "left_semi").select(F.col("id").alias("module_id"), "file_id")
        c = F.coalesce("complexity", F.lit(1))
        return self.functions.join(m, "module_id").groupBy("file_id").agg(F.max("end_line").alias("total_lines"), F.count_if(F.col("class_id").isNotNull()).alias("methods"), F.count_if(F.col("class_id").isNull()).alias("functions"), F.sum(c).alias("complexity"), F.round(F.avg(c), 2).alias("avg_complexity"))

    def explain_code(self, name: str) -> DataFrame:
        d = self.find_definition(name)
        return d.select("symbol_type", "id", "path", F.concat_ws(". ", F.concat(F.initcap("symbol_type"), F.lit(" "), "name"), F.substring("docstring", 1, 200)).alias("explanation"))

    def suggest_refactoring(self, path: str) -> DataFrame:
        m = self.modules.join(self.files.filter(F.col("path") == path).select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("id").alias("module_id"))
        fn, cl = self.functions.join(m, "module_id", "left_semi"), self.classes.join(m, "module_id", "left_semi")
        return rl.function_smells(fn, tx.is_snake).withColumn("kind", F.lit("function")).unionByName(rl.class_smells(cl, self.functions, tx.is_camel).withColumn("kind", F.lit("class")))

    # --- dependencies and packages
    def analyze_dependencies(self, path: str) -> DataFrame:
        f = self.files.filter(F.col("path") == path)
        return rg.imports(f, self.contents)

    def get_dependencies(self, edges: DataFrame, entity_id: int, depth: int = 1) -> DataFrame:
        if not 1 <= depth <= 5:
            raise ValueError("depth must be between 1 and 5")
        return gr.k_hop(edges, self.spark.createDataFrame([(entity_id,)], "id long"), depth)

    def packages(self, repository_id: int | None = None) -> DataFrame:
        f = self.files if repository_id is None else self.files.filter(F.col("repository_id") == repository_id)
        return pk.hierarchy(pk.discover(f))

    def get_package_tree(self, repository_id: int) -> DataFrame:
        """(path, parent, depth, line) of a repository's packages, parents before children, each line indented by its depth."""
        p = pk.hierarchy(pk.discover(self.files.filter(F.col("repository_id") == repository_id))).filter("path <> ''")
        depth = F.size(F.split("path", "/")) - 1
        return p.select("path", F.nullif(F.col("parent"), F.lit("")).alias("parent"), depth.alias("depth"), F.concat(F.repeat(F.lit("  "), depth), "name").alias("line")).orderBy("path")

    def analyze_package_structure(self, repository_id: int) -> DataFrame:
        f = self.files.filter(F.col("repository_id") == repository_id)
        return pk.rollup(f, self.functions, self.classes, self.modules, pk.discover(f))

    def get_package_details(self, repository_id: int, path: str) -> DataFrame:
        """One package's totals, what it depends on and what depends on it, its sub-packages and its own files."""
        one = F.col("path") == path
        deps = self.get_package_coupling_metrics(repository_id).filter(one).select("path", "dependencies", "dependents")
        tree = self.get_package_tree(repository_id)
        inner = tree.filter(F.col("parent") == path).agg(F.array_sort(F.collect_list("path")).alias("subpackages"))
        own = self.files.filter((F.col("repository_id") == repository_id) & (pk.dirname("path") == path)).agg(F.array_sort(F.collect_set("path")).alias("files"))
        return self.analyze_package_structure(repository_id).filter(one).join(deps, "path").withColumn("subpackages", inner.scalar()).withColumn("files", own.scalar())

    def get_package_dependencies(self, repository_id: int) -> DataFrame:
        f = self.files.filter(F.col("repository_id") == repository_id)
        return pk.edges(rg.imports(f, self.contents).select("file_id", "module_name"), f, pk.discover(f))

    def get_package_coupling_metrics(self, repository_id: int) -> DataFrame:
        f = self.files.filter(F.col("repository_id") == repository_id)
        return pk.coupling(self.get_package_dependencies(repository_id), pk.discover(f))

    def find_circular_dependencies(self, repository_id: int, longest: int = 4) -> DataFrame:
        return gr.cycles(self.get_package_dependencies(repository_id), longest)

    # --- domain model
    def extract_domain_model(self, path: str, extractor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(file_id, entity_id, origin, name): the stored entities of the files at a path, else what the extractor, by default
        the index of classes, gives for them."""
        f = self.files.filter(F.col("path") == path).select(F.col("id").alias("file_id"))
        stored = self.where("embs", "entity_type = 'class' and embedding_type = 'interpreted' and file_id is not null").join(f, "file_id", "left_semi").select("file_id", "entity_id").distinct()
        m = self.modules.join(f, "file_id", "left_semi").select(F.col("id").alias("module_id"), "file_id")
        fresh = extractor(f) if extractor else self.classes.select(F.col("id").alias("entity_id"), "module_id").join(m, "module_id").select("file_id", "entity_id")
        return dm.fetch_or_extract(stored, fresh).join(self.classes.select(F.col("id").alias("entity_id"), "name"), "entity_id", "left")

    def find_aggregate_roots(self, entities: DataFrame, relations: DataFrame) -> DataFrame:
        """(id, name, members) of entities (id, name, kind) that are aggregate roots, by how many others they relate to."""
        n = relations.groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("members"))
        return entities.filter("kind = 'aggregate_root'").join(n, "id", "left").select("id", "name", F.coalesce("members", F.lit(0)).alias("members")).orderBy(F.desc("members"), "id")

    def analyze_bounded_context(self, context: int, members: DataFrame, edges: DataFrame) -> DataFrame:
        """One context's metrics with its name, description and core concepts; members (id, name, kind, context), edges (a, b)."""
        m = gr.context_metrics(edges, members.select("id", F.col("context").alias("community"))).filter(F.col("community") == context)
        return m.join(dm.context_descriptions(members.filter(F.col("context") == context)), F.col("community") == F.col("context")).drop("community")

    def find_similar_patterns(self, pattern_type: str, analyzer: Callable[[], DataFrame] | None = None, confidence: float = 0.8, limit: int = 10) -> DataFrame:
        """What a pluggable analyzer finds (pattern_type, confidence, ...); nothing without one."""
        if analyzer is None:
            return self.spark.createDataFrame([], "pattern_type string, confidence double")
        return vx.similar_patterns(analyzer(), pattern_type, confidence).limit(limit)

    def find_duplicate_code(self, detector: Callable[[], DataFrame] | None = None, similarity: float = 0.9, limit: int | None = None) -> DataFrame:
        """Groups (similarity, ...) of a pluggable detector, the most similar first; by default rows with equal vectors' pairs."""
        found = (detector() if detector else vx.pairs_above(self.embs.filter("embedding is not null").select(F.col("id").alias("vec_id"), "embedding"), similarity)).filter(F.col("similarity") >= similarity)
        ranked = found.orderBy(F.desc("similarity"), *[c for c in found.columns if c != "similarity"])
        return ranked if limit is None else ranked.limit(limit)

    def detect_contexts(self, entities: DataFrame, relations: DataFrame) -> DataFrame:
        return gr.communities(gr.build(entities, relations))

    def analyze_coupling(self, relations: DataFrame, entities: DataFrame) -> DataFrame:
        return rl.coupling(relations, entities)

    def suggest_context_splits(self, members: DataFrame, edges: DataFrame, cohesion: DataFrame, least: int = 20, most: float = 0.4) -> DataFrame:
        return dm.context_splits(members, edges, cohesion, least, most)

    def detect_anti_patterns(self) -> DataFrame:
        return rl.anti_patterns(self.classes, self.functions)

    def suggest_ddd_refactoring(self) -> DataFrame:
        return dm.suggestions(self.classes, self.functions, self.modules)

    def analyze_domain_evolution(self, as_of: str, days: int = 30) -> DataFrame:
        return rl.evolution(self.classes.withColumn("kind", F.lit("class")), "kind", "created_at", as_of, days)

    def get_domain_metrics(self) -> DataFrame:
        return rl.health_b(self.detect_anti_patterns())

    def generate_context_map(self, relations: DataFrame) -> DataFrame:
        return rl.mermaid(rl.pair_counts(relations))
