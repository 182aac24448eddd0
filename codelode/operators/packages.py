"""Packages of a repository: discovery, hierarchy, membership by longest prefix, rollups over the subtree.

Ancestors are exploded and equi-joined; there is no prefix theta join and no per-package pass. A path has few segments, so
an explode multiplies by the depth of the tree, not by the number of packages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dirname(path: str | Column) -> Column:
    """The directory, "" for a file at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def basename(path: str | Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def discover(files: DataFrame) -> DataFrame:
    """(repository_id, path, name, has_init, is_namespace, module_count) of each directory that holds Python files."""
    py = files.filter(F.col("path").endswith(".py")).select("repository_id", dirname("path").alias("dir"), basename("path").alias("base")).distinct()
    g = py.groupBy("repository_id", "dir").agg(F.bool_or(F.col("base") == "__init__.py").alias("has_init"), F.count_if(F.col("base") != "__init__.py").alias("module_count"))
    return g.select("repository_id", F.col("dir").alias("path"), F.when(F.col("dir") == "", "root").otherwise(basename("dir")).alias("name"), "has_init", (~F.col("has_init")).alias("is_namespace"), "module_count")


def hierarchy(packages: DataFrame) -> DataFrame:
    """packages with parent: the path of the directory above if that is a package."""
    up = F.when(F.col("path") == "", F.lit(None)).otherwise(dirname("path"))
    parents = packages.select("repository_id", F.col("path").alias("up"), F.col("path").alias("parent"))
    return packages.withColumn("up", up).join(parents, ["repository_id", "up"], "left").drop("up")


def ancestors(df: DataFrame, path: str, own: bool = False) -> DataFrame:
    """df with a row for each directory above ``path`` (dir, depth), the root "" included; with ``own``, path itself too."""
    parts = F.split(path, "/")
    n = F.size(parts) if own else F.size(parts) - 1
    return df.withColumn("depth", F.explode(F.sequence(F.lit(0), n))).withColumn("dir", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.col("depth"), F.lit(1))), "/")))


def package_dirs(files: DataFrame) -> DataFrame:
    """(repository_id, dir) of the directories with an __init__.py."""
    return files.filter(F.col("path").rlike(r"(^|/)__init__\.py$")).select("repository_id", dirname("path").alias("dir")).distinct()


def nearest_package(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """files that lie in a package, with the deepest one."""
    up = ancestors(files.select("id", "repository_id", "path"), "path").filter("depth > 0")
    return up.join(dirs, ["repository_id", "dir"]).groupBy("id").agg(F.max_by("dir", "depth").alias("package"))


def rollup(files: DataFrame, functions: DataFrame, classes: DataFrame, modules: DataFrame, packages: DataFrame) -> DataFrame:
    """Metrics of each package over its subtree: sizes, counts, complexity, tests and public names."""
    m = modules.select(F.col("id").alias("module_id"), "file_id")
    per_fn = functions.select("module_id", "class_id", "name", F.coalesce("complexity", F.lit(1)).alias("c")).join(m, "module_id").groupBy("file_id").agg(F.count("*").alias("fns"), F.sum("c").alias("sum_c"), F.max("c").alias("max_c"), F.count_if(F.col("class_id").isNull() & ~F.col("name").startswith("_")).alias("public_fns"))
    per_cls = classes.select("module_id", "name").join(m, "module_id").groupBy("file_id").agg(F.count("*").alias("cls"), F.count_if(~F.col("name").startswith("_")).alias("public_cls"))
    f = files.filter(F.col("path").endswith(".py")).select(F.col("id").alias("file_id"), "repository_id", "path", "size").join(per_fn, "file_id", "left").join(per_cls, "file_id", "left")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    up = ancestors(f, "path").withColumn("tested", F.col("path").contains("test")).drop("path")
    p = packages.select("repository_id", F.col("path").alias("dir"))
    g = up.join(p, ["repository_id", "dir"]).groupBy("repository_id", F.col("dir").alias("path"))
    return g.agg(z("size").alias("total_size"), z("fns").alias("total_functions"), z("cls").alias("total_classes"), z("sum_c").alias("total_complexity"), F.coalesce(F.max("max_c"), F.lit(0)).alias("max_complexity"), F.when(z("fns") > 0, F.floor(z("sum_c") / z("fns"))).otherwise(0).cast("long").alias("avg_complexity"), F.bool_or(F.col("tested")).alias("has_tests"), z("public_cls").alias("public_classes"), z("public_fns").alias("public_functions"))


def edges(imports: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(repository_id, source, target, import_count) between packages, by imports (file_id, module_name).

    The importing file counts for its own directory; the imported dotted name for the longest of its prefixes that is a
    package, else for the one package whose name is its first segment. A path relative to the file names no package.
    """
    f = files.select(F.col("id").alias("file_id"), "repository_id", dirname("path").alias("source"))
    p = packages.select("repository_id", F.col("path").alias("target"))
    i = imports.filter(~F.col("module_name").rlike(r"^[./]")).join(f, "file_id").withColumn("dotted", F.replace("module_name", F.lit("."), F.lit("/"))).groupBy("repository_id", "source", "dotted").agg(F.count("*").alias("times"))
    own = ["repository_id", "source", "dotted"]
    pre = ancestors(i, "dotted", own=True).filter("depth > 0").select(*own, F.col("dir").alias("target"), "depth")
    longest = pre.join(p, ["repository_id", "target"]).groupBy(*own).agg(F.max_by("target", "depth").alias("longest"))
    named = packages.groupBy("repository_id", F.col("name").alias("first")).agg(F.min("path").alias("named"))
    i = i.withColumn("first", F.regexp_extract("dotted", "^([^/]+)", 1)).select(*own, "first", "times")
    both = i.join(longest, own, "left").join(named, ["repository_id", "first"], "left").withColumn("target", F.coalesce("longest", "named"))
    return both.filter("source <> target").groupBy("repository_id", "source", "target").agg(F.sum("times").alias("import_count"))


def coupling(edges_: DataFrame, packages: DataFrame) -> DataFrame:
    """(repository_id, path, dependencies, dependents) of every package."""
    out = edges_.groupBy("repository_id", F.col("source").alias("path")).agg(F.count("*").alias("dependencies"))
    in_ = edges_.groupBy("repository_id", F.col("target").alias("path")).agg(F.count("*").alias("dependents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return packages.select("repository_id", "path").join(out, ["repository_id", "path"], "left").join(in_, ["repository_id", "path"], "left").select("repository_id", "path", zero("dependencies"), zero("dependents"))
