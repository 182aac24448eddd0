"""Symbol lookup, keyword search and filters over the code model. Every function maps DataFrames to a DataFrame.

Limits come last and after a total order (the id breaks ties), so a result does not depend on the partitioning. Searches
drop repeats after their filters, so the filters reach the scans and only hits are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY_TYPES = ("function", "class", "module", "file")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains(col: Column | str, text: str) -> Column:
    """Case-insensitive substring; % and _ of the text are ordinary characters."""
    return F.contains(F.lower(col), F.lit(text.lower()))


def symbols(functions: DataFrame, classes: DataFrame, modules: DataFrame) -> DataFrame:
    """One row per named entity: symbol_type, id, name, docstring, module_id, start_line, end_line."""
    pick = lambda df, kind, module: df.select(F.lit(kind).alias("symbol_type"), "id", "name", "docstring", F.col(module).alias("module_id"), "start_line", "end_line")
    return pick(functions, "function", "module_id").unionByName(pick(classes, "class", "module_id")).unionByName(pick(modules, "module", "id"))


def located(sym: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """Adds file_id, path and repository_id, which functions and classes have through their module only."""
    m = modules.select(F.col("id").alias("module_id"), "file_id")
    f = files.select(F.col("id").alias("file_id"), "path", "repository_id")
    return sym.join(m, "module_id", "left").join(f, "file_id", "left")


def keyword_search(sym: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Any word of the query in name or docstring; names that hold the whole query first, then by name."""
    words = [w for w in query.lower().split() if w]
    hit = any_of([contains("name", w) | F.coalesce(contains("docstring", w), F.lit(False)) for w in words])
    first = F.when(contains("name", query), 0).otherwise(1)
    return sym.filter(hit).dropDuplicates(["symbol_type", "id"]).withColumn("rank_group", first).orderBy("rank_group", "name", "symbol_type", "id").limit(limit)


def positional_search(sym: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Substring in name or docstring, earliest position in the name first, docstring-only hits last; similarity 0.8."""
    at = F.locate(text.lower(), F.lower("name"))
    hit = contains("name", text) | F.coalesce(contains("docstring", text), F.lit(False))
    return sym.filter(hit).dropDuplicates(["symbol_type", "id"]).withColumn("position", F.when(at > 0, at).otherwise(F.lit(2147483647))).withColumn("similarity", F.lit(0.8)).orderBy("position", "name", "symbol_type", "id").limit(limit)


def partial_name(sym: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Exact 1.0, prefix 0.8, suffix 0.6, elsewhere 0.4; scored first, limited once."""
    name, t = F.lower("name"), text.lower()
    score = F.when(name == t, 1.0).when(name.startswith(t), 0.8).when(name.endswith(t), 0.6).otherwise(0.4)
    return sym.filter(contains("name", text)).dropDuplicates(["symbol_type", "id"]).withColumn("score", score).orderBy(F.desc("score"), "name", "symbol_type", "id").limit(limit)


def by_signature(functions: DataFrame, name: str, types: list[str]) -> DataFrame:
    """Functions of that name whose parameter types include all the given ones."""
    have = F.transform("parameters", lambda p: p["type"])
    return functions.filter((F.col("name") == name) & (F.size(F.array_except(F.array(*map(F.lit, types)).cast("array<string>"), have)) == 0))


def has_base(classes: DataFrame, base: str) -> DataFrame:
    return classes.filter(F.array_contains("base_classes", base))


def entity(kind: str, frames: dict[str, DataFrame], entity_id: int) -> DataFrame:
    if kind not in ENTITY_TYPES:
        raise ValueError(f"entity type must be one of {', '.join(ENTITY_TYPES)}")
    return frames[kind].filter(F.col("id") == entity_id)


def hydrate(embeddings: DataFrame, functions: DataFrame, classes: DataFrame, modules: DataFrame, files: DataFrame, repositories: DataFrame) -> DataFrame:
    """Each embedding with the name, class, file and repository of its entity; what is missing is null."""
    named = functions.select(F.lit("function").alias("entity_type"), F.col("id").alias("entity_id"), "name", "class_id").unionByName(classes.select(F.lit("class").alias("entity_type"), F.col("id").alias("entity_id"), "name", F.lit(None).cast("long").alias("class_id"))).unionByName(modules.select(F.lit("module").alias("entity_type"), F.col("id").alias("entity_id"), "name", F.lit(None).cast("long").alias("class_id")))
    c = classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    f = files.select(F.col("id").alias("file_id"), "path", "repository_id")
    r = repositories.select(F.col("id").alias("repository_id"), F.concat_ws("/", "owner", F.col("name")).alias("repository"))
    e = embeddings.select("id", "entity_type", "entity_id", "embedding_type", "file_id")
    return e.join(named, ["entity_type", "entity_id"], "left").join(c, "class_id", "left").join(f, "file_id", "left").join(r, "repository_id", "left").select("id", "entity_type", "entity_id", "embedding_type", F.coalesce("name", "path").alias("name"), "class_name", "path", "repository")


def redact(col: str, secrets: tuple[str, ...] = ("token", "secret", "password", "key")) -> Column:
    """The map with the values of keys that name a secret replaced."""
    return F.transform_values(col, lambda k, v: F.when(F.lower(k).rlike("|".join(secrets)), F.lit("***REDACTED***")).otherwise(v))


def page(df: DataFrame, order: list, number: int = 1, size: int = 20) -> DataFrame:
    """One page of the rows in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    pages = F.ceil(F.col("total") / size)
    return df.agg(F.count("*").alias("total")).select("total", F.lit(number).alias("page"), pages.alias("pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def source_lines(contents: DataFrame, spans: DataFrame, context: int = 0) -> DataFrame:
    """spans (file_id, start_line, end_line, ...) with ``code``: those lines, 1-based and inclusive, and ``context`` more on either side."""
    lines = F.split("content", "\n")
    n = F.size(lines)
    lo = F.greatest(F.coalesce("start_line", F.lit(1)) - context, F.lit(1))
    hi = F.least(F.coalesce("end_line", n) + context, n)
    got = F.when(hi >= lo, F.array_join(F.slice(lines, lo, F.greatest(hi - lo + 1, F.lit(0))), "\n")).otherwise("")
    return spans.join(contents.filter(F.col("content").isNotNull()), "file_id").withColumn("code", got).drop("content")


def any_keyword(sym: DataFrame, keywords: list[str]) -> DataFrame:
    """Symbols that hold any of the keywords in their name or docstring; ``in_name`` ones come first, then by name."""
    name = any_of([contains("name", k) for k in keywords])
    doc = any_of([contains(F.coalesce("docstring", F.lit("")), k) for k in keywords])
    return sym.filter(name | doc).withColumn("in_name", F.coalesce(name, F.lit(False))).orderBy(F.desc("in_name"), "name", "symbol_type", "id")


def elements(modules: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """(element_id, parent_id, kind, module, full_name, line_count): the tree of modules, classes, functions and methods."""
    lines = lambda lo="start_line": (F.col("end_line") - F.col(lo) + 1).cast("int").alias("line_count")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    m = modules.select(key("m", "id").alias("element_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("module").alias("kind"), F.col("name").alias("module"), F.col("name").alias("full_name"), (F.col("end_line") - F.coalesce("start_line", F.lit(1)) + 1).cast("int").alias("line_count"))
    top = modules.select(F.col("id").alias("module_id"), F.col("name").alias("module"))
    c = classes.join(top, "module_id").select(key("c", "id").alias("element_id"), key("m", "module_id").alias("parent_id"), F.lit("class").alias("kind"), "module", F.concat("module", F.lit("."), "name").alias("full_name"), lines())
    owner = classes.select(F.col("id").alias("class_id"), F.col("id").alias("owner"), F.col("name").alias("class_name"))
    f = functions.join(top, "module_id").join(owner, "class_id", "left")
    own = F.col("owner").isNotNull()
    f = f.select(key("f", "id").alias("element_id"), F.when(own, key("c", "owner")).otherwise(key("m", "module_id")).alias("parent_id"), F.when(own, "method").otherwise("function").alias("kind"), "module", F.when(own, F.concat("module", F.lit("."), "class_name", F.lit("."), "name")).otherwise(F.concat("module", F.lit("."), "name")).alias("full_name"), lines())
    return m.unionByName(c).unionByName(f)


def calls(contents: DataFrame, names: DataFrame, definitions: DataFrame) -> DataFrame:
    """(name, file_id, line) of each line where one of the names stands before a parenthesis, without the definitions (file_id, line, name)."""
    lines = contents.filter(F.col("content").isNotNull()).select("file_id", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    words = lines.select("file_id", (F.col("i") + 1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*) ?\("), F.lit(1))).alias("name"))
    known = words.join(names.select("name").distinct(), "name", "left_semi").distinct()
    return known.join(definitions, ["file_id", "line", "name"], "left_anti").select("name", "file_id", "line")
