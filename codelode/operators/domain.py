"""Domain-model operators: concepts, cluster names, context splits, merged entities, usages, texts for embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components


def concepts(query: Column) -> Column:
    """Words longer than three characters, capitalised: what a query is about when no model extracts it."""
    return F.transform(F.filter(F.split(query, r"\s+"), lambda w: F.length(w) > 3), lambda w: F.initcap(w))


def merge_entities(df: DataFrame, keys: list[str], lists: list[str], maps: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """One row per key: lists become the sorted set of their elements, maps their union (the smaller value of a repeated key), numbers their maximum."""
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    aggs += [F.max(c).alias(c) for c in numbers]
    got = df.groupBy(*keys).agg(*aggs)
    for m in maps:
        one = df.select(*keys, F.explode(m).alias("k", "v")).groupBy(*keys, "k").agg(F.min("v").alias("v")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(m))
        got = got.join(one, keys, "left")
    return got


def cluster_names(members: DataFrame) -> DataFrame:
    """(cluster, name) from members (cluster, id, name, kind): the first aggregate root, else the most frequent word, else Unnamed; " Context" follows."""
    root = members.filter("kind = 'aggregate_root'").groupBy("cluster").agg(F.min_by("name", "id").alias("root"))
    words = members.select("cluster", F.explode(F.split(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2"), r"[\s_]+")).alias("word")).filter("word <> ''").groupBy("cluster", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    top = words.groupBy("cluster").agg(F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("word"))
    name = F.coalesce("root", F.initcap("word"), F.lit("Unnamed"))
    return members.select("cluster").distinct().join(root, "cluster", "left").join(top, "cluster", "left").select("cluster", F.concat(name, F.lit(" Context")).alias("name"))


def context_splits(members: DataFrame, edges: DataFrame, cohesion: DataFrame, least: int = 20, most: float = 0.4) -> DataFrame:
    """(context, component, size): the parts of every context with at least ``least`` members, cohesion up to ``most`` and more than one part.

    members (id, context), edges (source, target), cohesion (context, cohesion).
    """
    big = members.groupBy("context").agg(F.count("*").alias("n")).filter(F.col("n") >= least).join(cohesion.filter(F.col("cohesion") <= most), "context", "left_semi")
    m = members.join(big.select("context"), "context", "left_semi")
    a, b = m.select(F.col("id").alias("source"), F.col("context").alias("ca")), m.select(F.col("id").alias("target"), F.col("context").alias("cb"))
    inner = edges.join(a, "source").join(b, "target").filter("ca = cb").select("source", "target")
    parts = components(m.select("id"), inner).join(m, "id").groupBy("context", "component").agg(F.count("*").alias("size"))
    several = parts.groupBy("context").count().filter("count > 1").select("context")
    return parts.join(several, "context", "left_semi")


def usages(contents: DataFrame, name: str, definitions: DataFrame) -> DataFrame:
    """(file_id, line, text) of the lines that hold the name as a word, without its definitions (file_id, line)."""
    lines = contents.filter(F.contains("content", F.lit(name))).select("file_id", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    hit = lines.filter(F.col("text").rlike(rf"(^|\W)\Q{name}\E(\W|$)")).select("file_id", (F.col("i") + 1).alias("line"), "text")
    return hit.join(definitions, ["file_id", "line"], "left_anti").dropDuplicates(["file_id", "line"])


def numbered_names(df: DataFrame, name: str = "name") -> DataFrame:
    """df with ``base``: names that only differ in a trailing number share it, if there are several."""
    stem = F.regexp_extract(name, r"^(.*?)(\d+)$", 1)
    d = df.withColumn("_stem", F.when(stem != "", stem).otherwise(F.col(name)))
    n = d.groupBy("_stem").agg(F.count("*").alias("_n"))
    return d.join(n, "_stem").withColumn("base", F.when(F.col("_n") > 1, F.col("_stem")).otherwise(F.col(name))).drop("_stem", "_n")


def docblock(c: str | Column) -> Column:
    """A doc block's prose on one line: no comment marks, no lines that begin with @."""
    lines = F.transform(F.split(F.regexp_replace(c, r"^\s*/\*+|\*+/\s*$", ""), "\n"), lambda x: F.btrim(F.regexp_replace(x, r"^\s*\*+\s?", ""), F.lit(" \t\r")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("@")), " ")


def function_text(functions: DataFrame) -> DataFrame:
    """(id, text): the text an embedder gets for a function."""
    args = F.array_join(F.transform("parameters", lambda p: p["name"]), ", ")
    return functions.select("id", F.concat_ws("\n", F.concat(F.lit("Function: "), "name"), F.when(F.size("parameters") > 0, F.concat(F.lit("Parameters: "), args)), F.concat(F.lit("Returns: "), "return_type"), F.concat(F.lit("Description: "), F.substring("docstring", 1, 200))).alias("text"))


def class_text(classes: DataFrame, functions: DataFrame, most: int = 10) -> DataFrame:
    """(id, text): name, bases and the first public methods by line, with how many more there are."""
    public = functions.filter(F.col("class_id").isNotNull() & ~F.col("name").startswith("_")).groupBy(F.col("class_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start_line", "id", "name"))).alias("ms"))
    c = classes.join(public, "id", "left")
    names = F.array_join(F.transform(F.slice("ms", 1, most), lambda x: x["name"]), ", ")
    more = F.when(F.size("ms") > most, F.concat(F.lit(" ... and "), (F.size("ms") - most).cast("string"), F.lit(" more"))).otherwise("")
    return c.select("id", F.concat_ws("\n", F.concat(F.lit("Class: "), "name"), F.when(F.size("base_classes") > 0, F.concat(F.lit("Bases: "), F.array_join("base_classes", ", "))), F.when(F.col("ms").isNotNull(), F.concat(F.lit("Methods: "), names, more))).alias("text"))


def suggestions(classes: DataFrame, functions: DataFrame, modules: DataFrame) -> DataFrame:
    """(file_id, suggestion, id) per file: missing root, anemic, potential value object, bloated."""
    n = functions.filter("class_id is not null").groupBy(F.col("class_id").alias("id")).agg(F.count("*").alias("methods"))
    x = classes.join(n, "id", "left").withColumn("methods", F.coalesce("methods", F.lit(0))).join(modules.select(F.col("id").alias("module_id"), "file_id"), "module_id")
    per = x.select("file_id", "id", F.explode(F.array_compact(F.array(F.when(F.col("methods") == 0, F.lit("anemic")), F.when(F.col("methods") == 1, F.lit("value_object")), F.when(F.col("methods") > 5, F.lit("bloated"))))).alias("suggestion"))
    rootless = x.groupBy("file_id").agg(F.bool_or("is_abstract").alias("root"), F.min("id").alias("id")).filter("not root").select("file_id", "id", F.lit("missing_aggregate").alias("suggestion"))
    return per.unionByName(rootless)


def function_summaries(functions: DataFrame) -> DataFrame:
    """(id, business_summary, technical_summary): what is said of a function where no model says more."""
    said = F.coalesce(F.nullif(F.col("docstring"), F.lit("")), F.lit("No description available"))
    return functions.select("id", F.concat(F.lit("Function "), "name", F.lit(" implementation")).alias("business_summary"), said.alias("technical_summary"))


def module_summaries(modules: DataFrame, functions: DataFrame, most: int = 10) -> DataFrame:
    """(id, business_summary, technical_summary, domain_concepts): the first ``most`` words of its functions' names, sorted."""
    words = functions.select(F.col("module_id").alias("id"), F.explode(F.split("name", "_")).alias("word")).filter(F.length("word") > 3).select("id", F.lower("word").alias("word")).distinct()
    c = words.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("word")), 1, most).alias("domain_concepts"))
    said = F.coalesce(F.nullif(F.col("docstring"), F.lit("")), F.lit("Module implementation"))
    none = F.array().cast("array<string>")
    return modules.join(c, "id", "left").select("id", F.concat(F.lit("Module "), "name").alias("business_summary"), said.alias("technical_summary"), F.coalesce("domain_concepts", none).alias("domain_concepts"))


def interpretations(functions: DataFrame, classes: DataFrame, modules: DataFrame) -> DataFrame:
    """(kind, id, interpretation): the texts that stand in for a model's."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    size = F.when(F.col("parameters").isNotNull(), F.size("parameters"))
    f = functions.select(F.lit("function").alias("kind"), "id", F.concat(F.lit("Function "), "name", F.lit(" that takes "), n(size), F.lit(" parameters")).alias("interpretation"))
    methods = functions.filter("class_id is not null").groupBy(F.col("class_id").alias("id")).agg(F.count("*").alias("n"))
    c = classes.select("id", "name").join(methods, "id", "left").select(F.lit("class").alias("kind"), "id", F.concat(F.lit("Class "), "name", F.lit(" with "), n(F.col("n")), F.lit(" methods")).alias("interpretation"))
    held = classes.groupBy(F.col("module_id").alias("id")).agg(F.count("*").alias("c"))
    free = functions.filter("class_id is null").groupBy(F.col("module_id").alias("id")).agg(F.count("*").alias("f"))
    m = modules.select("id", "name").join(held, "id", "left").join(free, "id", "left").select(F.lit("module").alias("kind"), "id", F.concat(F.lit("Module "), "name", F.lit(" containing "), n(F.col("c")), F.lit(" classes and "), n(F.col("f")), F.lit(" functions")).alias("interpretation"))
    return f.unionByName(c).unionByName(m)


def _with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def validated_entities(raw: DataFrame, sample: int = 500) -> DataFrame:
    """Extracted entities that have a name and a type, what else is missing filled in."""
    none = F.array().cast("array<string>")
    kept = raw.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("type", F.lit("")) != ""))
    got = _with_defaults(kept, {"description": F.lit(""), "business_rules": none, "invariants": none, "responsibilities": none, "ubiquitous_language": F.create_map().cast("map<string,string>"), "confidence_score": F.lit(1.0)})
    return got.withColumn("source_code_sample", F.substring("source_code_sample", 1, sample)) if "source_code_sample" in raw.columns else got


def validated_relationships(raw: DataFrame) -> DataFrame:
    """Extracted relationships that have both ends and a type, what else is missing filled in."""
    none = F.array().cast("array<string>")
    kept = raw.filter(F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("type").isNotNull())
    return _with_defaults(kept, {"description": F.lit(""), "strength": F.lit(1.0), "evidence": none, "interaction_patterns": none, "data_flow": F.create_map().cast("map<string,string>")})


def fetch_or_extract(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(file_id, entity_id, origin): a file's stored entities, or, if it has none, the extracted ones."""
    missing = fresh.join(stored.select("file_id"), "file_id", "left_anti")
    return stored.select("file_id", "entity_id", F.lit("stored").alias("origin")).unionByName(missing.select("file_id", "entity_id", F.lit("extracted").alias("origin")))


#: How a relationship of contexts is described; {n} is the number of interactions.
DESCRIPTIONS = {
    "shared_kernel": "Shared kernel with {n} shared domain concepts",
    "customer_supplier": "Customer-supplier relationship where one context drives the other",
    "conformist": "Conformist relationship requiring alignment with upstream context",
    "anti_corruption_layer": "Anti-corruption layer protecting from external model",
    "open_host_service": "Open host service providing public API",
    "published_language": "Published language for inter-context communication",
    "partnership": "Partnership with {n} collaborative interactions",
    "big_ball_of_mud": "Tangled relationship requiring refactoring",
}


def relationship_description(kind: Column, count: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])
    return F.replace(F.coalesce(F.try_element_at(table, kind), F.concat(kind, F.lit(" relationship"))), F.lit("{n}"), F.coalesce(count, F.lit(0)).cast("string"))


def context_descriptions(members: DataFrame, most: int = 5) -> DataFrame:
    """(context, name, description, core_concepts) from members (context, id, name, kind): named by the first root, else the first member."""
    root = F.when(F.col("kind") == "aggregate_root", F.col("id"))
    g = members.groupBy("context").agg(F.min_by(F.when(F.col("kind") == "aggregate_root", F.col("name")), root).alias("root"), F.min_by("name", "id").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("context").orderBy("id")
    few = members.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).groupBy("context").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("core_concepts"))
    return g.join(few, "context").select("context", F.concat(F.coalesce("root", "first"), F.lit(" Context")).alias("name"), F.concat(F.lit("Context containing "), F.col("n").cast("string"), F.lit(" related entities")).alias("description"), "core_concepts")
