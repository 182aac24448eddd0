from pyspark.sql import functions as F_

import pytest
from pyspark.sql import functions as F

from codelode.api import Code


@pytest.fixture(scope="module")
def code(spark, sf_dir):
    return Code(spark, sf_dir)


def test_search_and_definitions(code):
    assert code.keyword_search("queue", limit=5).count() <= 5
    name = code.functions.select(F.min("name")).first()[0]
    d = code.find_definition(name, "function")
    assert d.count() == code.functions.filter(F.col("name") == name).count() > 0 and d.filter("path is null").count() == 0
    assert code.semantic_search("load queue", "functions", limit=3).count() == 3
    assert code.search_code("zzzz qqqq").columns
    assert code.find_usage("report_failure").columns == ["file_id", "line", "text"]


def test_code_and_structure(code):
    one = code.functions.filter("start_line is not null").orderBy("id").first()
    got = code.get_code("function", one.id).collect()
    assert len(got) <= 1 and all(one.name in r.code for r in got)
    with pytest.raises(ValueError):
        code.get_code("table", 1)
    path = code.files.orderBy("id").first().path
    assert code.get_code_structure(path).count() >= 1
    assert code.analyze_file(path).columns[0] == "file_id"
    assert set(code.suggest_refactoring(path).columns) == {"id", "smell", "kind"}


def test_repositories(code):
    assert code.list_repositories().count() == code.repos.count()
    assert code.add_repository(code.repos).count() == 0
    files, modules, classes, functions = code.remove_repository(1)
    assert files.filter("repository_id = 1").count() == 0
    assert functions.join(code.modules.select(F.col("id").alias("module_id"), "file_id"), "module_id").join(code.files.filter("repository_id = 1").select(F.col("id").alias("file_id")), "file_id", "left_semi").count() == 0
    scan = code.files.filter("repository_id = 1 and not is_deleted").select("path", F.lit("x").alias("content_hash")).distinct()
    assert code.sync_repository(scan, 1).select("change").distinct().count() <= 1


def test_packages_and_domain(code):
    assert code.packages(1).columns[0] == "repository_id"
    assert code.analyze_package_structure(1).count() == code.packages(1).count()
    assert code.get_package_coupling_metrics(1).count() == code.packages(1).count()
    with pytest.raises(ValueError):
        code.get_dependencies(code.packages(), 1, 9)
    assert code.get_domain_metrics().count() == 1
    assert code.analyze_domain_evolution("2024-01-31 00:00:00").count() == 1


def test_file_structure_packages_and_domain_model(spark, sf_dir, tmp_path):
    import subprocess

    from codelode.api import Code

    code = Code(spark, sf_dir)
    row = code.files.join(code.modules.select(F_.col("file_id").alias("id")), "id", "left_semi").filter("path like '%/%/%'").orderBy("id").first()
    one = code.get_file_structure(row.path).filter(F_.col("file_id") == row.id).first()
    assert one.modules >= 1 and one.path == row.path
    tree = code.get_package_tree(row.repository_id).collect()
    paths = [r.path for r in tree]
    assert paths == sorted(paths) and all(r.parent is None or r.path.startswith(r.parent + "/") and r.parent in paths for r in tree) and all(r.line == "  " * r.depth + r.path.split("/")[-1] for r in tree)
    pick = max(tree, key=lambda r: -r.depth)
    got = code.get_package_details(row.repository_id, pick.path).first()
    assert got.path == pick.path and got.dependencies >= 0 and all(f.startswith(pick.path + "/") for f in got.files)
    assert {r.origin for r in code.extract_domain_model(row.path).collect()} <= {"stored", "extracted"}
    entities = spark.createDataFrame([(1, "Order", "aggregate_root"), (2, "Line", "entity"), (3, "Cart", "aggregate_root")], "id long, name string, kind string")
    relations = spark.createDataFrame([(3, 1), (3, 2), (1, 2)], "source long, target long")
    assert [(r.name, r.members) for r in code.find_aggregate_roots(entities, relations).collect()] == [("Cart", 2), ("Order", 1)]
    members = entities.withColumn("context", F_.lit(7).cast("long"))
    ctx = code.analyze_bounded_context(7, members, spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")).first()
    assert ctx.name == "Order Context" and ctx.description == "Context containing 3 related entities" and ctx.core_concepts == ["Order", "Line", "Cart"] and ctx.size == 3
    assert code.find_similar_patterns("x").count() == 0
    found = spark.createDataFrame([("x", 0.9), ("x", 0.5), ("y", 1.0)], "pattern_type string, confidence double")
    assert [r.confidence for r in code.find_similar_patterns("x", lambda: found).collect()] == [0.9]
    assert [r.similarity for r in code.find_duplicate_code(lambda: spark.createDataFrame([(0.95, 1), (0.2, 2)], "similarity double, n int")).collect()] == [0.95]
    (tmp_path / "r").mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "r" / "a.py").write_text("x = 1\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    assert [r.path for r in code.scan_repository(5, f"file://{tmp_path}/r", "unused").collect()] == ["a.py"]
