import pytest

from codelode.operators import packages as pk

FILES = [(1, "__init__.py", 10), (2, "main.py", 100), (3, "README.md", 500), (4, "src/__init__.py", 20), (5, "src/utils.py", 200), (6, "src/extras.py", 150), (7, "src/core/__init__.py", 30), (8, "src/core/motor.py", 300), (9, "tests/__init__.py", 5), (10, "tests/test_utils.py", 150), (11, "namespace/one.py", 100), (12, "namespace/two.py", 120)]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(i, 1, p, s) for i, p, s in FILES], "id long, repository_id long, path string, size int")


def test_five_packages(files):
    got = {r.path: r for r in pk.hierarchy(pk.discover(files)).collect()}
    assert set(got) == {"", "src", "src/core", "tests", "namespace"}
    assert got[""].name == "root" and got["src"].parent == "" and got["src/core"].parent == "src"
    assert got["namespace"].is_namespace and not got["src"].is_namespace


def test_edges_by_longest_prefix(spark, files):
    imports = spark.createDataFrame([(5, "src.core.motor"), (10, "src.utils"), (5, "os.path"), (5, "src.extras")], "file_id long, module_name string")
    got = {(r.source, r.target): r.import_count for r in pk.edges(imports, files, pk.discover(files)).collect()}
    assert got == {("src", "src/core"): 1, ("tests", "src"): 1}
    c = {r.path: (r.dependencies, r.dependents) for r in pk.coupling(pk.edges(imports, files, pk.discover(files)), pk.discover(files)).collect()}
    assert c["src"] == (1, 1) and c["namespace"] == (0, 0)


def test_rollup(spark, files):
    modules = spark.createDataFrame([(1, 5)], "id long, file_id long")
    classes = spark.createDataFrame([(1, 1, "Tool")], "id long, module_id long, name string")
    functions = spark.createDataFrame([(1, 1, None, "f", 5), (2, 1, 1, "m", 3)], "id long, module_id long, class_id long, name string, complexity int")
    got = {r.path: r for r in pk.rollup(files, functions, classes, modules, pk.discover(files)).collect()}
    s = got["src"]
    assert (s.total_complexity, s.avg_complexity, s.max_complexity, s.public_classes, s.public_functions, s.has_tests) == (8, 4, 5, 1, 1, False)
    assert got[""].total_size == sum(s for _, p, s in FILES if p.endswith(".py")) and got["tests"].has_tests
