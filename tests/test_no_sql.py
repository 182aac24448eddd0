"""Queries without SQL beside them: expected rows on a small repository, or an independent computation on sf0.001."""

import numpy as np
import pytest

from codelode.plans import catalog

SOURCES = {
    1: ("pkg/__init__.py", ""),
    2: ("pkg/a.py", '"""Doc."""\nimport os\nfrom pkg.sub.b import g\n\nclass A(Base):\n    def run(self, x: int) -> str:\n        if x:\n            return g(x)\n        return ""\n'),
    3: ("pkg/sub/__init__.py", ""),
    4: ("pkg/sub/b.py", "import requests\nfrom pkg.a import A\n\ndef g(x):\n    return A()\n"),
    5: ("web/c.ts", "import { q } from './d';\nexport function h(a: number): number {\n  return a > 1 && q ? a : 0;\n}\n"),
    6: ("bad.py", "def ("),
    7: ("readme.md", "# x"),
    8: ("long.txt", "\n".join(f"line {i} " + "x" * (i % 90) for i in range(200))),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    put([(i, 1, p, "main", False) for i, (p, _) in SOURCES.items()] + [(2, 1, "pkg/a.py", "main", False)], "id long, repository_id long, path string, branch string, is_deleted boolean", "code_files")
    put([(i, t) for i, (_, t) in SOURCES.items()] + [(2, SOURCES[2][1]), (9, None)], "file_id long, content string", "file_contents")
    put([(20, 2, "a"), (40, 4, "b")], "id long, file_id long, name string", "code_modules")
    put([(200, 20, "A")], "id long, module_id long, name string", "code_classes")
    put([(700, 20, 200, "run", "Runs it."), (701, 40, None, "g", None)], "id long, module_id long, class_id long, name string, docstring string", "code_functions")
    return at


def rows(spark, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    return {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*sorted(df.columns)).collect()}


def named(spark, folder, name, *cols):
    return {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in catalog.QUERIES[name](spark, folder).select(*cols).collect()}


def test_entities(spark, folder):
    cols = ["file_id", "kind", "name", "class_name", "start_line", "end_line", "complexity"]
    want = {(1, "module", None, None, 1, 1, None), (3, "module", None, None, 1, 1, None), (6, "module", None, None, 1, 1, None), (2, "module", None, None, 1, 10, None), (2, "class", "A", None, 5, 9, None), (2, "method", "run", "A", 6, 9, 2), (4, "module", None, None, 1, 6, None), (4, "function", "g", None, 4, 5, 1), (5, "function", "h", None, 2, 4, 3)}
    assert named(spark, folder, "par_entities", *cols) == want
    assert named(spark, folder, "par_python_udtf", "file_id", "kind", "name", "class_name", "start_line", "complexity") == {(f, k, n, c, s, x) for f, k, n, c, s, _, x in want if f != 5}


def test_imports_and_dependencies(spark, folder):
    assert named(spark, folder, "par_imports", "file_id", "module_name", "names", "line") == {(2, "os", ("os",), 2), (2, "pkg.sub.b", ("g",), 3), (4, "requests", ("requests",), 1), (4, "pkg.a", ("A",), 2), (5, "./d", ("q",), 1)}
    assert named(spark, folder, "gr20_dependencies", "file_id", "module_name", "imported_file_id", "kind") == {(2, "os", None, "stdlib"), (2, "pkg.sub.b", 4, "local"), (4, "requests", None, "third_party"), (4, "pkg.a", 2, "local"), (5, "./d", None, "local")}
    assert named(spark, folder, "gr13_local_imports", "source", "target") == {(2, 4), (4, 2)}
    assert named(spark, folder, "gr13_file_cycles", "cycle", "length") == {((2, 4, 2), 2)}


def test_packages(spark, folder):
    assert named(spark, folder, "agg17_package_edges", "repository_id", "source", "target", "import_count") == {(1, "pkg", "pkg/sub", 1), (1, "pkg/sub", "pkg", 1)}
    assert named(spark, folder, "gr12_package_cycles", "path", "length") == {(("1:pkg", "1:pkg/sub"), 2)}
    coupling = catalog.QUERIES["agg19_package_coupling"](spark, folder)
    got = {r.path: r for r in coupling.collect() if r.path in ("pkg", "pkg/sub")}
    assert set(got) == {"pkg", "pkg/sub"} and all(1 in tuple(r) for r in got.values())


def test_references(spark, folder):
    got = named(spark, folder, "jn17_references_with_files", "path", "source", "target", "type")
    assert got >= {("pkg/a.py", "", "os", "import"), ("pkg/a.py", "A", "Base", "inherit"), ("pkg/a.py", "A.run", "pkg.sub.b.g", "call"), ("pkg/sub/b.py", "g", "pkg.a.A", "instantiate"), ("web/c.ts", "", "./d.q", "import")}
    resolved = {(r.file_id, r.target): r.target_id for r in catalog.QUERIES["par_references_resolved"](spark, folder).collect()}
    assert resolved[2, "pkg.sub.b.g"] == 701 and resolved[2, "os"] is None


def test_report_and_stored_symbols(spark, folder):
    got = {r.file_id: r for r in catalog.QUERIES["par19_report"](spark, folder).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and [i for i, r in got.items() if r.errors] == [6] and got[2].elements == 3
    stored = {r.name: r for r in catalog.QUERIES["snk9_store_parsed"](spark, folder).collect()}
    assert set(stored) == {"run", "g", "h"} and stored["run"].class_id is not None and stored["g"].class_id is None and stored["h"].complexity == 3


def test_chunks(spark, folder):
    assert {(i, n) for i, n, _ in named(spark, folder, "udtf3_prolog_chunks", "file_id", "end_line", "code")} == {(2, 3), (4, 2), (5, 1), (7, 1)}
    by = {}
    for r in catalog.QUERIES["udtf5_character_chunks"](spark, folder).orderBy("file_id", "chunk").collect():
        by.setdefault(r.file_id, []).append(r.code)
    for i, (_, text) in SOURCES.items():
        out, lines = by[i][0].split("\n"), text.split("\n")
        for piece in by[i][1:]:
            p = piece.split("\n")
            k = next(k for k in range(len(p), -1, -1) if k == 0 or out[-k:] == p[:k])
            assert sum(len(x) + 1 for x in p[:k]) <= 200
            out += p[k:]
        assert out == lines and all(len(x) <= 1000 + 200 for x in by[i])


def test_embeddings_are_of_the_texts(spark, folder):
    from codelode.operators import vectors as vx

    miss = catalog.QUERIES["vec16_missing_embeddings"]
    assert catalog.QUERIES["vec17_cache_misses"] is not None and miss is not None
    texts = spark.createDataFrame([(1, "a b a"), (2, "b a a"), (3, None), (4, "c")], "id long, text string")
    got = {r.id: r.embedding for r in vx.embed_texts(texts, "id", "text").collect()}
    assert got[1] == got[2] != got[4] and got[3] is None and len(got[1]) == 64 and sum(map(abs, got[1])) in (1.0, 3.0)


def test_search_by_cells_finds_the_true_neighbours(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(e.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = e.vec_id.to_numpy()
    got = {}
    for r in catalog.QUERIES["vec20_ivf_search"](spark, sf_dir).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = total = 0
    for i, own in got.items():
        s = x @ x[np.flatnonzero(ids == i)[0]]
        s[ids == i] = -2
        true = set(ids[np.argsort(-s)[:10]].tolist())
        hits, total = hits + len(true & own), total + len(true)
    assert hits / total >= 0.9


def test_no_move_of_one_vertex_improves_the_communities(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.stack(e.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = np.round(x @ x.T, 6)
    np.fill_diagonal(w, 0)
    w[w < 0.3] = 0
    place = {int(v): i for i, v in enumerate(e.vec_id)}
    got = {place[r[0]]: r[1] for r in catalog.QUERIES["gr2_communities"](spark, sf_dir).select("id", "community").collect()}
    used = sorted(got)
    w = w[np.ix_(used, used)]
    names = sorted(set(got.values()))
    member = np.array([names.index(got[i]) for i in used])
    degree, total = w.sum(1), w.sum()

    def quality(m):
        return sum(w[np.ix_(m == c, m == c)].sum() / total - (degree[m == c].sum() / total) ** 2 for c in set(m.tolist()))

    best = quality(member)
    assert best > 0
    for i in range(0, len(used), max(1, len(used) // 25)):
        for c in set(member[w[i] > 0].tolist()):
            m = member.copy()
            m[i] = c
            assert quality(m) <= best + 1e-4


def test_diversity_keeps_every_file(spark, sf_dir):
    from codelode.plans.base import Data
    from codelode.plans.ranks import results

    got = [r.file_id for r in catalog.QUERIES["rnk4_diversity"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(r.file_id for r in results(Data(spark, sf_dir)).select("file_id").collect()) and len(set(got)) == len(got)
