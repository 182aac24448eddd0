import ast

import pytest

from codelode.parse import braces, python
from codelode.parse import registry as rg

SNIPPETS = [
    ("def f():\n    return 1\n", 1),
    ("def f(x):\n    if x:\n        return 1\n", 2),
    ("def f(x):\n    for i in x:\n        pass\n", 2),
    ("def f(x):\n    while x:\n        if x:\n            pass\n", 3),
    ("def f(x):\n    try:\n        pass\n    except ValueError:\n        pass\n", 2),
    ("def f(x):\n    try:\n        pass\n    except ValueError:\n        pass\n    finally:\n        pass\n", 3),
    ("def f(a, b):\n    return a and b\n", 2),
    ("def f(a):\n    with a as b, a as c:\n        pass\n", 2),
    ("def f(a):\n    return [x for x in a]\n", 2),
    ("def f(a):\n    assert a\n", 2),
    ("def f(a):\n    return lambda x: 1 if x else 2\n", 2),
]


@pytest.mark.parametrize(("text", "want"), SNIPPETS)
def test_complexity(text, want):
    assert python.complexity(ast.parse(text).body[0]) == want


def test_python_entities():
    text = '"""Doc."""\nimport os\nfrom typing import List as L\n\nclass A(Base):\n    @property\n    def x(self) -> int:\n        return 1\n\nasync def go(a: int, b="z"):\n    yield a\n'
    rows = python.entities(text)
    assert [(r["kind"], r["name"], r["class_name"]) for r in rows] == [("module", None, None), ("class", "A", None), ("method", "x", "A"), ("function", "go", None)]
    go = rows[-1]
    assert go["is_async"] and go["is_generator"] and go["parameters"] == [{"name": "a", "type": "int", "default": None}, {"name": "b", "type": None, "default": "'z'"}]
    assert [i["module_name"] for i in python.imports(text)] == ["os", "typing"]
    assert {(r["type"], r["target"]) for r in python.references(text, "m")} >= {("inherit", "Base"), ("import", "os"), ("type_hint", "int")}


def test_relative_imports_climb():
    refs = python.references("from ..util import load\nfrom . import x\nload(1)\n", "pkg.sub.mod")
    assert ("call", "pkg.util.load") in {(r["type"], r["target"]) for r in refs}
    assert ("import", "pkg.sub.x") in {(r["type"], r["target"]) for r in refs}


def test_broken_python_is_a_module_with_an_error():
    rows = python.entities("def (:\n")
    assert len(rows) == 1 and rows[0]["error"].startswith("SyntaxError")


def test_java_and_php_and_typescript():
    java = "package a;\nimport java.util.List;\npublic abstract class A extends B implements C {\n  // class Not {}\n  public int f(int a, String b) { if (a > 1 && b != null) { return 1; } return 0; }\n}\n"
    rows = braces.entities(java, "java")
    assert [(r["kind"], r["name"]) for r in rows] == [("class", "A"), ("method", "f")]
    assert rows[0]["bases"] == ["B", "C"] and rows[0]["is_abstract"] and rows[1]["complexity"] == 3 and [(p["name"], p["type"]) for p in rows[1]["parameters"]] == [("a", "int"), ("b", "String")]
    php = "<?php\nuse App\\Core\\Node as N;\nclass A extends B {\n  # function no() {}\n  public static function go(array $x): int { return 1; }\n}\nfunction top($a) { foreach ($a as $b) {} }\n"
    assert [(r["kind"], r["name"]) for r in braces.entities(php, "php")] == [("class", "A"), ("method", "go"), ("function", "top")]
    assert braces.imports(php, "php")[0]["module_name"] == "App\\Core\\Node"
    ts = "import { A, B as C } from './a';\nexport interface I { x: number }\nexport class K extends A { async run(x: string): Promise<void> { return; } }\nconst f = (a: number) => { return a; };\n"
    assert {(r["kind"], r["name"]) for r in braces.entities(ts, "ts")} >= {("interface", "I"), ("class", "K"), ("method", "run"), ("function", "f")}
    assert braces.imports(ts, "ts")[0]["names"] == ["A", "C"]


def test_references_of_other_languages():
    kinds = lambda text, lang: {(r["source"], r["target"], r["type"]) for r in braces.references(text, lang)}
    java = "import a.b.Node;\nclass A extends B implements C, D {\n  private Node node;\n  List<Node> f(Token t, int n) { return new Queue(n); }\n}\n"
    assert kinds(java, "java") >= {("", "a.b.Node", "import"), ("A", "B", "inherit"), ("A", "C", "implement"), ("A", "D", "implement"), ("A", "Node", "type_use"), ("A", "Token", "type_use"), ("A", "Queue", "type_use")}
    assert not any(t == "int" for _, t, _ in kinds(java, "java"))
    php = "<?php\nuse App\\Node;\nclass A extends B implements C {\n  use Loud, Quiet;\n  public function f(?Node $n, string $s): Token { return new Queue(); }\n}\n"
    assert kinds(php, "php") >= {("A", "Loud", "trait_use"), ("A", "Quiet", "trait_use"), ("A", "Node", "type_use"), ("A", "Token", "type_use"), ("A", "Queue", "type_use"), ("A", "B", "inherit")}
    ts = "import { X, Y as Z } from './m';\nexport interface I extends J { a: Map<Key, number> }\nexport type P = X | null;\nclass K { b: Token; }\nexport { K, Z as W };\nexport const q = 1;\n"
    assert kinds(ts, "ts") >= {("", "./m.X", "import"), ("", "./m.Z", "import"), ("I", "J", "interface_extends"), ("I", "Map", "type_use"), ("I", "Key", "type_use"), ("K", "Token", "type_use")}
    assert braces.exports(ts) == ["I", "P", "K", "W", "q"] and braces.type_aliases(ts) == ["P"]
    assert braces.external(["import x from 'react'", "const y = require('./own')", "import os", "use App\\Node;"], frozenset({"os"})) == ["App\\Node", "react"]


def test_docblock_trims_tabs_and_carriage_returns_like_spaces(spark):
    from codelode.operators.domain import docblock

    blocks = ["/** One line. */", "/**\r\n * Reads\tthe row.\r\n * @param x\r\n *\r\n */", "/**\n\t * Writes it.\t\n\t *\t@return y\n\t */", "/**\n * \t\n */"]

    def brute(text):
        lines = [x.strip().lstrip("*").strip() for x in text.removeprefix("/**").removesuffix("*/").split("\n")]
        return " ".join(x for x in lines if x and not x.startswith("@"))

    df = spark.createDataFrame(list(enumerate(blocks)), "id long, docstring string")
    got = [r.prose for r in df.orderBy("id").select(docblock("docstring").alias("prose")).collect()]
    assert got == [brute(x) for x in blocks] == ["One line.", "Reads\tthe row.", "Writes it.", ""]


def test_a_file_that_breaks_its_parser_keeps_a_row_and_tells(spark, monkeypatch):
    files = spark.createDataFrame([(1, "a.py"), (2, "b.py"), (3, "c.zz"), (4, "d.md")], "id long, path string")
    contents = spark.createDataFrame([(1, "def f(): pass\n"), (2, "def ("), (3, "x\ny"), (4, "x")], "file_id long, content string")

    def bad(text):
        raise KeyError("zz")

    monkeypatch.setitem(rg.EXTENSIONS, ".zz", "zz")
    monkeypatch.setitem(rg._ENTITIES, "zz", bad)
    got = {r.file_id: r for r in rg.report(files, contents).collect()}
    assert got[1].errors == [] and got[1].elements == 2
    assert got[2].errors[0].startswith("SyntaxError") and got[2].elements == 1
    assert got[3].elements == 1 and "KeyError" in got[3].errors[0] and 4 not in got
    assert {(r.file_id, r.kind) for r in rg.entities(files, contents).collect()} == {(1, "module"), (1, "function"), (2, "module"), (3, "module")}


def shape(text, language):
    return [(r["kind"], r["name"], r["class_name"], r["start_line"], r["end_line"]) for r in braces.entities(text, language)]


PHP = """<?php
namespace App;
use App\\Core\\{Node, Edge as E, Deep\\Leaf};
use function App\\run;
use App\\Base;

/**
 * Holds nodes.
 * @package x
 */
#[Entity(table: "a{b")]
final class Tree extends Base implements \\Countable, Walks {
    use Loud, Quiet { Loud::say as protected; }
    private const X = ['}'];
    public function __construct(private ?Node $root = null, protected array $kids = [], string ...$more) {}

    /** Finds one. */
    #[Pure] public static function find(int|string $key, &$found = "}"): ?Node {
        $f = function ($x) use ($key) { return $x ? 1 : 2; };
        if ($key && $found) { return <<<EOT
            } {$key}
            EOT; }
        return null;
    }
    abstract protected function later(): static;
}
enum Suit: string { case A = 'a'; public function label(): string { return 'x'; } }
function top($a) { foreach ($a as $b) {} }
"""


def test_php_outline():
    assert shape(PHP, "php") == [("class", "Tree", None, 12, 26), ("method", "__construct", "Tree", 15, 15), ("method", "find", "Tree", 18, 24), ("method", "later", "Tree", 25, 25), ("enum", "Suit", None, 27, 27), ("method", "label", "Suit", 27, 27), ("function", "top", None, 28, 28)]
    rows = {r["name"]: r for r in braces.entities(PHP, "php")}
    assert rows["Tree"]["bases"] == ["Base", "\\Countable", "Walks"] and rows["Tree"]["traits"] == ["Loud", "Quiet"] and rows["Tree"]["docstring"] == "Holds nodes." and rows["Tree"]["decorators"] == ["Entity"]
    assert rows["__construct"]["parameters"] == [{"name": "root", "type": "?Node", "default": "null"}, {"name": "kids", "type": "array", "default": "[]"}, {"name": "more", "type": "string", "default": None}]
    find = rows["find"]
    assert (find["return_type"], find["is_static"], find["docstring"], find["decorators"]) == ("?Node", True, "Finds one.", ["Pure"]) and [p["type"] for p in find["parameters"]] == ["int|string", None]
    assert rows["later"]["is_abstract"] and rows["later"]["return_type"] == "static" and rows["top"]["complexity"] == 2
    assert [(i["module_name"], i["names"]) for i in braces.imports(PHP, "php")] == [("App\\Core\\Node", ["Node"]), ("App\\Core\\Edge", ["E"]), ("App\\Core\\Deep\\Leaf", ["Leaf"]), ("App\\run", ["run"]), ("App\\Base", ["Base"])]
    kinds = {(r["source"], r["target"], r["type"]) for r in braces.references(PHP, "php")}
    assert kinds >= {("Tree", "Loud", "trait_use"), ("Tree", "Quiet", "trait_use"), ("Tree", "Node", "type_use"), ("Tree", "Base", "inherit"), ("Tree", "Walks", "implement")}


JAVA = """package a.b;
import java.util.*;
import static java.util.Map.entry;
/** A box. */
@Entity(name = "x", tags = {"a", "b"})
public abstract class Box<T extends Comparable<? super T>> extends Base<Map<String, List<T>>> implements I<T>, J {
    private final Map<String, List<Token>> rows = new HashMap<>() {{ put("}", null); }};
    public Box(int size) { this.rows.clear(); }
    /** Reads. */
    @Override
    @SuppressWarnings({"unchecked", "}"})
    public static <K, V> Map<K, List<V[]>> read(final Map<K, V> from, @NonNull String... keys) throws IOException, E {
        char c = '}';
        return from.isEmpty() && keys == null ? null : Map.of();
    }
    abstract int[] count(int a[]);
    enum Kind { ONE(1) { int v() { return 1; } }, TWO; Kind(int... n) {} }
    interface Part { default void go() {} }
    @interface Mark { String value() default "x"; }
}
record Point(int x, int y) { Point { if (x < 0) throw new E(); } double len() { return 1; } }
"""


def test_java_outline():
    got = [(r["kind"], r["name"], r["class_name"]) for r in braces.entities(JAVA, "java")]
    assert got[:4] == [("class", "Box", None), ("method", "Box", "Box"), ("method", "read", "Box"), ("method", "count", "Box")]
    assert {("enum", "Kind", None), ("method", "Kind", "Kind"), ("interface", "Part", None), ("method", "go", "Part"), ("interface", "Mark", None), ("record", "Point", None), ("method", "len", "Point")} <= set(got)
    rows = {r["name"]: r for r in braces.entities(JAVA, "java") if r["name"] in ("read", "count")}
    box = braces.entities(JAVA, "java")[0]
    assert box["bases"] == ["Base", "I", "J"] and box["decorators"] == ["Entity"] and box["is_abstract"] and box["docstring"] == "A box."
    read = rows["read"]
    assert read["return_type"] == "Map<K, List<V[]>>" and read["parameters"] == [{"name": "from", "type": "Map<K, V>", "default": None}, {"name": "keys", "type": "String...", "default": None}]
    assert (read["start_line"], read["end_line"], read["decorators"], read["is_static"], read["docstring"], read["complexity"]) == (12, 15, ["Override", "SuppressWarnings"], True, "Reads.", 3)
    assert rows["count"]["is_abstract"] and rows["count"]["return_type"] == "int[]" and rows["count"]["parameters"][0]["name"] == "a"
    assert [(i["module_name"], i["is_wildcard"]) for i in braces.imports(JAVA, "java")] == [("java.util.*", True), ("java.util.Map.entry", False)]
    assert ("Box", "Token", "type_use") in {(r["source"], r["target"], r["type"]) for r in braces.references(JAVA, "java")}


TS = """import def, { type A, B as C } from './a';
import * as ns from "m";
import type { T } from 't';
export * from './all';
@Injectable({ deep: { a: 1 } })
export abstract class K<T extends { k: string }> extends L<T> implements M, N {
  private readonly x?: Map<string, Array<number>> = new Map();
  constructor(private readonly a: string, public b = { c: '}' }) { super(); }
  @Get('/}') async load<U>({ id, name }: { id: number; name: string }, cb: (e: Error) => void = () => {}): Promise<{ rows: U[] }> {
    const re = /[}/]/g, t = `}${a ? `{` : b}`;
    return a && b ? null! : { rows: [] };
  }
  abstract get size(): number;
  static *walk(...xs: number[]) { yield* xs; }
}
export interface I extends J, P<Q> { run(a: number): string; f?: () => void }
export type Name<T> = T extends string ? { a: 1 } : never;
const enum E { A = 1 }
export const add = async (a: number, b?: number): Promise<number> => { return a; };
const twice = x => x * 2;
export default function* gen<T>(this: Window, a: T[] = []): Iterable<T> { yield* a; }
namespace N.M { export function inner(): void {} }
"""


def test_typescript_and_javascript_outline():
    rows = {r["name"]: r for r in braces.entities(TS, "ts")}
    assert {n: (r["kind"], r["class_name"]) for n, r in rows.items()} == {"K": ("class", None), "constructor": ("method", "K"), "load": ("method", "K"), "size": ("method", "K"), "walk": ("method", "K"), "I": ("interface", None), "run": ("method", "I"), "Name": ("type_alias", None), "E": ("enum", None), "add": ("function", None), "twice": ("function", None), "gen": ("function", None), "inner": ("function", None)}
    assert rows["K"]["bases"] == ["L", "M", "N"] and rows["K"]["is_abstract"] and rows["K"]["decorators"] == ["Injectable"] and rows["I"]["bases"] == ["J", "P"]
    load = rows["load"]
    assert load["is_async"] and load["decorators"] == ["Get"] and load["return_type"] == "Promise<{ rows: U[] }>" and (load["start_line"], load["end_line"]) == (9, 12)
    assert [p["type"] for p in load["parameters"]] == ["{ id: number; name: string }", "(e: Error) => void"] and load["parameters"][1]["default"] == "() => {}"
    assert [p["name"] for p in rows["constructor"]["parameters"]] == ["a", "b"] and rows["walk"]["is_generator"] and rows["walk"]["parameters"][0]["name"] == "xs"
    assert rows["add"]["is_async"] and rows["add"]["return_type"] == "Promise<number>" and [p["name"] for p in rows["add"]["parameters"]] == ["a", "b"] and rows["twice"]["parameters"][0]["name"] == "x"
    assert rows["gen"]["return_type"] == "Iterable<T>" and rows["size"]["is_abstract"]
    assert [(i["module_name"], i["names"]) for i in braces.imports(TS, "ts")] == [("./a", ["def", "A", "C"]), ("m", ["ns"]), ("t", ["T"]), ("./all", ["*"])]
    js = "const a = require('x');\nclass A extends B.C { #p = 1; go(a, {b} = {}) { return /}/.test(a) } }\nvar f = function (x) { if (x) { } };\nexport { a as z } from './y';\n"
    assert shape(js, "js") == [("class", "A", None, 2, 2), ("method", "go", "A", 2, 2), ("function", "f", None, 3, 3)]
    assert [(i["module_name"], i["names"]) for i in braces.imports(js, "js")] == [("x", []), ("./y", ["z"])]
    assert {(r["source"], r["target"], r["type"]) for r in braces.references(js, "js")} == {("", "x", "import"), ("", "./y.z", "import"), ("A", "B.C", "inherit"), ("", "f", "function_definition")}


@pytest.mark.parametrize("language", ["php", "java", "ts", "js"])
def test_cut_off_texts_never_raise(language):
    text = {"php": PHP, "java": JAVA, "ts": TS, "js": TS}[language]
    for k in range(0, len(text), 7):
        braces.entities(text[:k], language)
        braces.imports(text[:k], language)
        braces.references(text[k:], language)
